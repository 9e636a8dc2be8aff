"""Traces over time: steps, running sums, unwrapping, filling, smoothing, a common time base."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.geometry import wrap


def over(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def step(c: str | Column, w: WindowSpec) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c - F.lag(c).over(w)


def step_distance(x: str, y: str, w: WindowSpec, scale: float = 1.0) -> Column:
    return F.sqrt(F.pow(step(x, w), 2) + F.pow(step(y, w), 2)) * scale


def relative_seconds(time: str, w: WindowSpec, unit: float = 1e-9) -> Column:
    return (F.col(time) - F.first(time).over(w)) * unit


def cumulative(c: Column, w: WindowSpec) -> Column:
    """Running sum in which a missing value adds nothing."""
    return F.sum(F.coalesce(_number(c), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def speed(dist: Column, seconds: Column, w: WindowSpec) -> Column:
    return F.try_divide(dist, seconds - F.lag(seconds).over(w))


def unwrapped(df: DataFrame, angle: str, keys: list[str], order: list[str], name: str = "unwrapped") -> DataFrame:
    """Angles without jumps of a turn, from 0 at each trace's first row; rows without an angle are skipped."""
    w = over(keys, order)
    d = df.where(F.col(angle).isNotNull() & ~F.isnan(angle)).withColumn("_fix", F.coalesce(wrap(step(angle, w)), F.lit(0.0)))
    run = F.col(angle) + F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, run).withColumn(name, F.col(name) - F.first(name).over(w)).drop("_fix")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(over(keys, order))).where(F.col("_n") <= n).drop("_n")


def between(df: DataFrame, time: str, lo, hi) -> DataFrame:
    """Rows in a closed range of time; order is a matter of later windows."""
    return df.where(F.col(time).between(lo, hi))


def filled(value: str, position: str, keys: list[str]) -> Column:
    """Missing values on the line between the nearest present ones, by position; beyond the ends the nearest one."""
    v = _number(F.col(value))
    s = F.when(v.isNotNull(), F.struct(F.col(position).alias("p"), v.alias("v")))
    w = over(keys, [position])
    a = F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(s, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.when(v.isNotNull(), v).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(position) - a["p"]) / (b["p"] - a["p"]))


def resampled(df: DataFrame, keys: list[str], time: str, values: list[str], seconds: float, fps: float) -> DataFrame:
    """(keys, sample, time, values): each trace on a common time base, linear between its rows, the end rows' values beyond them.

    Rows and grid points of a trace are one ordered partition, so interpolation is
    two running windows and no range join.
    """
    n = int(fps * seconds)
    rows = df.select(*keys, F.col(time).cast("double").alias("t"), F.lit(None).cast("int").alias("sample"), *(_number(F.col(v).cast("double")).alias(v) for v in values))
    grid = df.select(*keys).distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.select(*keys, (F.col("sample") * F.lit(seconds / n)).alias("t"), "sample", *(F.lit(None).cast("double").alias(v) for v in values))
    both = rows.unionByName(grid)
    w = Window.partitionBy(*keys).orderBy("t", F.col("sample").asc_nulls_first())
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    for v in values:
        s = F.when(F.col(v).isNotNull(), F.struct("t", F.col(v).alias("v")))
        both = both.withColumn(f"_a_{v}", F.last(s, ignorenulls=True).over(back)).withColumn(f"_b_{v}", F.first(s, ignorenulls=True).over(ahead))

    def value(v: str) -> Column:
        a, b = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        inside = a["v"] + (b["v"] - a["v"]) * F.coalesce(F.try_divide(F.col("t") - a["t"], b["t"] - a["t"]), F.lit(0.0))
        return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inside).alias(v)

    return both.where("sample is not null").select(*keys, "sample", F.col("t").alias("time"), *map(value, values))


def savgol(df: DataFrame, keys: list[str], position: str, values: list[str], window: int = 41, order: int = 2) -> DataFrame:
    """Least-squares polynomial smoothing; at either end the polynomial of the outermost whole window.

    A trace shorter than a window is returned as it is.  Each trace is one group:
    the end polynomials are beyond a window expression.
    """
    import numpy as np

    half = window // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        if len(pdf) >= window:
            for v in values:
                y = pdf[v].to_numpy(float)
                out = np.convolve(y, fit[0][::-1], "same")
                out[:half] = np.vander(x[:half], order + 1, increasing=True) @ (fit @ y[:window])
                out[-half:] = np.vander(x[-half:], order + 1, increasing=True) @ (fit @ y[-window:])
                pdf[v] = out
        return pdf

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def eye_traces(df: DataFrame, left: str, right: str, left_likelihood: str, right_likelihood: str, position: str, keys: list[str], least: float = 0.9) -> DataFrame:
    """Eye angles with uncertain ones replaced on the line between certain ones."""
    gate = lambda v, p: F.when(F.col(p) >= least, F.col(v))
    d = df.withColumn("_l", gate(left, left_likelihood)).withColumn("_r", gate(right, right_likelihood))
    return d.withColumn(left, filled("_l", position, keys)).withColumn(right, filled("_r", position, keys)).drop("_l", "_r")


def mean_and_sem(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Means over ``inner``, then their mean, standard error and deviation over ``outer``."""
    one = df.groupBy(*inner).agg(F.avg(_number(F.col(value))).alias("_m"))
    sd = F.stddev_samp("_m")
    return one.groupBy(*outer).agg(F.avg("_m").alias("mean"), F.try_divide(sd, F.sqrt(F.count("_m").cast("double"))).alias("sem"), sd.alias("std"))


def without_outliers(df: DataFrame, condition: Column, column: str | None = None) -> DataFrame:
    """The column NULL where the condition holds, or, without a column, every column."""
    off = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(~off, F.col(c)) for c in ([column] if column else df.columns)})


def time_series(tracking: DataFrame, trials: DataFrame, keys: list[str], time: str, x: str, y: str, angle: str, cx: Column, cy: Column, mm_per_pix: float = 1.0, seconds: float = 30.0, fps: float = 10.0, unit: float = 1e-9) -> DataFrame:
    """Distance, distance from the centre, speed and unwrapped heading of each trial on a common time base."""
    trace = [*keys, "stim", "condition", "trial_num"]
    seg = tracking.join(trials, keys).where(F.col(time).between(F.col("start"), F.col("stop")))
    w = over(trace, [time])
    seg = seg.withColumn("_t", relative_seconds(time, w, unit)).withColumn("_step", step_distance(x, y, w, mm_per_pix))
    seg = seg.withColumn("distance", cumulative(F.col("_step"), w)).withColumn("distance_center", F.sqrt(F.pow(F.col(x) * mm_per_pix - cx, 2) + F.pow(F.col(y) * mm_per_pix - cy, 2))).withColumn("speed", speed(F.col("_step"), F.col("_t"), w))
    theta = unwrapped(seg, angle, trace, [time], "theta").select(*trace, F.col(time), "theta")
    seg = seg.join(theta, [*trace, time], "left")
    return resampled(seg, trace, "_t", ["distance", "distance_center", "speed", "theta"], seconds, fps)
