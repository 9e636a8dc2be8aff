"""Joins by interval, by the latest or nearest time, and by place.

All of them keep an equality key in front, so that a plan is a hash-partitioned
join or window and never a nested loop over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def contained(events: DataFrame, intervals: DataFrame, keys: list[str], start: str, stop: str, lo: str, hi: str, width: float | None = None) -> DataFrame:
    """Events wholly and strictly inside an interval of the same keys, with the interval's columns.

    With a ``width`` (for keys that hold many intervals each) the time axis is cut
    into buckets of that size and both sides meet by bucket.
    """
    inside = (F.col(start) > F.col(lo)) & (F.col(stop) < F.col(hi))
    if width is None:
        return events.join(intervals, keys).where(inside)
    return _bucketed(events, intervals, keys, start, lo, hi, width, inside)


def contained_once(events: DataFrame, intervals: DataFrame, keys: list[str], start: str, stop: str, lo: str, hi: str) -> DataFrame:
    """``contained`` for intervals that don't overlap, as successive trials of a log in order of time.

    Only the latest interval that begins before an event can hold it, so this is one as-of
    window over the keys and no pair of an event and another interval is made.
    """
    columns = [hi, lo, *(c for c in intervals.columns if c not in (*keys, lo, hi))]
    met = as_of(events, intervals, keys, start, lo, columns)
    return met.where((F.col(start) > F.col(lo)) & (F.col(stop) < F.col(hi)))


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str, width: float, closed: str = "left") -> DataFrame:
    """Points with lo <= p < hi (``left``), lo < p < hi (``none``) or lo <= p <= hi (``both``)."""
    p, a, b = F.col(point), F.col(lo), F.col(hi)
    inside = {"left": (p >= a) & (p < b), "none": (p > a) & (p < b), "both": (p >= a) & (p <= b)}[closed]
    return _bucketed(points, intervals, keys, point, lo, hi, width, inside)


def _bucketed(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str, width: float, inside: Column) -> DataFrame:
    of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    left = points.withColumn("_bucket", of(point))
    right = intervals.where(F.col(hi) >= F.col(lo)).withColumn("_bucket", F.explode(F.sequence(of(lo), of(hi))))
    return left.join(right, [*keys, "_bucket"]).where(inside).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Every left row with ``columns`` of the latest right row of its keys at or before its time; NULLs where there is none.

    One shuffle by the keys and one running window; neither side is broadcast.  Of
    right rows at the same time the one with the greatest values counts.
    """
    value = F.struct(F.col(right_time).alias("t"), *columns)
    a = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col("_last")[c].alias(c) for c in columns))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, index: str) -> DataFrame:
    """Every left row with the ``index`` of the right row nearest in time (``nearest``), the smallest index among equals.

    Nearest is the better of the latest before and the earliest after, so two
    running windows over one shuffle find it.
    """
    a = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(True).alias("_left"), F.lit(None).cast("struct<t:double,i:long>").alias("_v"))
    v = F.struct(F.col(right_time).cast("double").alias("t"), F.col(index).cast("long").alias("i"))
    b = right.groupBy(*keys, right_time).agg(F.min(index).alias(index)).select(*(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), F.col(right_time).alias("_t"), F.lit(False).alias("_left"), v.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t")
    before = F.last("_v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    t = F.col("_t").cast("double")
    gap = lambda c: F.abs(F.col(c)["t"] - t)
    x = a.unionByName(b).withColumn("_b", before).withColumn("_a", after).where("_left")
    best = F.when(F.col("_a").isNull() | (gap("_b") < gap("_a")) | ((gap("_b") == gap("_a")) & (F.col("_b.i") <= F.col("_a.i"))), F.col("_b.i")).otherwise(F.col("_a.i"))
    return x.select(*left.columns, best.alias("nearest"))


def point_in_roi(points: DataFrame, rois: list[tuple[float, float, float, float]], x: str, y: str) -> DataFrame:
    """``roi``: the last rectangle (x, y, width, height) that holds the point, -1 where none does.  The rectangles are a configuration's handful, so this is one expression."""
    hit = F.lit(-1)
    for n, (left, top, width, height) in enumerate(rois):
        across, down = F.col(x) - left, F.col(y) - top
        hit = F.when((across >= 0) & (across < width) & (down >= 0) & (down < height), F.lit(n)).otherwise(hit)
    return points.withColumn("roi", hit)


def roi_order(points: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``roi_rank``: the place of each point when its keys' points are put in order of their rectangles."""
    return points.withColumn("roi_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("roi", position)) - 1)


def matching(df: DataFrame, other: DataFrame, keys: list[str], present: bool = True) -> DataFrame:
    """Rows whose keys the other frame has (or has not)."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi" if present else "left_anti")
