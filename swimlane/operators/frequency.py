"""Bouts counted into a dense grid of animals, epochs, trials, categories and sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import cosinor
from ..functions.text import day_label, parse_name
from ..plans.dims import CATEGORIES
from ..plans.specs import Epoch, spec_table


def in_epochs(bouts: DataFrame, specs: list[Epoch], stim: str = "stim") -> DataFrame:
    """Each bout once for every epoch whose stimulus and parameters it meets (``epoch_num``), whatever its trial and time.

    The epochs are a configuration's, so membership is an array of expressions
    over one scan: neither a join nor a shuffle.
    """
    kinds = dict(bouts.dtypes)
    member = [F.when((F.col(stim) == F.lit(e.stim)) & e.rules.predicate(kinds), F.lit(e.num)) for e in specs]
    return bouts.withColumn("epoch_num", F.explode(F.array_compact(F.array(*member)))) if member else bouts.withColumn("epoch_num", F.lit(0)).where("false")


def epoch_frequency(bouts: DataFrame, specs: list[Epoch], categories: list, sides: list = [-1, 1], file: str = "file", stim: str = "stim", trial: str = "trial_num", time: str = "trial_time", category: str = "category", side: str = "sign") -> DataFrame:  # noqa: B006
    """Counts and rates of every cell; an animal without any bout in an epoch is absent there, not zero.

    Columns: file, epoch_num, trial_num (recorded), trial_position (in the epoch's
    range), category, sign, bout_counts, bout_frequency (a second; NULL for an
    empty bin), and the epoch's name, parameters and bounds.

    The bouts are read once: cells are counted, an animal's cells of an epoch are put into one map,
    and the grid looks its counts up there.  All of it is partitioned by what the bouts are
    (by file, if they come so).
    """
    spark = bouts.sparkSession
    table = F.broadcast(spec_table(spark, specs))  # one row an epoch of the configuration
    m = in_epochs(bouts, specs, stim).select(F.col(file).alias("file"), "epoch_num", F.col(trial).cast("int").alias("trial_num"), F.col(time).cast("double").alias("t"), F.col(category).alias("category"), F.col(side).alias("sign"))
    bounds = F.create_map(*(F.lit(x) for e in specs for x in (e.num, F.array(F.lit(e.lo), F.lit(e.hi))))) if specs else F.create_map().cast("map<int,array<double>>")
    span = bounds[F.col("epoch_num")]
    inside = (F.col("t") >= span[0]) & (F.col("t") < span[1])
    cell = F.struct("trial_num", "category", "sign")
    counted = m.groupBy("file", "epoch_num", "trial_num", "category", "sign").agg(F.count_if(inside).alias("n"))
    maps = counted.groupBy("file", "epoch_num").agg(F.map_from_entries(F.collect_list(F.struct(cell.alias("k"), F.col("n").alias("v")))).alias("cells"))
    of = lambda values: F.explode(F.array(*map(F.lit, values)))
    grid = maps.join(table, "epoch_num").select("*", F.posexplode("trials").alias("trial_position", "trial_num")).drop("trials")
    grid = grid.withColumn("category", of(categories)).withColumn("sign", of(sides))
    out = grid.withColumn("bout_counts", F.coalesce(F.try_element_at("cells", cell.cast(dict(counted.select(cell.alias("k")).dtypes)["k"])), F.lit(0).cast("long"))).drop("cells")
    return out.select("file", "epoch_num", "trial_num", "category", "sign", "bout_counts", "trial_position", "epoch_name", "stim_param", "lo", "hi", F.try_divide(F.col("bout_counts").cast("double"), F.col("hi") - F.col("lo")).alias("bout_frequency"))


def tall(freq: DataFrame) -> DataFrame:
    """The exchange table: animal, age, day, time of day, epoch, bin midpoint and width, category name, side, rate and count."""
    n = parse_name(F.col("file"))
    c, s = cosinor(F.col("n.hour") * 3600 + F.col("n.minute") * 60 + F.col("n.second"))
    names = F.array(*map(F.lit, CATEGORIES))
    return freq.withColumn("n", n).select(
        F.col("file").alias("fish"), F.col("n.age").alias("dpf"), day_label(F.col("n")).alias("day"), c.alias("time_of_day_cos"), s.alias("time_of_day_sin"), "epoch_name", "stim_param",
        F.col("trial_position").alias("trial_num"), (F.col("lo") + (F.col("hi") - F.col("lo")) / 2).alias("trial_time"), (F.col("hi") - F.col("lo")).alias("time_bin_duration"),
        names[F.col("category")].alias("bout_category"), F.col("sign").alias("bout_side"), "bout_frequency", "bout_counts", "epoch_num",
    )


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str, name: str = "mean") -> DataFrame:
    """The mean over ``outer`` of the means over ``inner``; missing values count in neither."""
    one = df.groupBy(*inner).agg(F.avg(not_nan(F.col(value))).alias("_m"))
    return one.groupBy(*outer).agg(F.avg("_m").alias(name))


def heatmap(freq: DataFrame) -> DataFrame:
    """Mean rate by epoch, category and side: over an animal's trials, then over animals."""
    return mean_of_means(freq, ["epoch_num", "epoch_name", "category", "sign", "file"], ["epoch_num", "epoch_name", "category", "sign"], "bout_frequency", "mean_frequency")


def dense(freq: DataFrame) -> DataFrame:
    """An array of rates by position in the epoch's trials for each animal, epoch, category and side."""
    cells = F.array_sort(F.collect_list(F.struct("trial_position", "bout_frequency")))
    return freq.groupBy("file", "epoch_num", "category", "sign").agg(F.transform(cells, lambda x: x["bout_frequency"]).alias("rates"))


def share(df: DataFrame, within: list[str], by: list[str], empty_is_zero: bool = True) -> DataFrame:
    """Each cell's share of its group's rows; a group without rows gives 0, or NULL."""
    from pyspark.sql.window import Window

    n = df.groupBy(*within, *by).agg(F.count("*").alias("n"))
    part = F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*within)))
    return n.withColumn("share", F.coalesce(part, F.lit(0.0)) if empty_is_zero else part)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str] = [], density: bool = False) -> DataFrame:  # noqa: B006
    """(by, bin, n) for values in [lo, hi], the last bin closed; with ``density`` also the share by width.  Bins without a value are left out."""
    v = F.col(value)
    b = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    n = df.where((v >= lo) & (v <= hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return n
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(w) * ((hi - lo) / bins)))


def kde(df: DataFrame, value: str, grid: list[float], bandwidth: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, x, density): Gaussian kernels summed at each point of a grid; one aggregate, no cross join of rows."""
    import math

    norm = 1 / (bandwidth * math.sqrt(2 * math.pi))
    at = [F.avg(norm * F.exp(-0.5 * F.pow((F.lit(x) - F.col(value)) / bandwidth, 2))).alias(f"d{i}") for i, x in enumerate(grid)]
    wide = (df.groupBy(*by) if by else df).agg(*at)
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"d{i}").alias("density")) for i, x in enumerate(grid))))
    return wide.select(*by, cells.alias("c")).select(*by, "c.x", "c.density")
