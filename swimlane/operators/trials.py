"""Trials as intervals, numbered within their condition, and the bouts inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import list_key
from ..plans.dims import CONDITION_OF, STIM_ID
from .joins import contained


def intervals(log: DataFrame, keys: list[str], order: list[str], time: str, last: Column | DataFrame, keep: Column | None = None) -> DataFrame:
    """The log with ``start`` and ``stop``: a stimulus ends where the next one in log order begins, the last one at ``last``.

    ``last`` is a column, or a frame of (keys, last).  ``keep`` filters after the
    ends are known, so a dropped stimulus still ends the one before it.
    """
    if isinstance(last, DataFrame):
        log, last = log.join(last, keys, "left"), F.col("last")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = log.withColumn("start", F.col(time)).withColumn("stop", F.coalesce(F.lead(time).over(w), last))
    return out if keep is None else out.where(keep)


def last_clock(a: DataFrame, b: DataFrame, keys: list[str], time: str = "timestamp") -> DataFrame:
    """(keys, last): the later end of two clocks; a missing one does not count."""
    of = lambda d: d.groupBy(*keys).agg(F.max(time).alias("last"))
    return of(a).unionByName(of(b)).groupBy(*keys).agg(F.max("last").alias("last"))


def numbered(trials: DataFrame, keys: list[str], condition: str, order: list[str], name: str = "trial_num") -> DataFrame:
    """Trials with their number from 0 among those of the same condition; trials without a condition vanish."""
    w = Window.partitionBy(*keys, condition).orderBy(*order)
    return trials.where(F.col(condition).isNotNull()).withColumn(name, F.row_number().over(w) - 1)


def from_log(log: DataFrame, last: DataFrame, keys: list[str] = ["file"], position: str = "position") -> DataFrame:  # noqa: B006
    """Numbered trials of a stimulus log: intervals, text keys of colours, the looming centre's parts, the condition of each stimulus."""
    t = intervals(log, keys, [position], "timestamp", last)
    t = t.withColumn("looming_center_mm_x", F.try_element_at("looming_center_mm", F.lit(1))).withColumn("looming_center_mm_y", F.try_element_at("looming_center_mm", F.lit(2)))
    t = t.withColumns({c: list_key(F.col(c)) for c in ("foreground_color", "background_color")})
    w = Window.partitionBy(*keys).orderBy(position)
    t = t.withColumn("stim_start_time", 1e-9 * (F.col("start") - F.first("start").over(w)))
    condition = F.lit(None).cast("string")
    for name, column in CONDITION_OF.items():
        condition = F.when(F.col("stim_select") == STIM_ID[name], F.col(column).cast("string")).otherwise(condition)
    return numbered(t.withColumn("condition", F.nullif(condition, F.lit("NaN"))), [*keys, "stim_select"], "condition", [position])


def bouts_in(bouts: DataFrame, trials: DataFrame, keys: list[str], start: str, stop: str, width: float | None = None) -> DataFrame:
    """Bouts strictly inside a trial; one that crosses a trial's end is lost."""
    return contained(bouts, trials, keys, start, stop, "start", "stop", width)


def previous_end(bouts: DataFrame, trial: list[str], order: list[str], end: str, first=0, name: str = "off_previous") -> DataFrame:
    """The end of the bout before in the same trial; ``first`` for a trial's first bout (None: NULL)."""
    before = F.lag(end).over(Window.partitionBy(*trial).orderBy(*order))
    return bouts.withColumn(name, before if first is None else F.coalesce(before, F.lit(first)))
