"""Datasets put together and set against their control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .frequency import not_nan


def union_strict(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames that have the same columns in the same order; else an error names the difference."""
    first = frames[0]
    for f in frames[1:]:
        if f.columns != first.columns:
            raise ValueError(f"Columns differ: {first.columns} and {f.columns}")
    return union_outer(frames)


def union_outer(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames, columns that one lacks NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def trial_average(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of the values over everything but the keys; missing values do not count."""
    return df.groupBy(*keys).agg(*(F.avg(not_nan(F.col(v).cast("double"))).alias(v) for v in values))


def control_mean(df: DataFrame, control: Column, keys: list[str], value: str, name: str = "control") -> DataFrame:
    """The control rows' mean by keys; a NaN among them makes it NaN."""
    return df.where(F.coalesce(control, F.lit(False))).groupBy(*keys).agg(F.avg(value).alias(name))


def baseline_delta(df: DataFrame, control: Column, keys: list[str], value: str, delta: str = "delta") -> DataFrame:
    """Every row with its control mean and its difference from it; NULL where the control has no such group.

    The planner broadcasts the control means when they are measured to be small
    and joins by key otherwise.
    """
    base = control_mean(df, control, keys, value)
    return df.join(base, keys, "left").withColumn(delta, F.col(value) - F.col("control"))


def without_control(df: DataFrame, control: Column) -> DataFrame:
    """Rows that are known not to be control rows: an unknown condition goes, as the comparison is unknown."""
    return df.where(~control)


def split_treated(df: DataFrame, condition: str, untreated: str) -> tuple[DataFrame, DataFrame]:
    """(untreated, treated); rows without a condition are in neither."""
    return df.where(F.col(condition) == untreated), df.where(F.col(condition) != untreated)


def count_by(df: DataFrame, keys: list[str], hit: Column, name: str = "n") -> DataFrame:
    """How many rows of each group meet a condition."""
    return df.groupBy(*keys).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias(name))


def in_order_of_appearance(df: DataFrame, column: str, position: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(position).alias("first_at")).orderBy("first_at", column)


def evenly_spaced(df: DataFrame, position: str, n_rows: int, n: int) -> DataFrame:
    """n rows evenly spread over positions 0 .. n_rows - 1, both ends among them."""
    at = [int(i * (n_rows - 1) / max(1, n - 1)) for i in range(n)]
    return df.where(F.col(position).isin(at))
