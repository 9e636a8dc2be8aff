"""Transitions between successive bout categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def pairs(df: DataFrame, keys: list[str], order: list[str], category: str) -> DataFrame:
    """(keys, src, dst): each category and the next one of the same keys."""
    nxt = F.lead(category).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, F.col(category).alias("src"), nxt.alias("dst")).where("dst is not null and src is not null")


def counts(df: DataFrame, keys: list[str], order: list[str], category: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return pairs(df, keys, order, category).groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))


def probabilities(n: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts by row sums; categories nothing follows have no row."""
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "src")))


def stationary(p: DataFrame, categories: list, rounds: int = 10_000, eps: float = 1e-13) -> DataFrame:
    """(category, weight): the distribution that the transitions leave as it is, by power iteration on the driver; the matrix has one row a category."""
    import numpy as np

    at = {c: i for i, c in enumerate(categories)}
    m = np.zeros((len(at), len(at)))
    for r in p.where(F.col("src").isin(list(at)) & F.col("dst").isin(list(at))).select("src", "dst", "p").collect():
        m[at[r.src], at[r.dst]] = r.p
    empty = m.sum(axis=1) == 0
    m[empty, empty] = 1.0
    m = (m + np.eye(len(at))) / 2  # the same fixed point, and no cycles
    v = np.full(len(at), 1 / len(at))
    for _ in range(rounds):
        w = v @ m
        if abs(w - v).max() < eps:
            break
        v = w
    kind = "int" if isinstance(categories[0], int) else "string"
    return p.sparkSession.createDataFrame([(c, float(v[i])) for c, i in at.items()], f"category {kind}, weight double")


def graph_edges(p: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges (src, dst, weight) above a weight."""
    return p.where(F.col("p") > least).select("src", "dst", F.col("p").alias("weight"))
