"""What the engine writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False) -> None:
    """Parquet, in a folder a partition; where the output exists it stays, unless it is to be overwritten."""
    w = df.write.mode("overwrite" if overwrite else "ignore")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """More rows for a table, in the same partitions that it was written with."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False, append: bool = False) -> None:
    """A folder of CSV files, each with a header; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("append" if append else "overwrite" if overwrite else "ignore").csv(path, header=True)


def write_lines(lines: DataFrame, path: str, head: list[str]) -> None:
    """A folder of text files, one a partition, each with the same header lines before its own rows (``value``), in the order in which they come.

    Nothing is moved or sorted, so a task holds a row at a time. One more file is the header alone: it is there without any rows too.
    """
    top = F.lit("\n".join(head))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the lower 33 bits count a partition's rows
    body = lines.select(F.when(first, F.concat(top, F.lit("\n"), "value")).otherwise(F.col("value")).alias("value"))
    body.unionAll(lines.sparkSession.range(0, 1, 1, 1).select(top.alias("value"))).write.option("maxRecordsPerFile", 0).text(path)  # a file that is cut would go on without a header


def split_by_roi(tracking: DataFrame, rois: DataFrame, x_suffix: str = "_x", y_suffix: str = "_y") -> DataFrame:
    """Every animal's rows with coordinates from its own rectangle's corner; ``rois`` is (file, identity, x, y)."""
    d = tracking.join(rois.select("file", "identity", F.col("x").alias("_rx"), F.col("y").alias("_ry")), ["file", "identity"])
    moved = [(F.col(c) - F.col("_rx")).alias(c) if c.endswith(x_suffix) else (F.col(c) - F.col("_ry")).alias(c) if c.endswith(y_suffix) else F.col(c) for c in tracking.columns]
    return d.select(*moved)


def rois_of(metadata: DataFrame) -> DataFrame:
    """(file, identity, x, y, w, h): one row a rectangle."""
    e = metadata.select("file", F.posexplode("identity.ROIs").alias("identity", "r"))
    return e.select("file", "identity", *(F.col("r")[n].alias(c) for n, c in enumerate("xywh")))


def animal_metadata(metadata: DataFrame) -> DataFrame:
    """One row an animal: the experiment's metadata with its own rectangle and number."""
    r = rois_of(metadata)
    return metadata.drop("identity").join(r, "file").withColumn("fish_ID", F.col("identity"))


def per_roi(df: DataFrame, rois: DataFrame) -> DataFrame:
    """Rows of the whole experiment once for each of its animals."""
    return df.join(rois.select("file", "identity"), "file")


def export(tables: dict[str, DataFrame], folder: str, wanted: list[str] | None = None, overwrite: bool = False) -> None:
    """Write the wanted tables of an experiment (all without a list), by animal where they have one."""
    for name, df in tables.items():
        if wanted is None or name in wanted:
            write_table(df, f"{folder}/{name}", ["identity"] if "identity" in df.columns else None, overwrite)
