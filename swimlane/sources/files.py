"""Files of an experiment: their names, which belong together, and their tables, all with declared schemas."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.text import name_pattern, name_time, parse_name
from ..operators.compare import union_outer
from ..plans.dims import ARRAYS, PARAMETERS, TIME_TOLERANCE_S

#: role: (prefix, extension, required)
ROLES = {
    "metadata": ("", "metadata", True),
    "stimuli": ("stim_", "json", True),
    "tracking": ("tracking_", "csv", True),
    "temperature": ("temperature_", "csv", False),
    "video": ("", "mp4", False),
    "pose": ("", "csv", False),
    "eyes": ("eyes_", "csv", False),
    "video_timestamps": ("", "csv", False),
}
METADATA = "calibration struct<pix_per_mm: double>, camera struct<framerate_value: double, height_value: int, width_value: int>, identity struct<ROIs: array<array<int>>>, settings struct<tracking: struct<n_tail_pts_interp: int>>, export struct<fish_ID: int>"
STIMULI = "timestamp long, stim_select int, " + ", ".join(f"{c} array<double>" for c in ARRAYS) + ", " + ", ".join(f"{c} double" for c in PARAMETERS)
TRACKING = "index long, timestamp long, identity int, " + ", ".join(f"{p}_{a} double" for p in ("centroid", "pc1", "pc2", "left_eye", "right_eye") for a in "xy")
TIMESTAMPS = "index long, timestamp long"


def file_stem(path: Column) -> Column:
    """The name of a path's last part without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")  # one pass: it may be taken for every row


def with_file(df: DataFrame, prefix: str = "") -> DataFrame:
    """``file``: the stem of the file each row comes from, less its role's prefix."""
    stem = file_stem(F.col("_metadata.file_path"))
    return df.withColumn("file", F.regexp_replace(stem, "^" + re.escape(prefix), "") if prefix else stem)


def named(paths: DataFrame, role: str, path: str = "path") -> DataFrame:
    """(path, name, time) of a role's files; names that do not fit are in ``rejected``."""
    prefix, extension, _ = ROLES[role]
    base = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    n = parse_name(base, name_pattern(prefix, extension))
    return paths.select(F.col(path).alias("path"), n.alias("name")).where("name is not null").withColumn("time", name_time(F.col("name")))


def rejected(paths: DataFrame, role: str, path: str = "path") -> DataFrame:
    prefix, extension, _ = ROLES[role]
    return paths.where(parse_name(F.regexp_extract(F.col(path), r"([^/]+)$", 1), name_pattern(prefix, extension)).isNull())


def matches(a: DataFrame, b: DataFrame, tolerance: float | None = TIME_TOLERANCE_S) -> DataFrame:
    """Pairs of files of the same animal, age, line, day and extra, at most so many seconds apart: (path, other, seconds)."""
    key = lambda d: d.select("path", "time", *(F.col("name")[f].alias(f) for f in ("fish_id", "age", "line", "day", "year", "extra")), F.month("time").alias("month"))
    x, y = key(a).alias("x"), key(b).alias("y")
    same = F.lit(True)
    for f in ("fish_id", "age", "line", "day", "month", "year"):
        same = same & (F.col(f"x.{f}") == F.col(f"y.{f}"))
    same = same & F.col("x.extra").eqNullSafe(F.col("y.extra"))
    gap = F.abs(F.expr("timestampdiff(SECOND, y.time, x.time)"))
    out = x.join(y, same).select(F.col("x.path").alias("path"), F.col("y.path").alias("other"), gap.alias("seconds"))
    return out if tolerance is None else out.where(F.col("seconds") <= tolerance)


def find(a: DataFrame, b: DataFrame, tolerance: float = TIME_TOLERANCE_S) -> DataFrame:
    """Each file of the first frame with its nearest match (``other``), the first by path among equals; NULL without one."""
    w = Window.partitionBy("path").orderBy("seconds", "other")
    best = matches(a, b, tolerance).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "other")
    return a.select("path").join(best, "path", "left")


def assemble(by_role: dict[str, DataFrame]) -> DataFrame:
    """(metadata, one column a role): every metadata file with its match in each role's files."""
    main = by_role["metadata"]
    out = main.select("path")
    for role, files in by_role.items():
        if role != "metadata":
            out = out.join(find(main, files).withColumnRenamed("other", role), "path", "left")
    return out.withColumnRenamed("path", "metadata")


def missing(assembled: DataFrame) -> DataFrame:
    """Rows that lack a required file."""
    need = F.lit(False)
    for role, (_, _, required) in ROLES.items():
        if required and role in assembled.columns:
            need = need | F.col(role).isNull()
    return assembled.where(need)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path) of a folder's files, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def read_metadata(spark: SparkSession, path) -> DataFrame:
    return with_file(spark.read.schema(METADATA).json(path, multiLine=True))


def placed_lines(spark: SparkSession, path) -> DataFrame:
    """(path, position, line): lines of text files with their place in their file, from 0.

    Lines are counted as tasks read them, in each part of a file, and the lines of its earlier parts added: no task holds a file, and no line is moved.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, n = None, 0  # the part that the last line was in, and its lines so far
        for b in batches:
            if not b.num_rows:
                continue
            i, begins = np.arange(b.num_rows), np.ones(b.num_rows, bool)
            begins[0] = at != (b["path"][0].as_py(), b["part"][0].as_py())
            begins[1:] = pc.or_(*(pc.not_equal(b[c][1:], b[c][:-1]) for c in ("path", "part"))).to_numpy(zero_copy_only=False)
            place = i - np.maximum.accumulate(np.where(begins, i, -n))
            at, n = (b["path"][-1].as_py(), b["part"][-1].as_py()), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=[*b.schema.names, "place"])

    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), "value")
    lines = read.mapInArrow(count, "path string, part long, value string, place long")
    above = F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = read.groupBy("path", "part").agg(F.count("*").alias("n")).withColumn("above", above).where("part > 0").select("path", "part", "above")
    # a row for each part of a file but its first, most files have but one
    out = lines.join(F.broadcast(later), ["path", "part"], "left")
    return out.select("path", (F.col("place") + F.coalesce("above", F.lit(0))).cast("int").alias("position"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def read_stimuli(spark: SparkSession, path) -> DataFrame:
    """JSON lines with ``position``, a line's place in its file."""
    lines = placed_lines(spark, path).where("trim(line) <> ''").withColumn("file", F.regexp_replace(file_stem(F.col("path")), "^stim_", ""))
    return lines.select("file", "position", F.from_json("line", STIMULI).alias("s")).select("file", "position", "s.*")


def present(spark: SparkSession, path) -> list[str]:
    """Files and folders that a path, or several, of any file system means; patterns are allowed."""
    out, jvm = [], spark._jvm
    for p in [path] if isinstance(path, str) else path or []:
        at = jvm.org.apache.hadoop.fs.Path(p)
        out += [x.getPath().toString() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    return sorted(out)


def _by_header(spark: SparkSession, heads: DataFrame) -> list[tuple[list, list[str]]]:
    """Distinct headers of (path, head) with the files that have them; as many rows as there are kinds of files."""
    plain = lambda p: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(p)).toString()  # noqa: E731  names are escaped in metadata
    rows = heads.groupBy("head").agg(F.sort_array(F.collect_set("path")).alias("paths")).orderBy("head").collect()
    return [(r["head"], [plain(p) for p in r.paths]) for r in rows]


def _first_lines(spark: SparkSession, path) -> DataFrame:
    """(path, head): each file's first line, from the part of the file that holds it."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value").withColumn("nth", F.monotonically_increasing_id())
    return lines.where("file_block_start = 0").groupBy(F.col("file_path").alias("path")).agg(F.min_by("value", "nth").alias("head"))


def _names(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")]), [])


def read_csv(spark: SparkSession, path, schema: str, prefix: str = "") -> DataFrame:
    """CSV files with a header, columns found by name in each file, in the schema's order; ones that the schema lacks are left out, ones that a file lacks are NULL."""
    kinds = dict(x.strip().split(" ", 1) for x in schema.split(","))
    parts = []
    for head, paths in _by_header(spark, _first_lines(spark, path)):
        header = [n if n in kinds else f"_unused_{i}" for i, n in enumerate(_names(head))]
        typed = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
        part = with_file(spark.read.schema(typed).csv(paths, header=True, nanValue="nan"), prefix)
        parts.append(part.select("file", *[c for c in kinds if c in header]))
    if not parts:
        return spark.createDataFrame([], f"file string, {schema}")
    out = union_outer(parts)
    return out.select("file", *[c for c in kinds if c in out.columns])


def read_tracking(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, TRACKING, "tracking_")


def read_timestamps(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, TIMESTAMPS)


def read_temperature(spark: SparkSession, path: str | None) -> DataFrame:
    """Its columns as text; an empty frame without a file."""
    parts = []
    for head, paths in _by_header(spark, _first_lines(spark, path)) if present(spark, path) else []:
        typed = ", ".join(f"`{c}` string" for c in _names(head))
        parts.append(with_file(spark.read.schema(typed).csv(paths, header=True), "temperature_"))
    return union_outer(parts) if parts else spark.createDataFrame([], "file string")


def read_pose(spark: SparkSession, path: str | None, points: list[str], prefix: str = "") -> DataFrame:
    """(file, frame, <point>_<x|y|likelihood>): CSV files with three header rows (scorer, point, coordinate), columns found by name in each file; an empty frame without a file.

    Where several scorers have a point, its last columns count.
    """
    wide = [f"{p}_{c}" for p in points for c in ("x", "y", "likelihood")]
    if not present(spark, path):
        return spark.createDataFrame([], "file string, frame long, " + ", ".join(f"`{c}` double" for c in wide))
    # header rows are known by their first field, wherever a split of the file begins
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").rlike("^(bodyparts|coords),"))
    row = lambda k: F.max(F.when(F.col("value").startswith(k), F.col("value"))).alias(k)
    heads = lines.groupBy("path").agg(row("bodyparts"), row("coords")).select("path", F.array("bodyparts", "coords").alias("head"))
    parts = []
    for head, paths in _by_header(spark, heads):
        if None in head:
            raise ValueError(f"Not a pose table: {paths[0]}")
        names = [f"{p}_{c}" for p, c in zip(*(_names(x)[1:] for x in head))]
        last = {n: i for i, n in enumerate(names)}
        raw = spark.read.schema("frame string, " + ", ".join(f"`{i}` string" for i in range(len(names)))).csv(paths)
        number = lambda c, last=last: F.expr(f"try_cast(`{last[c]}` AS double)") if c in last else F.lit(None).cast("double")
        body = with_file(raw, prefix).where(F.col("frame").rlike(r"^\d+$"))
        parts.append(body.select("file", F.col("frame").cast("long").alias("frame"), *(number(c).alias(c) for c in wide)))
    if not parts:
        raise ValueError(f"Not a pose table: {path}")
    return union_outer(parts)


def read_datasets(spark: SparkSession, root: str, name: str = "bout_frequency.csv", schema: str | None = None) -> DataFrame:
    """Every file of one name below ``root/<line>/<condition>/``, with both parts of its path as columns."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(root, header=True)
    parts = F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 2)
    return df.select("*", F.element_at(parts, 1).alias("line"), F.element_at(parts, 2).alias("condition"))


def read_bouts(spark: SparkSession, path: str) -> DataFrame:
    """A bout table, as Parquet or CSV."""
    return spark.read.option("inferSchema", True).csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)


def user_labelled(frames: DataFrame, instances: str = "instances") -> DataFrame:
    """Frames that hold an instance which was not predicted."""
    return frames.where(F.exists(instances, lambda i: ~i["predicted"]))


def first_is_user(frames: DataFrame, instances: str = "instances") -> DataFrame:
    """Frames whose first instance was not predicted."""
    return frames.where(~F.try_element_at(instances, F.lit(1))["predicted"])


def first_user_instance(frames: DataFrame, instances: str = "instances") -> DataFrame:
    """Each frame's first instance that was not predicted, with its points; NaN coordinates as 0."""
    i = F.try_element_at(F.filter(instances, lambda i: ~i["predicted"]), F.lit(1))
    d = user_labelled(frames, instances).withColumn("_i", i)
    return d.select(*[c for c in frames.columns if c != instances], F.transform("_i.points", lambda p: F.struct(F.nanvl(p["x"], F.lit(0.0)).alias("x"), F.nanvl(p["y"], F.lit(0.0)).alias("y"))).alias("points"))


def labelled_suggestions(suggestions: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    return suggestions.join(frames.select(*keys).distinct(), keys, "left_semi")


def load(spark: SparkSession, files: dict[str, str | None], points: list[str] = [], eye_points: list[str] = []) -> dict[str, DataFrame]:  # noqa: B006
    """All tables of an experiment from its files by role (as a row of ``assemble`` names them, or patterns over many experiments); a required one that is not there is an error."""
    lacking = [r for r, (_, _, required) in ROLES.items() if required and not present(spark, files.get(r))]
    if lacking:
        raise FileNotFoundError(f"No file for {', '.join(lacking)}")
    out = {"metadata": read_metadata(spark, files["metadata"]), "stimuli": read_stimuli(spark, files["stimuli"]), "tracking": read_tracking(spark, files["tracking"])}
    out |= {"temperature": read_temperature(spark, files.get("temperature")), "pose": read_pose(spark, files.get("pose"), points), "eyes": read_pose(spark, files.get("eyes"), eye_points, "eyes_")}
    if present(spark, files.get("video_timestamps")):
        out["video_timestamps"] = read_timestamps(spark, files["video_timestamps"])
    return out


def register(tables: dict[str, DataFrame]) -> None:
    """The tables of an experiment as temporary views, for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
