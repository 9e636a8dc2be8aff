"""Kinematics and quality control of each bout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.geometry import angle_error, distance
from ..functions.stimulus import prey_phase
from ..plans.dims import STIM_ID
from .joins import as_of, points_in
from .trials import bouts_in, previous_end


def signed_peak(value: Column, order: Column, where: Column | None = None) -> Column:
    """Aggregate: the value of the greatest magnitude with its sign; the first in order among equals, and a NaN before all."""
    rank = F.struct(F.abs(value).alias("a"), (-order).alias("o"))
    return F.max_by(value, rank if where is None else F.when(where & value.isNotNull(), rank))


def mean_over(total: Column, length: Column) -> Column:
    """Aggregate: a sum by a window's nominal length, not by the rows there."""
    return F.try_divide(F.sum(total), length)


def centroid_error(online_x, online_y, posthoc_x, posthoc_y) -> Column:
    return distance(online_x, online_y, posthoc_x, posthoc_y)


def quality(error: Column, length: Column, prefix: str, limit: float | None = None, flag: str = "heading_flip") -> list[Column]:
    """Aggregates of a per-frame error: mean over the window's length, maximum, and whether it ever passed a limit (NaN does not)."""
    out = [mean_over(error, length).alias(f"{prefix}_avg"), F.max(error).alias(f"{prefix}_max")]
    return out if limit is None else [*out, F.coalesce(F.bool_or((error > limit) & ~F.isnan(error)), F.lit(False)).alias(flag)]


def path_length(step: Column, where: Column) -> Column:
    """Aggregate: the steps' sum; 0 without any."""
    return F.coalesce(F.sum(F.when(where, step)), F.lit(0.0))


def probability(bouts: DataFrame, proba: DataFrame, keys: list[str] = ["file", "bout_index"]) -> DataFrame:  # noqa: B006
    """Each bout with the probability of its category, by its number; NULL where none is known."""
    return bouts.drop("proba").join(proba.select(*keys, "proba"), keys, "left")


def ethogram(frames: DataFrame, bouts: DataFrame, bucket: int = 256) -> DataFrame:
    """(file, frame, category, sign): every frame with the bout [onset, offset) that it lies in, the one of the latest onset where several do; NULL between bouts."""
    ids = frames.select("file", "frame")
    met = points_in(ids, bouts.select("file", "onset", "offset", "category", "sign"), ["file"], "frame", "onset", "offset", bucket)
    last = met.groupBy("file", "frame").agg(F.max(F.struct("onset", "category", "sign")).alias("_b"))
    return ids.join(last, ["file", "frame"], "left").select("file", "frame", F.col("_b.category").alias("category"), F.col("_b.sign").alias("sign"))


def metrics(segments: DataFrame, traj: DataFrame, trials: DataFrame, online: DataFrame, posthoc: DataFrame, wells: DataFrame, info: DataFrame, rollover: float = 3600.0, bucket: int = 256, first_previous: int | None = 0) -> DataFrame:
    """One row for every bout inside a trial.

    ``segments`` (file, bout_index, onset, offset, category, sign, proba); ``traj``
    (file, frame, timestamp, x_smooth, y_smooth, yaw_smooth, axial_speed, yaw_speed);
    ``trials`` as of ``trials.from_log``; ``online`` (file, frame, centroid_x,
    centroid_y, pc1_x, pc1_y); ``posthoc`` (file, frame, bladder_x, bladder_y,
    head_x, head_y); ``wells`` (file, cx_mm, cy_mm); ``info`` (file, fps).

    Everything is keyed by file.  Frames meet bouts once, by file and bucket of
    frames, and one aggregate makes every per-bout figure; a trial's first bout, whose quality window
    begins at frame 0, looks its quality up in running figures instead of meeting every frame.
    """
    at = traj.select("file", "frame", "timestamp", "x_smooth", "y_smooth", "yaw_smooth")
    on = at.select("file", F.col("frame").alias("onset"), F.col("timestamp").alias("t_on"), F.col("x_smooth").alias("x_on"), F.col("y_smooth").alias("y_on"), F.col("yaw_smooth").alias("yaw_on"))
    off = at.select("file", F.col("frame").alias("offset"), F.col("timestamp").alias("t_off"), F.col("yaw_smooth").alias("yaw_off"))
    zero = at.groupBy("file").agg(F.min_by("timestamp", "frame").alias("t_zero"))
    b = segments.join(on, ["file", "onset"]).join(off, ["file", "offset"])
    b = bouts_in(b, trials.drop("timestamp"), ["file"], "t_on", "t_off")
    b = previous_end(b, ["file", "stim_select", "condition", "trial_num"], ["onset", "bout_index"], "offset", first_previous)

    w = Window.partitionBy("file").orderBy("frame")
    frames = traj.withColumn("step", distance("x_smooth", "y_smooth", F.lag("x_smooth").over(w), F.lag("y_smooth").over(w)))
    frames = frames.select("file", "frame", "step", "axial_speed", "yaw_speed").join(online, ["file", "frame"], "left").join(posthoc, ["file", "frame"], "left")
    frames = frames.withColumn("centroid_error", centroid_error("centroid_x", "centroid_y", "bladder_x", "bladder_y"))
    frames = frames.withColumn("heading_error", angle_error("pc1_x", "pc1_y", F.col("head_x") - F.col("bladder_x"), F.col("head_y") - F.col("bladder_y")))
    frames = frames.select("file", "frame", "step", "axial_speed", "yaw_speed", "centroid_error", "heading_error")

    ids = ["file", "bout_index", "stim_select", "condition", "trial_num"]
    span = b.select(*ids, "onset", "offset", F.coalesce("off_previous", F.lit(0)).alias("window_start"))
    # a window from frame 0 on is every frame before it: its figures are running ones, looked up at its last frame
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    errors = ("centroid_error", "heading_error")
    over_limit = (F.col("heading_error") > 160.0) & ~F.isnan("heading_error")
    running = frames.select("file", "frame", *(F.sum(e).over(upto).alias(f"{e}_sum") for e in errors), *(F.max(e).over(upto).alias(f"{e}_max") for e in errors), F.max(F.coalesce(over_limit, F.lit(False))).over(upto).alias("flip"))
    whole = as_of(span.where("window_start = 0").withColumn("last", F.col("offset") - 1), running, ["file"], "last", "frame", [c for c in running.columns if c not in ("file", "frame")])
    whole = whole.select(*ids, *(x for e, name in zip(errors, ("centroid_mismatch", "heading_mismatch")) for x in (F.try_divide(F.col(f"{e}_sum"), F.col("offset")).alias(f"{name}_avg"), F.col(f"{e}_max").alias(f"{name}_max"))), F.coalesce("flip", F.lit(False)).alias("heading_flip"))

    met = points_in(frames, span.withColumn("from", F.when(F.col("window_start") == 0, F.col("onset")).otherwise(F.col("window_start"))), ["file"], "frame", "from", "offset", bucket)
    own, length = F.col("frame") >= F.col("onset"), F.first(F.col("offset") - F.col("window_start"))
    per = met.groupBy(*ids).agg(
        path_length(F.col("step"), F.col("frame") > F.col("onset")).alias("distance"),
        signed_peak(F.col("axial_speed"), F.col("frame"), own).alias("peak_axial_speed"),
        signed_peak(F.col("yaw_speed"), F.col("frame"), own).alias("peak_yaw_speed"),
        *quality(F.col("centroid_error"), length, "centroid_mismatch"),
        *quality(F.col("heading_error"), length, "heading_mismatch", 160.0),
        F.first("window_start").alias("window_start"),
    )
    kept = ("distance", "peak_axial_speed", "peak_yaw_speed")
    figures = ["centroid_mismatch_avg", "centroid_mismatch_max", "heading_mismatch_avg", "heading_mismatch_max", "heading_flip"]
    first = F.col("window_start") == 0
    per = per.join(whole.select(*[F.col(i).alias(f"_{i}") for i in ids], *[F.col(c).alias(f"_{c}") for c in figures]), [F.col(i).eqNullSafe(F.col(f"_{i}")) for i in ids], "left")
    per = per.select(*ids, *kept, *(F.when(first, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in figures))
    out = b.join(per, ids, "left").join(zero, "file").join(wells.select("file", "cx_mm", "cy_mm"), "file", "left").join(info.select("file", "fps"), "file")
    seconds = lambda c: 1e-9 * (F.col(c) - F.col("t_zero"))
    out = out.withColumn("trial_time", 1e-9 * (F.col("t_on") - F.col("start")))
    phase = F.when(F.col("stim_select") == STIM_ID["PREY_CAPTURE"], prey_phase("start_time_sec", "trial_time", "prey_arc_start_deg", "prey_arc_stop_deg", "prey_speed_deg_s", rollover))
    out = out.withColumns({
        "frame_start": F.col("onset"), "frame_stop": F.col("offset"), "time_start": seconds("t_on"), "time_stop": seconds("t_off"), "stim": F.col("stim_select"),
        "heading_change": F.col("yaw_off") - F.col("yaw_on"), "distance_center": distance("x_on", "y_on", "cx_mm", "cy_mm"),
        "bout_duration": (F.col("offset") - F.col("onset")) / F.col("fps"), "interbout_duration": (F.col("onset") - F.col("off_previous")) / F.col("fps"), "stim_phase": phase,
    })
    drop = {"onset", "offset", "t_on", "t_off", "x_on", "y_on", "yaw_on", "yaw_off", "t_zero", "cx_mm", "cy_mm", "fps", "off_previous", "start", "stop", "last", "looming_center_mm", "position", "stim_select"}
    return out.drop(*drop)
