"""Dimensions: stimuli, bout categories, sides, and which parameter tells a stimulus's conditions apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STIMULI = "DARK BRIGHT PHOTOTAXIS OMR OKR LOOMING PREY_CAPTURE CONCENTRIC_GRATING DOT IMAGE RAMP TURING".split()
STIM_ID = {name: n for n, name in enumerate(STIMULI)}
CATEGORIES = "AS S1 S2 SCS LCS BS JT HAT RT SAT O LLC SLC".split()
SIDES = {-1: "LEFT", 1: "RIGHT"}
#: The condition column of each stimulus that has conditions; the other stimuli make no trials.
CONDITION_OF = dict(zip("DARK BRIGHT PHOTOTAXIS OMR OKR LOOMING PREY_CAPTURE".split(), "background_color foreground_color phototaxis_polarity omr_angle_deg okr_speed_deg_per_sec looming_center_mm_x prey_arc_start_deg".split()))
#: Parameters that a stimulus log may hold, all double but for the arrays.
PARAMETERS = (
    "start_time_sec ramp_type ramp_powerlaw_exponent ramp_duration_sec prey_trajectory_radius_mm prey_speed_mm_s prey_speed_deg_s prey_radius_mm "
    "prey_capture_type prey_arc_stop_deg prey_arc_start_deg phototaxis_polarity omr_speed_mm_per_sec omr_spatial_period_mm omr_angle_deg "
    "okr_speed_deg_per_sec okr_spatial_frequency_deg n_preys looming_type looming_size_to_speed_ratio_ms looming_period_sec looming_expansion_time_sec "
    "looming_expansion_speed_mm_per_sec looming_expansion_speed_deg_per_sec looming_distance_to_screen_mm looming_angle_stop_deg looming_angle_start_deg"
).split()
ARRAYS = ("looming_center_mm", "foreground_color", "background_color")
TIME_TOLERANCE_S = 40.0


def stim_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, CONDITION_OF.get(s)) for s, n in STIM_ID.items()], "stim int, stim_name string, condition_column string")


def category_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "category int, bout_category string")


def side_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SIDES.items()), "sign int, side string")
