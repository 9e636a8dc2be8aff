"""State of a stimulus at a time into its trial, as columns.

Times are seconds.  ``start`` is when the display's clock read at the trial's
begin, ``trial`` the time into the trial; the clock rolls over.  Phases of
gratings and prey follow the recorded convention, (phase mod 2) * pi;
``corrected=True`` gives phase mod 2 pi.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .geometry import clamp, floor_mod, num

ROLLOVER = 3600.0


def display_time(start, trial, rollover=ROLLOVER) -> Column:
    return floor_mod(num(trial) + num(start), rollover)


def display_trial_time(start, trial, rollover=ROLLOVER) -> Column:
    return display_time(start, trial, rollover) - num(start)


def constant(start, trial, rollover=ROLLOVER) -> Column:
    """Dark, bright and phototaxis stimuli do not change."""
    return F.lit(0.0)


def wrapped_phase(phase: Column, corrected: bool) -> Column:
    return floor_mod(phase, 2 * math.pi) if corrected else floor_mod(phase, 2.0) * math.pi


def ramp(start, trial, duration, rollover=ROLLOVER) -> Column:
    t = floor_mod(display_trial_time(start, trial, rollover), duration)
    return clamp(F.try_divide(t, num(duration)), 0.0, 1.0)


def grating_phase(start, trial, speed_mm, period_mm, rollover=ROLLOVER, corrected: bool = False) -> Column:
    return wrapped_phase(F.try_divide(num(speed_mm), num(period_mm)) * display_time(start, trial, rollover), corrected)


def rotation_phase(start, trial, speed_deg, rollover=ROLLOVER, corrected: bool = False) -> Column:
    return wrapped_phase(F.radians(num(speed_deg)) * display_time(start, trial, rollover), corrected)


def _expanding(start, trial, period, expansion, rollover) -> tuple[Column, Column]:
    t = floor_mod(display_trial_time(start, trial, rollover), period)
    return t, t <= num(expansion)


def looming_linear_radius(start, trial, period, expansion, speed_mm, rollover=ROLLOVER) -> Column:
    t, on = _expanding(start, trial, period, expansion, rollover)
    return F.when(on, num(speed_mm) * t).otherwise(t * 0.0)


def looming_linear_angle(start, trial, period, expansion, speed_deg, screen_mm, rollover=ROLLOVER) -> Column:
    t, on = _expanding(start, trial, period, expansion, rollover)
    return num(screen_mm) * F.tan(F.when(on, F.radians(num(speed_deg)) * t).otherwise(t * 0.0) / 2)


def looming_constant_velocity(start, trial, from_deg, to_deg, size_to_speed_ms, screen_mm, rollover=ROLLOVER) -> Column:
    ratio = num(size_to_speed_ms)
    first, last = (F.try_divide(ratio, F.tan(F.radians(num(d)) / 2)) for d in (from_deg, to_deg))
    t = floor_mod(1000 * display_trial_time(start, trial, rollover), first - last)
    return F.try_divide(num(screen_mm) * ratio, first - t)


def prey_phase(start, trial, from_deg, to_deg, speed_deg, rollover=ROLLOVER, corrected: bool = False) -> Column:
    per_second = F.try_divide(F.radians(num(speed_deg)), 2 * F.abs(F.radians(num(to_deg)) - F.radians(num(from_deg))))
    return wrapped_phase(2 * per_second * display_trial_time(start, trial, rollover), corrected)


def prey_angle(start, trial, from_deg, to_deg, speed_deg, rollover=ROLLOVER) -> Column:
    a, b = F.radians(num(from_deg)), F.radians(num(to_deg))
    period = F.try_divide(F.abs(b - a), F.radians(num(speed_deg)))
    return a + (b - a) * F.try_divide(floor_mod(display_trial_time(start, trial, rollover), period), period)


#: Values where the log leaves a parameter out, by stimulus.
DEFAULTS = {
    "OMR": {"omr_spatial_period_mm": 10.0, "omr_angle_deg": 90.0, "omr_speed_mm_per_sec": 10.0},
    "OKR": {"okr_speed_deg_per_sec": 0.0, "okr_spatial_frequency_deg": 1.0},
    "PHOTOTAXIS": {"phototaxis_polarity": 1.0},
    "LOOMING": {"looming_distance_to_screen_mm": 100.0, "looming_size_to_speed_ratio_ms": 1.0, "looming_angle_stop_deg": 90.0, "looming_angle_start_deg": 0.0, "looming_expansion_speed_deg_per_sec": 0.0, "looming_expansion_speed_mm_per_sec": 0.0, "looming_expansion_time_sec": 0.5, "looming_period_sec": 1.0, "looming_type": 0.0},
    "TURING": {"turing_n_waves": 1.0, "turing_speed_mm_per_sec": 0.0, "turing_angle_deg": 0.0, "turing_spatial_period_mm": 10.0},
    "CONCENTRIC_GRATING": {"concentric_speed_mm_per_sec": 0.0, "concentric_spatial_period_mm": 10.0},
    "DOT": {"dot_radius_mm": 1.0},
    "IMAGE": {"image_res_px_per_mm": 10.0},
    "RAMP": {"ramp_type": 0.0, "ramp_powerlaw_exponent": 1.0, "ramp_duration_sec": 1.0},
    "PREY_CAPTURE": {"prey_arc_stop_deg": 360.0, "prey_arc_start_deg": 0.0, "prey_arc_phase_deg": 0.0, "prey_speed_deg_s": 0.0, "prey_speed_mm_s": 0.0, "prey_trajectory_radius_mm": 5.0, "prey_radius_mm": 1.0, "n_preys": 0.0, "prey_capture_type": 0.0, "prey_periodic_function": 0.0},
}


def with_defaults(columns: list[str], stim: Column, ids: dict[str, int]) -> list[Column]:
    """Each parameter column, filled by its stimulus's default and NULL for other stimuli; other columns as they are."""
    out = []
    for c in columns:
        of = [(s, d[c]) for s, d in DEFAULTS.items() if c in d]
        out.append(F.when(stim == ids[of[0][0]], F.coalesce(F.col(c), F.lit(of[0][1]))).alias(c) if of else F.col(c))
    return out
