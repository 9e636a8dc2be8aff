"""Angles, distances, units and interpolation weights as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def num(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def angle_between(x1, y1, x2, y2) -> Column:
    """Signed angle from the first vector to the second, in radians."""
    a, b, c, d = map(num, (x1, y1, x2, y2))
    return F.atan2(a * d - b * c, a * c + b * d)


def eye_angle(front_x, front_y, back_x, back_y, axis_x=0.0, axis_y=1.0, valid: Column | None = None) -> Column:
    """Degrees between an eye's back-to-front vector and the body axis; NULL where not valid."""
    a = F.degrees(angle_between(num(front_x) - num(back_x), num(front_y) - num(back_y), axis_x, axis_y))
    return a if valid is None else F.when(valid, a)


def angle_error(x1, y1, x2, y2) -> Column:
    """Degrees between two headings: the first as given, the second made a unit vector; NaN for a zero vector, NULL for a missing one."""
    a, b, c, d = map(num, (x1, y1, x2, y2))
    norm = F.sqrt(c * c + d * d)
    dot = F.when(norm == 0, F.lit(math.nan)).otherwise(F.try_divide(a * c + b * d, norm))
    # greatest and least would take a NULL for a bound and a NaN for the upper one
    return F.when(F.isnan(dot), dot).when(dot.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(num(x1) - num(x2), 2) + F.pow(num(y1) - num(y2), 2))


def to_mm(pixels, pix_per_mm) -> Column:
    return num(pixels) / num(pix_per_mm)


def clamp(x, lo, hi) -> Column:
    return F.greatest(num(lo), F.least(num(hi), num(x)))


def floor_mod(x, m) -> Column:
    """Remainder with the divisor's sign; NULL for a zero divisor."""
    x, m = num(x), num(m)
    return F.when(m != 0, x - m * F.floor(x / F.nullif(m, F.lit(0.0))))


def mix(a, b, t) -> Column:
    return num(a) * (1 - num(t)) + num(b) * num(t)


def hash_unit(x) -> Column:
    """A number in [0, 1) that depends on x as shaders do it: the fractional part of a scaled sine."""
    s = F.sin(num(x)) * 43758.5453123
    return s - F.floor(s)


def alpha_blend(under, over, alpha) -> Column:
    return mix(under, over, alpha)


def egocentric(x, y, cx, cy, axis_x, axis_y) -> tuple[Column, Column]:
    """Coordinates along and across a heading, from a centre."""
    dx, dy, ax, ay = num(x) - num(cx), num(y) - num(cy), num(axis_x), num(axis_y)
    return dx * ax + dy * ay, dy * ax - dx * ay


def version_vergence(left, right) -> tuple[Column, Column]:
    return (num(left) + num(right)) / 2, num(right) - num(left)


def cosinor(seconds_of_day) -> tuple[Column, Column]:
    """(cos, sin) of the time of day on a 24-hour circle."""
    theta = num(seconds_of_day) * (2 * math.pi / 86400)
    return F.cos(theta), F.sin(theta)


def wrap(delta) -> Column:
    """What must be added to a step between angles so that it lies within half a turn; a step of exactly +pi stays."""
    d = num(delta)
    k = F.floor((d + math.pi) / (2 * math.pi))
    fix = -2 * math.pi * k
    return F.when((d + fix == -math.pi) & (d > 0), fix + 2 * math.pi).otherwise(fix)
