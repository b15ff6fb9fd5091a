"""Scalar expressions on flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zoneflow import texts

# Fixed values of the flow drawing: line widths, exponent, arrow position and the rounding of displayed trips.
MIN_WIDTH, WIDTH_RANGE, WIDTH_POWER = 2.0, 12.0, 1.5
ARROW_AT = 0.75
COARSE_FROM, COARSE_STEP, FINE_STEP = 10_000, 100, 10


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def width(trips: Column, largest: Column) -> Column:
    scale = F.pow(largest, F.lit(WIDTH_POWER))
    return MIN_WIDTH + F.pow(trips, F.lit(WIDTH_POWER)) / F.when(scale == 0, 1.0).otherwise(scale) * WIDTH_RANGE


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle course from the first to the second point, in [0, 360)."""
    phi1, phi2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def along(start: Column, end: Column, fraction: float = ARROW_AT) -> Column:
    return start + fraction * (end - start)


def plain_count(trips: Column) -> Column:
    return round_half_up(trips)


def rounded_count(trips: Column) -> Column:
    """Displayed trips: to the nearest 100 from 10,000 on, else to the nearest 10."""
    return F.when(trips >= COARSE_FROM, round_half_up(trips / COARSE_STEP) * COARSE_STEP).otherwise(
        round_half_up(trips / FINE_STEP) * FINE_STEP
    )


def caption(origin_label: Column, dest_label: Column, trips: Column) -> Column:
    """ "origin ← dest, N trips" with grouped thousands."""
    count = F.format_number(round_half_up(trips), 0)
    return F.concat(origin_label, F.lit(" ← "), dest_label, F.lit(", "), count, F.lit(f" {texts.TRIPS_WORD}"))


def internal_kind(between: str, within: str) -> Column:
    return F.when(F.col("origin_id") == F.col("dest_id"), within).otherwise(between)


def day_label(day: Column) -> Column:
    """Display name of a day type, the value itself if there is none."""
    names = F.create_map(*[F.lit(x) for item in texts.DAY_LABELS.items() for x in item])
    return F.coalesce(names[day], day)


def hour_label(hour_min: int, hour_max: int) -> str:
    return f"{hour_min}–{hour_max}"


def time_label(hour_min: Column, hour_max: Column) -> Column:
    """Whole-day text for 0-24, else the range between left-to-right embedding marks."""
    span = F.concat(F.lit("\u202a"), hour_min.cast("string"), F.lit("–"), hour_max.cast("string"), F.lit("\u202c"))
    return F.when((hour_min == 0) & (hour_max == 24), texts.WHOLE_DAY).otherwise(span)
