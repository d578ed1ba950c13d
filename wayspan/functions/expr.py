"""Column functions of the timetable domain. Times are seconds since midnight and may pass 24 h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
WALK_MPS = 4.5 / 3.6 / 1.3
NET_WALK_MPS = 1.25
M_PER_DEG = 111320.0
MIN_TRANSFER_S, CAUTIOUS_TRANSFER_S = 60, 240
TRANSFER_MAX_M, COMPLEX_MAX_M, GROUP_MAX_M = 500, 150, 300
HORIZON_S, REVERSE_C = 10800, 172800
BANDS_MIN = (10, 20, 30, 45, 60, 90)
DELAY_LIMITS = (-60, 60, 180, 300, 600)
DELAY_NAMED = (-60, 60, 180, 300, 600, 900)


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular metres; the cosine is taken at the first point."""
    dy = (lat2 - lat1) * F.lit(M_PER_DEG)
    dx = (lon2 - lon1) * F.lit(M_PER_DEG) * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def walk_seconds(metres: Column) -> Column:
    return js_round(metres / F.lit(WALK_MPS))


def time_to_sec(t: Column) -> Column:
    """'H:MM' or 'H:MM:SS', hours past 24 too; null where a part is no number."""
    part = F.split(F.trim(t), ":")
    at = lambda i: F.try_element_at(part, F.lit(i)).try_cast("int")
    return (at(1) * 3600 + at(2) * 60 + F.coalesce(at(3), F.lit(0))).cast("long")


def clock(sec: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(sec / 3600) % 24, F.floor(sec / 60) % 60)


def weekday(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def day_class(d: Column) -> Column:
    """0 workday, 1 Saturday, 2 Sunday."""
    return F.when(weekday(d) == 6, 1).when(weekday(d) == 0, 2).otherwise(0)


def stop_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r" \d+$", "")


def display_name(short: Column, long: Column, route_id: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(short), blank(long), route_id)


def flags(pickup: Column, drop: Column) -> Column:
    """Bit 0: no pickup, bit 1: no drop-off. Codes 2 and 3 (by arrangement) set none."""
    return F.when(pickup == "1", 1).otherwise(0) + F.when(drop == "1", 2).otherwise(0)


def ride_factor(route_type: Column) -> Column:
    return F.when(route_type.isin(3, 700, 800, 11), 1.15).when(route_type.isin(0, 900), 1.05).when(route_type.isin(1, 2), 1.02).otherwise(1.1)


def ladder(value: Column, limits, strict: bool) -> Column:
    """Index of the first limit that ``value`` is under (or at, if not strict); the number of limits beyond."""
    out = None
    for i, limit in enumerate(limits):
        met = value < limit if strict else value <= limit
        out = F.when(met, i) if out is None else out.when(met, i)
    return out.otherwise(len(limits))


def delay_bucket(delay: Column) -> Column:
    return ladder(delay, DELAY_LIMITS, True)


def band_minutes(sec: Column) -> Column:
    """The band's limit in minutes; null past the last."""
    out = None
    for m in BANDS_MIN:
        out = F.when(sec <= m * 60, m) if out is None else out.when(sec <= m * 60, m)
    return out


def km_text(metres: Column) -> Column:
    """Kilometres with one decimal, none from 9.95 on; a dash for null or 0."""
    whole, tenths = js_round(metres / 1000).cast("string"), js_round(metres / 100)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(metres >= 9950, whole).when(metres > 0, short).otherwise("—")
