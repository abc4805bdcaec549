"""Scalar column expressions: numbers, angles, times, scores.

All stay in generated code. NaN counts as invalid: ``clamp01`` maps it to 0, filters drop it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: C) -> Column:
    """A double, null where the text is no number."""
    return col(c).try_cast("double")


def finite(c: C) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clamp(c: C, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high)))


def clamp01(c: C) -> Column:
    """NaN and infinities are 0; else the value within 0 and 1."""
    return F.when(finite(c), clamp(c, 0, 1)).otherwise(F.lit(0.0))


def angle_difference_deg(a: C, b: C) -> Column:
    d = F.abs(F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180)
    return F.least(d, 360 - d)


def strike_difference_deg(a: C, b: C) -> Column:
    """Folded at 180 degrees: a strike and its opposite are equal."""
    d = F.abs(F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180)
    return F.least(d, F.abs(d - 180))


def wrap_phase(c: C) -> Column:
    return F.pmod(col(c) + math.pi, F.lit(2 * math.pi)) - math.pi


def circular_mean(phase: C, weight: C | None = None) -> Column:
    """Aggregate: mean direction, by weight if given."""
    w = F.lit(1.0) if weight is None else col(weight)
    return F.atan2(F.sum(w * F.sin(col(phase))), F.sum(w * F.cos(col(phase))))


def resultant_length(phase: C, weight: C) -> Column:
    w = col(weight)
    return F.hypot(F.sum(w * F.sin(col(phase))), F.sum(w * F.cos(col(phase)))) / F.sum(w)


def year_fraction(day: C) -> Column:
    day = F.to_date(col(day))
    first = F.make_date(F.year(day), F.lit(1), F.lit(1))
    after = F.make_date(F.year(day) + 1, F.lit(1), F.lit(1))
    return F.year(day) + F.datediff(day, first) / F.datediff(after, first)


def floor_bin(c: C, width: float) -> Column:
    return F.floor(col(c) / float(width)).cast("long")


def time_bin_index(day: C, start: C, days: int) -> Column:
    return F.greatest(F.lit(0), F.floor(F.datediff(F.to_date(col(day)), F.to_date(col(start))) / float(days))).cast("long")


def bin_date(day: C, days: int) -> Column:
    """First day of the bin of so many days, counted from 1970-01-01 and floored before it."""
    n = F.floor(F.datediff(F.to_date(col(day)), F.lit("1970-01-01").cast("date")) / float(days)) * days
    return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))


def parse_bool_text(c: C) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def iso_time(text: C) -> Column:
    """ISO-8601 text, with or without Z, to a timestamp; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(text)), "Z$", "+00:00"))


def iso_text(time: C) -> Column:
    return F.date_format(col(time), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def score_or(c: C, default: float = 0.5) -> Column:
    return clamp01(F.coalesce(num(c), F.lit(float(default))))


def fault_score(planarity: C, mechanism: C, gnss: C, waveform: C, known_distance: C) -> Column:
    """Weighted sum of five scores; a missing mechanism, GNSS or waveform score is neutral."""
    told = 0.35 * clamp01(planarity) + 0.25 * score_or(mechanism) + 0.20 * score_or(gnss)
    return clamp01(told + 0.10 * score_or(waveform) + 0.10 * clamp01(known_distance))


def confidence_from_score(score: C, n_events: C) -> Column:
    return clamp01(0.25 + 0.75 * clamp01(score) * clamp(col(n_events) / 20.0, 0.1, 1.0))


def depth_interval(center: C, uncertainty: C, max_depth: float) -> Column:
    """Struct of p05, p50 and p95 within the surface and the largest depth."""
    mid = clamp(center, 0, max_depth)
    return F.struct(
        F.greatest(F.lit(0.0), mid - col(uncertainty)).alias("p05"), mid.alias("p50"), F.least(F.lit(float(max_depth)), mid + col(uncertainty)).alias("p95")
    )


def integer_km(z_m: C) -> Column:
    km = col(z_m) / 1000.0
    return F.abs(km - F.bround(km, 0)) < 1e-6


def source_family(*columns: C) -> Column:
    """Provenance class from the text of source, network, station and channel."""
    text = F.lower(F.concat_ws(" ", *(col(c).cast("string") for c in columns)))
    has = lambda *words: F.coalesce(F.greatest(*(text.contains(w) for w in words)) if len(words) > 1 else text.contains(words[0]), F.lit(False))
    return (
        F.when(has("network=0101", "hi-net", "hinet"), "hinet_0101")
        .when(has("network=0103a"), "nied_fnet_strong_motion_0103a")
        .when(has("network=0103", "f-net", "fnet"), "nied_fnet_0103")
        .when(has("nied"), "nied")
        .when(has("fdsn", "iris", "earthscope"), "fdsn")
        .otherwise("unknown")
    )


def catalog_quality_score(magnitude_type: C, depth_km: C) -> Column:
    blank = F.trim(F.coalesce(col(magnitude_type), F.lit(""))) == ""
    return clamp01(1.0 - F.when(blank, 0.15).otherwise(0.0) - F.when(col(depth_km) == 0, 0.15).otherwise(0.0))
