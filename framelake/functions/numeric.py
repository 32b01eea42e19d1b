"""Numeric rules shared by all operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def ratio(part: Column, whole: Column) -> Column:
    """``part / max(whole, 1)``: 0 on an empty set instead of null."""
    return F.coalesce(part, F.lit(0)) / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1)).cast("double")


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of reported numbers."""
    return F.bround(value, digits)


def at_least_or_unbounded(value: Column, limit: float) -> Column:
    """``value >= limit`` where a null value stands for +infinity."""
    return F.coalesce(value >= F.lit(limit), F.lit(True))


def at_most_or_unbounded(value: Column, limit: float) -> Column:
    """``value <= limit`` where a null value stands for +infinity."""
    return F.coalesce(value <= F.lit(limit), F.lit(False))


def truth(condition: Column) -> Column:
    """A condition with null read as false."""
    return F.coalesce(condition, F.lit(False))


def reasons(*gates: tuple[str, Column]) -> Column:
    """Names of the failed gates, in the given order; ``gates`` pair a name with its failure."""
    named = F.array(*[F.when(truth(failed), F.lit(name)) for name, failed in gates])
    return F.filter(named, lambda item: item.isNotNull())


def first_reason(*gates: tuple[str, Column], ok: str = "ok") -> Column:
    """Name of the first failed gate."""
    chain = None
    for name, failed in gates:
        failed = truth(failed)
        chain = F.when(failed, F.lit(name)) if chain is None else chain.when(failed, F.lit(name))
    return F.lit(ok) if chain is None else chain.otherwise(F.lit(ok))


def circular_distance(a: Column, b: Column, period: float) -> Column:
    """Distance on a circle, for hues (180) and undirected line angles (180)."""
    gap = F.pmod(F.abs(a - b), F.lit(float(period)))
    return F.least(gap, F.lit(float(period)) - gap)


def wrap_half_turn(angle: Column) -> Column:
    """Angle of an undirected axis moved into [-90, 90)."""
    return F.pmod(angle + 90.0, F.lit(180.0)) - 90.0


def geometric_mean(*parts: Column) -> Column:
    """Combined confidence: geometric mean of parts clipped to [1e-6, 1]."""
    total = None
    for part in parts:
        term = F.ln(clip(part, 1e-6, 1.0))
        total = term if total is None else total + term
    return F.exp(total / float(len(parts)))


def time_delta_ms(first_ns: Column, second_ns: Column) -> Column:
    return F.abs(first_ns - second_ns) / 1e6


def frame_sync_ms(frame_ns: Column, colour_ns: Column, depth_ns: Column) -> Column:
    """Colour-to-depth delay; a missing device stamp falls back to the frame's."""
    return time_delta_ms(F.coalesce(colour_ns, frame_ns), F.coalesce(depth_ns, frame_ns))


def thumbnail_motion(picture: Column, last: Column) -> Column:
    """Mean absolute difference of two thumbnails, cell by cell; null without a last one or where sizes differ."""
    gaps = F.zip_with(picture, last, lambda a, b: F.abs(a - b).cast("double"))
    return F.when(F.size(picture) == F.size(last), F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g) / F.greatest(F.size(picture), F.lit(1)))
