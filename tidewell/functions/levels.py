"""The five-step severity scale and Python-compatible rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The severity scale.
LEVELS = ("none", "low", "moderate", "high", "crisis")


def severity_rank(level: Column | str, unknown: int = 0) -> Column:
    """Rank 0-4 of a level name. Unknown or null names get `unknown`."""
    col = F.col(level) if isinstance(level, str) else level
    ranks = F.create_map(*[x for rank, name in enumerate(LEVELS) for x in (F.lit(name), F.lit(rank))])
    return F.coalesce(F.element_at(ranks, col), F.lit(unknown))


def level_name(rank: Column | str) -> Column:
    """Level name of a rank; null outside 0-4."""
    col = F.col(rank) if isinstance(rank, str) else rank
    named = F.when(col == 0, LEVELS[0])
    for value, name in enumerate(LEVELS[1:], start=1):
        named = named.when(col == value, name)
    return named


def round_half_even(value: Column) -> Column:
    """Round half to even, as a whole number."""
    return F.rint(value).cast("long")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
