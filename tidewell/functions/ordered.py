"""Order-dependent helpers that never sort one key's whole history in one task.

A key (user, device, address) may own a large share of all rows. Rows are therefore split
into time chunks of a fixed width. Windows run inside (key, chunk); what crosses a chunk edge
is carried by one summary row per chunk, so the per-key window only ever sees chunk summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def _neighbour(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], cols: Sequence[str],
               seconds: int, backwards: bool, name: str) -> DataFrame:
    keys, order = list(keys), [ts, *tie]
    chunked = df.withColumn(_CHUNK, time_chunk(ts, seconds))
    payload = F.struct(*[F.col(c) for c in cols])
    position = F.struct(*[F.col(c) for c in order])
    edge_row = F.max_by(payload, position) if backwards else F.min_by(payload, position)
    edges = chunked.groupBy(*keys, _CHUNK).agg(edge_row.alias("_edge"))
    between = Window.partitionBy(*keys).orderBy(_CHUNK)
    shifted = F.lag("_edge").over(between) if backwards else F.lead("_edge").over(between)
    carried = edges.select(*keys, _CHUNK, shifted.alias("_carried"))
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    local = F.lag(payload).over(within) if backwards else F.lead(payload).over(within)
    return (
        chunked.withColumn("_local", local)
        .join(carried, [*keys, _CHUNK], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_local", "_carried", _CHUNK)
    )


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                  tie: Sequence[str] = (), seconds: int = 3600, name: str = "prev") -> DataFrame:
    """Adds struct `name` holding `cols` of the previous row of the key; null on its first row."""
    return _neighbour(df, keys, ts, tie, cols, seconds, True, name)


def with_next(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
              tie: Sequence[str] = (), seconds: int = 3600, name: str = "next") -> DataFrame:
    """Adds struct `name` holding `cols` of the next row of the key; null on its last row."""
    return _neighbour(df, keys, ts, tie, cols, seconds, False, name)


def with_running(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (),
                 sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None,
                 seconds: int = 3600) -> DataFrame:
    """Adds inclusive running sums and maxima (`{new column: source column}`) per key.

    The running value is the one inside the chunk combined with the total of all earlier chunks.
    """
    keys, order = list(keys), [ts, *tie]
    sums, maxes = sums or {}, maxes or {}
    chunked = df.withColumn(_CHUNK, time_chunk(ts, seconds))
    totals = chunked.groupBy(*keys, _CHUNK).agg(
        *[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()],
        *[F.max(src).alias(f"_t_{new}") for new, src in maxes.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, _CHUNK,
        *[F.sum(f"_t_{new}").over(before).alias(f"_b_{new}") for new in sums],
        *[F.max(f"_t_{new}").over(before).alias(f"_b_{new}") for new in maxes],
    )
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.select(
        "*",
        *[F.sum(src).over(within).alias(f"_l_{new}") for new, src in sums.items()],
        *[F.max(src).over(within).alias(f"_l_{new}") for new, src in maxes.items()],
    )
    joined = local.join(carried, [*keys, _CHUNK], "left")
    for new in sums:
        joined = joined.withColumn(
            new, F.coalesce(F.col(f"_l_{new}"), F.lit(0)) + F.coalesce(F.col(f"_b_{new}"), F.lit(0)))
    for new in maxes:
        joined = joined.withColumn(new, F.greatest(f"_l_{new}", f"_b_{new}"))
    scratch = [f"_{side}_{new}" for side in "lb" for new in [*sums, *maxes]]
    return joined.drop(_CHUNK, *scratch)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores in front as it takes to be none of `df`'s."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def in_chunks(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], seconds: int = 3600) -> tuple[DataFrame, Window, Window]:
    """`df` dealt out by key and chunk, with the windows over the rows of a chunk and over the chunks of a key.

    For scans that need the previous row and running values at once: what is worked out inside a chunk, and one summary row per
    chunk, come from this one exchange. Only the summaries are dealt out by key, and joined back. Both sides read the same dealt-out
    rows if they use the same columns; a side that uses fewer reads fewer. Rows without a key or a time have no place in an order and are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, _CHUNK]])
    chunked = df.withColumn(_CHUNK, time_chunk(ts, seconds)).where(known).repartition(*keys, _CHUNK)
    return chunked, Window.partitionBy(*keys, _CHUNK).orderBy(*order), Window.partitionBy(*keys).orderBy(_CHUNK)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                spread: Sequence[str], buckets: int = 32, rank: str | None = None) -> DataFrame:
    """The first `n` rows of every key under `order`, exact whatever the key sizes.

    Rows of a key are first cut to `n` inside hash buckets over the `spread` columns, then
    across the at most `buckets * n` survivors.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    kept = (
        salted.withColumn(name, F.row_number().over(first)).where(F.col(name) <= n).drop("_salt", name)
        .withColumn(name, F.row_number().over(second)).where(F.col(name) <= n)
    )
    return kept if rank else kept.drop(name)
