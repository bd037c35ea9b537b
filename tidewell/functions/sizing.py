"""Checks that keep small sides small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.types import AtomicType

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
ROW_BYTES = 100


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def held_bytes(df: DataFrame) -> int:
    """What the rows of a frame hold, counted. The estimate comes from compressed files, of which the rows may be many times the size."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES), F.lit(0))).first()[0]


def not_broadcast_unmeasured(dim: DataFrame) -> DataFrame:
    """`dim`, kept from a broadcast that the engine would choose by its estimate, where its rows hold too much for the driver."""
    threshold = dim.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return dim.hint("merge") if estimated_bytes(dim) <= threshold and held_bytes(dim) > BROADCAST_LIMIT_BYTES else dim


def collect_bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a dimension that must be small; refuse if it holds more than `limit` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} holds more than {limit} rows; it is not a small dimension")
    return rows


def lookup_join(big: DataFrame, dim: DataFrame, on: list[str], spread: list[str],
                how: str = "left", buckets: int = 16, measured: bool = False) -> DataFrame:
    """Join a dimension that is unique on `on` to a big frame that may be skewed on it.

    A dimension whose estimated size is small is broadcast. Otherwise the big side is split
    over `buckets` salts by the `spread` columns and the dimension is repeated once per salt.
    An inner join might then broadcast the big side, whose size the optimizer underrates behind an explode; the hint keeps it from that.
    With `measured`, for a dimension that may grow with the input, what its rows hold is counted before they are broadcast.
    """
    if estimated_bytes(dim) <= BROADCAST_LIMIT_BYTES and not (measured and held_bytes(dim) > BROADCAST_LIMIT_BYTES):
        return big.join(F.broadcast(dim), on, how)
    salt = F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    repeated = repeated.hint("merge") if how == "inner" or measured else repeated
    return big.withColumn("_salt", salt).join(repeated, [*on, "_salt"], how).drop("_salt")


def lookup_anti(big: DataFrame, gone: DataFrame, on: list[str], buckets: int = 16) -> DataFrame:
    """The rows of a big frame, skewed on `on` or not, whose key is not in `gone`.

    A small `gone` is broadcast, so the big side stays where it is. Otherwise the big side is split over `buckets` salts by all its columns, and
    `gone` is repeated once per salt: one key's rows go to as many tasks. Rows with a null key stay.
    """
    gone = gone.select(*on).distinct()
    if estimated_bytes(gone) <= BROADCAST_LIMIT_BYTES:
        return big.join(F.broadcast(gone), on, "left_anti")
    plain = [f.name for f in big.schema if isinstance(f.dataType, AtomicType)]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(buckets)).cast("int"))
    repeated = gone.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(repeated, [*on, "_salt"], "left_anti").drop("_salt").select(*big.columns)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input that would leave cores idle; anything larger stays where it is, unshuffled.

    For work bound by the processor: a single small file is one task otherwise.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    per_task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if estimated_bytes(df) < cores * per_task else df
