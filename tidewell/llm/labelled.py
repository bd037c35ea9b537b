"""Labelled rows for fitting: a bounded, reproducible sample of the rows that may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIT_ROWS = 20_000


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held: int, rows: int = FIT_ROWS) -> DataFrame:
    """(text, y, fold): at most `rows` labelled documents outside the held-out remainder; fold 0..9.

    The labels with the smallest hashes are taken, which bounds the side that is broadcast. A document
    labelled more than once has its largest label; rows with a null id or label are left out. The fold
    goes by the opening of the text, so that copies of a text stay together. Equal texts count once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(of) != held))
    taken = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(taken), "doc_id").select("text", "y")
    once = joined.groupBy(F.xxhash64("text").alias("h"), F.md5(F.encode("text", "UTF-8")).alias("m")).agg(
        F.max("y").alias("y"), F.max("text").alias("text"))
    return once.select("text", "y", F.pmod(F.xxhash64(F.substring("text", 1, 40)), F.lit(10)).cast("int").alias("fold"))
