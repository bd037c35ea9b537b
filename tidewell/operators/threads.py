"""Conversation threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.operators.history import KEPT, retain_last


def thread_title(content: Column) -> Column:
    """Whitespace collapsed, 44 characters and an ellipsis, a default when blank."""
    flat = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    return (F.when(F.length(flat) > 44, F.concat(F.substring(flat, 1, 44), F.lit("…")))
            .when(flat == "", "New conversation").otherwise(flat))


def thread_titles(turns: DataFrame) -> DataFrame:
    """Title per thread, from its first user turn. Titles are cut before the shuffle."""
    own = F.when(F.col("role") == "user", F.col("turn"))
    titled = turns.withColumn("_title", F.when(F.col("role") == "user", thread_title(F.col("content"))))
    return titled.groupBy("thread_id").agg(
        F.coalesce(F.min_by("_title", own), F.lit("New conversation")).alias("title"))


def list_threads(turns: DataFrame) -> DataFrame:
    """Threads with title, time and message count, newest first within a user."""
    own = F.when(F.col("role") == "user", F.col("turn"))
    titled = turns.withColumn("_title", F.when(F.col("role") == "user", thread_title(F.col("content"))))
    return titled.groupBy("user_id", "thread_id").agg(
        F.coalesce(F.min_by("_title", own), F.lit("New conversation")).alias("title"),
        F.max("ts").alias("ts"), F.count("*").alias("count")).orderBy("user_id", F.desc("ts"), F.desc("thread_id"))


def archivable_threads(turns: DataFrame, keep: int = KEPT["threads"]) -> DataFrame:
    """Threads holding a user turn, the last `keep` per user."""
    threads = turns.groupBy("user_id", "thread_id").agg(
        F.max("ts").alias("ts"), F.count("*").alias("count"), F.bool_or(F.col("role") == "user").alias("_own"))
    return retain_last(threads.where("_own").drop("_own"), keep, ["user_id"], ["ts", "thread_id"])


def delete_threads(threads: DataFrame, deletions: DataFrame) -> DataFrame:
    return threads.join(deletions.select("user_id", "thread_id").distinct(), ["user_id", "thread_id"], "left_anti")


def missing_threads(threads: DataFrame, deletions: DataFrame) -> DataFrame:
    """Deletions that name no existing thread."""
    return deletions.select("user_id", "thread_id").distinct().join(
        threads.select("user_id", "thread_id"), ["user_id", "thread_id"], "left_anti")
