"""Streaming ingest -> scan -> fuse -> history -> gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.operators.fusion import attribute_event, fuse_verdicts
from tidewell.operators.history import gate_days, gate_from_days, to_events
from tidewell.operators.scan import LevelMatchers, scan_messages


def monitor_stream(messages: DataFrame, matchers: Sequence[LevelMatchers],
                   verdicts: Callable[[SparkSession], DataFrame], settings: Callable[[SparkSession], DataFrame],
                   history_path: str, checkpoint: str, name: str = "monitor"):
    """Start the monitor: scanned and fused messages become history rows under `history_path`.

    The scan is stateless. Each micro-batch writes its rows to a folder of its own, which a replay
    overwrites whole, so a lost executor or a restart neither drops nor doubles rows. Streams that share a history need
    names of their own. Text is not written. `gate.gate_stream` follows the history written here.
    """
    scanned = scan_messages(messages, matchers)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fused = fuse_verdicts(batch.drop("text"), verdicts(spark), settings(spark))
        rows = to_events(attribute_event(fused)).withColumn("day", F.to_date("ts"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(
            f"{history_path}/stream={name}/batch={batch_id}")

    return (scanned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def gate_from_history(spark: SparkSession, history_path: str, settings: DataFrame, as_of: Column) -> DataFrame:
    """The gate at `as_of` from the written history; only the folders of the last week are read."""
    history = spark.read.parquet(history_path)
    week = history.where((F.col("day") >= F.date_sub(F.to_date(as_of), 7)) & (F.col("day") <= F.to_date(as_of)))
    return gate_from_days(gate_days(week, as_of), settings)
