"""The trend gate as a stream: a row whenever what a user's gate rests on changes.

An alert must not wait, so events are judged as they come. That is safe out of order: state keeps the last flagged event of each day,
the last event of each layer and the last crisis, and a later value replaces an earlier one whichever comes first. A change that comes with time alone, when a
day leaves the last seven or a layer or crisis the last four, is emitted by an event-time timer once the watermark has passed that
moment. Events later than the watermark are dropped and counted by the engine; `gate_from_history` sees them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.functions.levels import severity_rank
from tidewell.operators.history import gate_from_facts

DAY = 86_400_000_000
STREAK_DAYS, LAYER_DAYS = 7, 4
_FACTS = "user_id bigint, as_of timestamp, streak int, crisis int, bits int"


class Facts(StatefulProcessor):
    """Streak, crisis and layers of one user. State is bounded by the days of a week and the layers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._days = handle.getMapState("days", "day int", "at bigint")
        self._layers = handle.getMapState("layers", "layer int", "at bigint")
        self._said = handle.getValueState("said", "now bigint, crisis_at bigint, streak int, crisis int, bits int, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            at = int(row.at)
            self._sweep(at)
            if row.rank >= 1:
                self._keep(self._days, self.days, int(row.day), at)
            if not pd.isna(row.layer):
                self._keep(self._layers, self.layers, int(row.layer), at)
            if row.rank >= 4:
                self.crisis_at = max(at, self.crisis_at or at)
            self.now = max(self.now, at)
            self._sweep(self.now)
            self._say(self.now)
        yield from self._done(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        self.timer = None if expiredTimerInfo.getExpiryTimeInMs() == self.timer else self.timer
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._sweep(passed)  # whatever left until the watermark: a timer set now would only fire in a later micro-batch
        self.now = max(self.now, passed)
        yield from self._done(key[0])

    def _load(self) -> None:
        self.days = {k[0]: v[0] for k, v in self._days.iterator()} if self._days.exists() else {}
        self.layers = {k[0]: v[0] for k, v in self._layers.iterator()} if self._layers.exists() else {}
        self.now, self.crisis_at, *said, self.timer = self._said.get() if self._said.exists() else (-(2 ** 62), None, 0, 0, 0, None)
        self.said, self.changes = tuple(said), []

    def _keep(self, state, held: dict[int, int], key: int, at: int) -> None:
        if at > held.get(key, -(2 ** 62)):
            held[key] = at
            state.updateValue((key,), (at,))

    def _ends(self) -> list[int]:
        """The last moments at which what is held still counts."""
        ends = [at + STREAK_DAYS * DAY for at in self.days.values()] + [at + LAYER_DAYS * DAY for at in self.layers.values()]
        return ends + ([] if self.crisis_at is None else [self.crisis_at + LAYER_DAYS * DAY])

    def _sweep(self, until: int) -> None:
        """Drops what leaves its window before `until`, moment by moment."""
        while (ends := self._ends()) and min(ends) < until:
            moment = min(ends) + 1
            for state, held, days in ((self._days, self.days, STREAK_DAYS), (self._layers, self.layers, LAYER_DAYS)):
                for gone in [k for k, at in held.items() if at < moment - days * DAY]:
                    del held[gone]
                    state.removeKey((gone,))
            if self.crisis_at is not None and self.crisis_at < moment - LAYER_DAYS * DAY:
                self.crisis_at = None
            self._say(max(moment, self.now))

    def _say(self, as_of: int) -> None:
        facts = (len(self.days), int(self.crisis_at is not None), sum(1 << n for n in self.layers))
        if facts != self.said:
            self.changes.append((as_of, *facts))
            self.said = facts

    def _done(self, user):
        ends = self._ends()
        timer = min(ends) // 1000 + 1 if ends else None  # the first whole millisecond after it
        if timer != self.timer:
            if self.timer is not None:
                self._handle.deleteTimer(self.timer)
            if timer is not None:
                self._handle.registerTimer(timer)
        self._said.update((self.now, self.crisis_at, *self.said, timer))
        last = {as_of: facts for as_of, *facts in self.changes}  # of changes at one moment the last holds
        if last:
            yield pd.DataFrame([(user, pd.Timestamp(as_of, unit="us"), *facts) for as_of, facts in last.items()],
                               columns=["user_id", "as_of", "streak", "crisis", "bits"])

    def close(self) -> None:
        pass


def gate_changes(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """user_id, as_of, streak, crisis, bits (of layers) of a streaming history, a row per change. The last row of a user holds until its next.

    as_of is the user's latest event so far, or the moment (to the microsecond) something left its window. Windows are those of the batch form: both ends included. An event that
    comes out of order changes the gate from the user's latest event on; what was said of the time before stays as it was.
    """
    shaped = events.withWatermark("ts", lateness).select(
        F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("at"), F.unix_date(F.to_date("ts")).alias("day"), "layer",
        severity_rank("level").alias("rank"))
    return shaped.groupBy("user_id").transformWithStateInPandas(Facts(), outputStructType=_FACTS, outputMode="append", timeMode="EventTime")


def gate_stream(history: DataFrame, settings: Callable[[SparkSession], DataFrame], gate_path: str, checkpoint: str,
                lateness: str = "1 hour", name: str = "gate"):
    """Start the gate: its changes become rows under `gate_path`, judged by the settings as they are at each micro-batch.

    `history` is a streaming read of what `monitor_stream` writes. A micro-batch owns its folder, which a replay overwrites.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        judged = gate_from_facts(batch, settings(batch.sparkSession), "left", ["as_of"])
        judged.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{gate_path}/stream={name}/batch={batch_id}")

    return (gate_changes(history, lateness).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def gate_at(changes: DataFrame, as_of: Column) -> DataFrame:
    """The gate of every user at `as_of`: its last change until then."""
    order = F.struct("as_of", "batch")
    return changes.where(F.col("as_of") <= as_of).groupBy("user_id").agg(
        F.max_by(F.struct("streak", "layers", "urgent", "gentle"), order).alias("g")).select("user_id", "g.*")
