"""Stateful per-device processors. State is a few values per device, whatever its history, and, with a lateness, the rows that wait.

Without a lateness the rows of a micro-batch are put in event order and judged at once; rows that come in a later micro-batch
than rows after them are judged out of order. With a lateness every row waits in the state until the watermark has passed it, and
the rows passed are judged in event order: whatever order they came in, the result is that of the batch form. A timer at the earliest waiting row
wakes a device that sends nothing more. Rows that come after the watermark has passed them are dropped and counted by the
engine (`late_rows`); a batch over their day repairs it. The size of a micro-batch is set by the source's rate limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


class InOrder(StatefulProcessor):
    """Hands a device's rows to `judge` in event order; `fields` are the columns it needs besides seq and at."""

    fields = ""

    def __init__(self, buffered: bool):
        self._buffered = buffered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        schema = ["seq bigint", "at bigint", *self.fields.split(", ")]
        self._columns, self._kinds = zip(*[f.split() for f in schema])
        self._columns = list(self._columns)
        if self._buffered:
            self._waiting = handle.getListState("waiting", ", ".join(schema))
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def judge(self, device, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def tell(self, device, passed: int) -> pd.DataFrame | None:
        """What is to be said once the watermark has passed `passed` (microseconds), besides the rows."""
        return None

    def wake(self) -> int | None:
        """When, in microseconds, `tell` is to be asked next."""
        return None

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat([part[self._columns] for part in rows])
        if self._buffered:
            yield from self._pass(key[0], pdf, timerValues)
        else:
            yield self.judge(key[0], pdf.sort_values(["at", "seq"], kind="stable"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._pass(key[0], None, timerValues)

    def _pass(self, device, fresh: pd.DataFrame | None, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        if fresh is not None:
            # A column of whole numbers with gaps comes as floats
            columns = [[None if pd.isna(v) else int(v) if kind.endswith("int") else v for v in fresh[c]] for c, kind in zip(self._columns, self._kinds)]
            rows += zip(*columns)
        rows.sort(key=lambda r: (r[1], r[0]))
        cut = next((i for i, r in enumerate(rows) if r[1] > passed), len(rows))
        ripe, rest = rows[:cut], rows[cut:]
        if ripe:
            yield self.judge(device, pd.DataFrame(ripe, columns=self._columns))
        told = self.tell(device, passed)
        if told is not None and len(told):
            yield told
        if rest and (ripe or fresh is not None):
            self._waiting.put(rest)
        elif not rest:
            self._waiting.clear()
        due = [t for t in (rest[0][1] if rest else None, self.wake()) if t is not None]
        if due:
            self._handle.registerTimer(-(-min(due) // 1000))

    def close(self) -> None:
        pass


class DropRepeats(InOrder):
    """Drops a snapshot whose text equals the device's previous one."""

    fields = "text string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "text string")

    def judge(self, device, rows):
        last = self._last.get()[0] if self._last.exists() else None
        previous = rows["text"].shift(1)
        previous.iloc[0] = last
        self._last.update((rows["text"].iloc[-1],))
        return rows[(rows["text"] != previous) | previous.isna()][["seq", "at", "text"]].assign(device_id=device)


class Settle(InOrder):
    """Emits a text once it has stayed unchanged long enough, unless it was the last one emitted."""

    fields = "text string"

    def __init__(self, buffered: bool, wait_micros: int, shortest: int):
        super().__init__(buffered)
        self._wait, self._shortest = wait_micros, shortest

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("pending", "pending string, since bigint, scanned string")

    def judge(self, device, rows):
        pending, since, scanned = self._state.get() if self._state.exists() else ("", 0, None)
        out = []
        for row in rows.itertuples(index=False):
            text = row.text.strip() if row.text is not None else ""
            if len(text) < self._shortest:
                pending = ""
            elif text != pending:
                pending, since = text, row.at
            elif row.at - since >= self._wait and text != scanned:
                scanned = text
                out.append((device, row.seq, row.at, text))
        self._state.update((pending, int(since), scanned))
        return pd.DataFrame(out, columns=["device_id", "seq", "at", "text"])


class ThrottleTyped(InOrder):
    """Urgent alerts at most every 30 s; gentle ones only 4 s after any alert."""

    fields = "tier3 boolean, surface string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("quiet", "urgent_until bigint, quiet_until bigint")

    def judge(self, device, rows):
        urgent_until, quiet_until = self._state.get() if self._state.exists() else (-(2 ** 62), -(2 ** 62))
        shown = []
        for row in rows.itertuples(index=False):
            if row.surface == "urgent" or row.tier3:
                fires = row.at >= urgent_until
                urgent_until = row.at + 30 * MICROS if fires else urgent_until
            else:
                fires = row.surface == "gentle" and row.at >= quiet_until
            quiet_until = row.at + 4 * MICROS if fires else quiet_until
            shown.append(fires)
        self._state.update((int(urgent_until), int(quiet_until)))
        return rows.loc[shown, ["seq", "at"]].assign(device_id=device)


class ThrottleScreen(InOrder):
    """The same phrase at most every 40 s; anything but a crisis only 15 s after an alert."""

    fields = "tier3 boolean, level int, surface string, phrase string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last", "phrase string, at bigint")

    def judge(self, device, rows):
        phrase, at = self._state.get() if self._state.exists() else (None, -(2 ** 62))
        shown = []
        for row in rows.itertuples(index=False):
            repeated = row.phrase == phrase and row.at < at + 40 * MICROS
            able = row.level >= 1 and (row.tier3 or (row.surface != "none" and row.at >= at + 15 * MICROS))
            if able and not repeated:
                phrase, at = row.phrase, row.at
            shown.append(bool(able and not repeated))
        self._state.update((phrase, int(at)))
        return rows.loc[shown, ["seq", "at"]].assign(device_id=device)


def run(stream: DataFrame, processor: InOrder, schema: str, lateness: str | None) -> DataFrame:
    """The rows (device_id, seq, ts and the processor's fields) through a processor, by device."""
    source = stream.withWatermark("ts", lateness) if lateness else stream
    shaped = source.selectExpr("device_id", "seq", "ts", "unix_micros(ts) AS at", *[f.split()[0] for f in processor.fields.split(", ")])
    return shaped.groupBy("device_id").transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="append", timeMode="EventTime" if lateness else "none")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the micro-batches the query still remembers."""
    return sum(int(op["numRowsDroppedByWatermark"]) for batch in query.recentProgress for op in batch["stateOperators"])


_TEXT_ROWS = "device_id bigint, seq bigint, at bigint, text string"
_ALERT_ROWS = "device_id bigint, seq bigint, at bigint"


def drop_repeats_stream(snapshots: DataFrame, lateness: str | None = None) -> DataFrame:
    return run(snapshots, DropRepeats(lateness is not None), _TEXT_ROWS, lateness)


def settle_stream(snapshots: DataFrame, seconds: float = 1.1, shortest: int = 8, lateness: str | None = None) -> DataFrame:
    return run(snapshots, Settle(lateness is not None, int(seconds * MICROS), shortest), _TEXT_ROWS, lateness)


def throttle_alerts_stream(alerts: DataFrame, lateness: str | None = None) -> DataFrame:
    return run(alerts, ThrottleTyped(lateness is not None), _ALERT_ROWS, lateness)


def throttle_screen_stream(alerts: DataFrame, lateness: str | None = None) -> DataFrame:
    return run(alerts, ThrottleScreen(lateness is not None), _ALERT_ROWS, lateness)
