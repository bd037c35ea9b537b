"""Rolling device rates as a stream."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewell.operators.devices import BACKSPACE_CODES, REPORT_SECONDS, WINDOW_SECONDS
from tidewell.streaming.processors import MICROS, InOrder, run

IDLE_SESSION, MOST_SWITCHES, LEAST_HOURS, CALMER = 50.0, 120.0, 0.01, 0.7
_REPORT_ROWS = """device_id bigint, report_at timestamp, switches bigint, tab_switches double, interruptions double,
  avg_session_min double, backspace_rate double"""


def rolling_counts_stream(events: DataFrame, lateness: str = "1 hour", window: str = "15 minutes",
                          report: str = "45 seconds") -> DataFrame:
    """Switch, key and backspace counts per device and sliding window.

    Events are first summed per report interval, and the sums per sliding window, so an event is
    counted once and not once per window that covers it. Rows later than `lateness` are left to a
    batch repair of their day.
    """
    key = F.col("kind") == "key"
    panes = (
        events.withWatermark("ts", lateness).groupBy("device_id", F.window("ts", report))
        .agg(F.count_if(F.col("kind") == "switch").alias("switches"), F.count_if(key).alias("keys"),
             F.count_if(key & F.col("key_code").isin(list(BACKSPACE_CODES))).alias("backs")))
    sliding = panes.groupBy("device_id", F.window(F.window_time("window"), window, report)).agg(
        F.sum("switches").alias("switches"), F.sum("keys").alias("keys"), F.sum("backs").alias("backs"))
    return sliding.select("device_id", F.col("window.end").alias("report_at"), "switches", "keys", "backs")


class Reports(InOrder):
    """A device's report at the end of every interval, by timer, also where nothing happened in it.

    State: when the device started, its last switch, the intervals of the trailing window that hold events (interval, switches, keys, backspaces, longest
    pause), and the next report. A device whose window is empty falls silent until its next event.
    """

    fields = "kind string, key_code int"

    def __init__(self, window_seconds: int, report_seconds: int):
        super().__init__(True)
        self._width, self._span = report_seconds * MICROS, window_seconds // report_seconds

    def open(self, handle) -> None:
        self._clock = handle.getValueState("clock", "started bigint, switched bigint, next bigint")
        self._panes = handle.getListState("panes", "pane bigint, switches bigint, keys bigint, backs bigint, pause bigint")
        self._due = None

    def _load(self) -> tuple[int | None, int | None, int | None, deque]:
        started, switched, after = self._clock.get() if self._clock.exists() else (None, None, None)
        return started, switched, after, deque([list(p) for p in self._panes.get()] if self._panes.exists() else [])

    def _reports(self, device, panes: deque, started: int, after: int, until: int) -> tuple[list, int | None]:
        """The reports `after` to `until` (interval numbers), and the next one; intervals that leave the window are dropped."""
        out = []
        while after <= until:
            while panes and panes[0][0] < after - self._span:
                panes.popleft()
            inside = [p for p in panes if p[0] < after]
            if not inside:
                if not panes:
                    return out, None
                after = panes[0][0] + 1
                continue
            switches, keys, backs = (sum(p[i] for p in inside) for i in (1, 2, 3))
            last = inside[-1]
            pause = last[4] if last[0] == after - 1 else 0
            hours = max(min(self._span * self._width, after * self._width - started) / MICROS / 3600.0, LEAST_HOURS)
            tab = min(MOST_SWITCHES, switches / hours)
            out.append((device, pd.Timestamp(after * self._width, unit="us"), switches, tab, tab * CALMER,
                        pause / (60.0 * MICROS) if switches else IDLE_SESSION, backs / keys if keys else 0.0))
            after += 1
        return out, after

    def judge(self, device, rows):
        started, switched, after, panes = self._load()
        out = []
        for row in rows.itertuples(index=False):
            pane = row.at // self._width
            started = row.at if started is None else started
            if after is not None:
                told, after = self._reports(device, panes, started, after, pane)
                out += told
            if not panes or panes[-1][0] != pane:
                panes.append([pane, 0, 0, 0, 0])
            after = pane + 1 if after is None else after
            now = panes[-1]
            if row.kind == "switch":
                now[1] += 1
                now[4] = max(now[4], row.at - (started if switched is None else switched))
                switched = row.at
            elif row.kind == "key":
                now[2] += 1
                now[3] += row.key_code in BACKSPACE_CODES
        self._store(started, switched, after, panes)
        return self._frame(out)

    def tell(self, device, passed):
        started, switched, after, panes = self._load()
        if started is None or after is None:
            self._due = None
            return None
        out, after = self._reports(device, panes, started, after, passed // self._width)
        self._store(started, switched, after, panes)
        self._due = None if after is None else after * self._width
        return self._frame(out)

    def wake(self):
        return self._due

    def _store(self, started, switched, after, panes) -> None:
        self._clock.update((started, switched, after))
        if panes:
            self._panes.put([tuple(int(x) for x in p) for p in panes])
        else:
            self._panes.clear()

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["device_id", "report_at", "switches", "tab_switches", "interruptions", "avg_session_min", "backspace_rate"])


def report_signals_stream(events: DataFrame, lateness: str = "1 minute", window_seconds: int = WINDOW_SECONDS,
                          report_seconds: int = REPORT_SECONDS) -> DataFrame:
    """Rates and longest pause at every report, as the batch form `report_signals` has them, once the watermark has passed the report.

    A report needs no event of its interval: a timer of the device emits it. Events in any order within `lateness` give the same reports.
    """
    return run(events, Reports(window_seconds, report_seconds), _REPORT_ROWS, lateness)
