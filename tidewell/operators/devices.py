"""Device-side logic over recorded snapshots and events.

A device may own a large share of all rows, so every order-dependent step works on time chunks
of a device and passes summaries across the edges (see `functions.ordered`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.ordered import free_names, in_chunks, time_chunk, with_next, with_previous

MIN_CHARS = 8
MAX_CHARS = 4000
SETTLE_SECONDS = 1.1
# Screens of the own app, recognised by its name next to one of these headings.
OWN_APP_HEADINGS = ("Coping Chat", "Mental Battery", "Surface conditions", "Moments")
BACKSPACE_CODES = (51, 117)
_MICROS = 1_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_snapshots(snapshots: DataFrame, own_app: str) -> DataFrame:
    """Trimmed text cut to 4,000 characters; short texts and the own app's screens are dropped."""
    cleaned = snapshots.withColumn("text", F.substring(trimmed(F.col("text")), 1, MAX_CHARS))
    heading = F.lit(False)
    for name in OWN_APP_HEADINGS:
        heading = heading | F.contains("text", F.lit(name))
    own = F.contains("text", F.lit(own_app)) & heading
    return cleaned.where((F.length("text") >= MIN_CHARS) & ~own)


def drop_repeats(snapshots: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Without snapshots whose text equals the device's previous one."""
    seen = with_previous(snapshots, ["device_id"], "ts", ["text"], tie, name="_prev")
    return seen.where(F.col("_prev").isNull() | (F.col("text") != F.col("_prev.text"))).drop("_prev")


def settle(snapshots: DataFrame, tie: Sequence[str] = (), seconds: float = SETTLE_SECONDS) -> DataFrame:
    """Texts that stayed unchanged for `seconds`, once each, unless equal to the last settled one.

    A text shorter than the minimum clears what was pending. One row per settled message, at the
    poll that settled it. One pass: a chunk's summary says what its first stretch of equal polls needs to know of the chunks before.
    """
    order, wait, us = ["ts", *tie], int(seconds * _MICROS), _micros("ts")
    polled = snapshots.withColumn("_text", trimmed(F.col("text")))
    polled = polled.withColumn("_text", F.when(F.length("_text") >= MIN_CHARS, F.col("_text")).otherwise(""))
    chunked, within, along = in_chunks(polled, ["device_id"], "ts", order)
    until_now, before = within.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumns({"_before": F.lag("_text").over(within), "_polled": F.lag(us).over(within)})
    # _own: since when the text stands, where a change inside the chunk tells
    local = local.withColumn("_own", F.max(F.when(F.col("_text") != F.col("_before"), us)).over(until_now))
    ripe_here = (us - F.col("_own") >= wait) & (F.col("_text") != "")
    place = F.struct(*order)
    chunks = local.groupBy("device_id", "_chunk").agg(
        F.min_by("_text", place).alias("first"), F.min(us).alias("opens"), F.max_by("_text", place).alias("last"),
        F.max(F.when(F.col("_own").isNull(), us)).alias("stays"), F.max("_own").alias("changed"), F.max(us).alias("ends"),
        F.max_by("_text", F.when(ripe_here, place)).alias("settled"))
    same = F.lag("last").over(along) == F.col("first")
    chunks = chunks.withColumn("_new", F.when(same, None).otherwise(F.col("opens")))
    # since when the text that opens the chunk stands, and whether it settles in the stretch that opens it
    chunks = chunks.withColumn("_stands", F.coalesce("_new", F.max(F.coalesce("changed", "_new")).over(before)))
    opening = F.when((F.col("stays") - F.col("_stands") >= wait) & (F.col("first") != ""), F.col("first"))
    chunks = chunks.withColumn("_done", F.last(F.coalesce("settled", opening), ignorenulls=True).over(before))
    carried = chunks.select("device_id", "_chunk", "_stands", "_done", F.lag("ends").over(along).alias("_ended"))
    joined = local.join(carried, ["device_id", "_chunk"])
    since = F.coalesce("_own", "_stands")
    fresh = (us - since >= wait) & (F.col("_text") != "") & (F.coalesce("_polled", "_ended", since) - since < wait)
    told = joined.withColumn("_fresh", F.when(fresh, F.col("_text")))
    told = told.withColumn("_last", F.coalesce(F.last("_fresh", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)), "_done"))
    kept = [c for c in snapshots.columns if c not in ("device_id", "text")]
    return told.where(F.col("_fresh").isNotNull() & (F.col("_last").isNull() | (F.col("_fresh") != F.col("_last")))).select(
        "device_id", *kept, F.col("_text").alias("text"))


def display_phrase(hits: Column, tier3: Column) -> Column:
    """The first tier-3 phrase of a tier-3 text, else the first phrase; empty without hits."""
    severe = F.get(F.filter(hits, lambda h: h["tier"] == "3"), F.lit(0))["phrase"]
    first = F.get(hits, F.lit(0))["phrase"]
    return F.coalesce(F.when(tier3, severe), first, F.lit(""))


def apply_snooze(alerts: DataFrame, snoozes: DataFrame, tie: Sequence[str] = ("seq",),
                 chunk_seconds: int = 3600) -> DataFrame:
    """Alerts outside every snooze [start, until) of their device; crises are dropped too.

    An alert is snoozed if the latest end of the snoozes begun by then lies ahead of it. That is a running maximum, carried across chunks of
    time by one value a chunk, so a snooze is one row however long it lasts. An alert without a device or a time is nobody's to snooze and stays.
    """
    until, said = free_names(alerts, "_until", "_said")
    rows = alerts.withColumn(until, F.lit(None).cast("timestamp"))
    begun = snoozes.where(F.col("start") < F.col("until")).select("device_id", F.col("start").alias("ts"), F.col("until").alias(until))
    chunked, within, along = in_chunks(rows.unionByName(begun, allowMissingColumns=True), ["device_id"], "ts", ["ts"], chunk_seconds)
    # Rows of one instant see each other's snoozes, whatever their order
    local = chunked.withColumn(said, F.max(until).over(within.rangeBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("device_id", "_chunk").agg(F.max(until).alias("_ends"))
    carried = ends.select("device_id", "_chunk", F.max("_ends").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    joined = local.join(carried, ["device_id", "_chunk"]).where(F.col(until).isNull())
    awake = joined.where(~F.coalesce(F.greatest(said, "_before") > F.col("ts"), F.lit(False)))
    return awake.select(*alerts.columns).union(alerts.where(F.col("device_id").isNull() | F.col("ts").isNull()))


def gate_edges(polls: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Alerts where the gate turns on: urgent first, else gentle. The first poll of a session sets the baseline."""
    seen = with_previous(polls, ["device_id", "session_id"], "ts", ["urgent", "gentle"], tie, name="_prev")
    kind = (F.when(F.col("_prev").isNull(), None)
            .when(F.col("urgent") & ~F.col("_prev.urgent"), "urgent")
            .when(F.col("gentle") & ~F.col("_prev.gentle"), "gentle"))
    return seen.withColumn("alert", kind).where(F.col("alert").isNotNull()).drop("_prev")


# --- Alert throttles ----------------------------------------------------------------------
#
# Whether an alert fires depends only on the last one that fired, so a device's alerts form chains:
# from each alert the next one to fire is fixed. A chunk of time is a jump table: for each of its alerts that may be the first
# to fire, where the chain through it leaves the chunk. Tables compose into tables of the same size, so they are combined in a tree of
# `FAN` children a node, up to a table per device; the state each node starts from then goes down the tree, and the chunks are
# replayed independently. No task sees more than one chunk's alerts or one node's children.

_QUIET = {"typed_urgent": (30.0, 30.0), "typed_any": (4.0, 4.0), "screen": (40.0, 15.0)}
FAN = 256
_STATE = "last_at long, last_phrase string"
_TABLE = "array<struct<at:bigint,phrase:string,forced:boolean,exit_at:bigint,exit_phrase:string>>"


def _next_firings(at: np.ndarray, phrase: np.ndarray, forced: np.ndarray, same: int, any_: int) -> np.ndarray:
    """For each alert, the index of the first later one that fires after it fired; len(at) when none does."""
    n = len(at)
    here = np.arange(n)

    def changes(values: np.ndarray) -> np.ndarray:
        """For each place, the next one with another value."""
        ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
        return ends[np.searchsorted(ends, np.arange(len(values)), "right")]

    def first_other(start: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The first of the places `among`, from `start` on, whose phrase differs from the alert's own."""
        if not len(among):
            return np.full(n, n)
        named, beyond = phrase[among], np.append(among, n)
        k = np.searchsorted(among, start)
        inside = np.minimum(k, len(among) - 1)
        k = np.where((k < len(among)) & (named[inside] == phrase), changes(named)[inside], k)
        return beyond[k]

    rested, unlike = np.searchsorted(at, at + max(same, any_)), np.searchsorted(at, at + same)
    urgent = np.flatnonzero(forced)
    again = np.append(urgent, n)[np.searchsorted(urgent, np.maximum(here + 1, unlike))]
    return np.minimum.reduce([
        np.maximum(rested, here + 1), first_other(here + 1, urgent),
        first_other(np.maximum(here + 1, np.searchsorted(at, at + any_)), here), again])


def _in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["at", "seq"], kind="stable")
    return pdf, pdf["at"].to_numpy(), pd.factorize(pdf["phrase"])[0], pdf["forced"].to_numpy(bool)


def _summarise(same: int, any_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, phrase, forced = _in_order(pdf)
        after = np.append(_next_firings(at, phrase, forced, same, any_), len(at))
        last = np.where(after < len(at), after, np.arange(len(after)))
        while (last[last] != last).any():
            last = last[last]
        reach = min(len(at), int((at < at[0] + max(same, any_)).sum()) + 1)
        words = pdf["phrase"].to_numpy(object)
        table = [{"at": int(at[i]), "phrase": words[i], "forced": bool(forced[i]), "exit_at": int(at[last[i]]), "exit_phrase": words[last[i]]}
                 for i in range(reach)]
        return pd.DataFrame({"device_id": [pdf["device_id"].iloc[0]], "_chunk": [pdf["_chunk"].iloc[0]], "entries": [table]})
    return run


def _through(tables: list, states: set, same: int, any_: int) -> list[dict]:
    """Where each state leads, before each of the tables in turn and behind the last. A state is (at, phrase) of the last alert fired, or None."""
    steps, leads = [{s: s for s in states}], {s: s for s in states}
    for table in tables:
        at = np.array([e["at"] for e in table])
        words = np.array([e["phrase"] for e in table], dtype=object)
        forced = np.array([e["forced"] for e in table], dtype=bool)
        out = {}
        for state in set(leads.values()):
            if state is None:
                first = 0
            else:
                fires = ~((words == state[1]) & (at < state[0] + same)) & (forced | (at >= state[0] + any_))
                first = int(fires.argmax()) if fires.any() else None
            out[state] = state if first is None else (int(table[first]["exit_at"]), table[first]["exit_phrase"])
        leads = {s: out[now] for s, now in leads.items()}
        steps.append(dict(leads))
    return steps


def _compose(same: int, any_: int):
    """The table of a node from those of its children: a child that lets nothing fire ends so long before the next one's first alert that this one fires."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        tables = list(pdf["entries"])
        entries = [(dict(e), tables[1:]) for e in tables[0]] + [(dict(e), tables[2:]) for t in tables[1:2] for e in t[:1]]
        for rest in (tables[1:], tables[2:]):
            same_rest = [e for e, r in entries if len(r) == len(rest)]
            ends = _through(rest, {(int(e["exit_at"]), e["exit_phrase"]) for e in same_rest}, same, any_)[-1]
            for e in same_rest:
                e["exit_at"], e["exit_phrase"] = ends[int(e["exit_at"]), e["exit_phrase"]]
        return pd.DataFrame({"device_id": [pdf["device_id"].iloc[0]], "_node": [pdf["_node"].iloc[0]], "entries": [[e for e, _ in entries]]})
    return run


def _descend(same: int, any_: int, part: str):
    """The state each child starts from, given the state (if any) its node starts from."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part)
        entry = None
        if "last_at" in pdf.columns and not pd.isna(pdf["last_at"].iloc[0]):
            entry = (int(pdf["last_at"].iloc[0]), pdf["last_phrase"].iloc[0])
        steps = [s[entry] for s in _through(list(pdf["entries"])[:-1], {entry}, same, any_)]
        return pd.DataFrame({
            "device_id": pdf["device_id"], part: pdf[part], "last_at": pd.array([s[0] if s else None for s in steps], "Int64"),
            "last_phrase": [s[1] if s else None for s in steps]})
    return run


def _replay(same: int, any_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, phrase, forced = _in_order(pdf)
        after = _next_firings(at, phrase, forced, same, any_)
        fired, start = np.zeros(len(at), bool), 0
        if not pd.isna(pdf["last_at"].iloc[0]):
            last_at, again = int(pdf["last_at"].iloc[0]), (pdf["phrase"] == pdf["last_phrase"].iloc[0]).to_numpy(bool)
            opening = np.flatnonzero(~(again & (at < last_at + same)) & (forced | (at >= last_at + any_)))
            start = int(opening[0]) if len(opening) else len(at)
        while start < len(at):
            fired[start] = True
            start = after[start]
        return pdf.loc[fired, ["device_id", "seq"]]
    return run


def _fired(alerts: DataFrame, rule: str, chunk_seconds: int) -> DataFrame:
    """(device_id, seq) of the alerts that fire. `alerts`: device_id, seq, at, phrase, forced."""
    same, any_ = (int(s * _MICROS) for s in _QUIET[rule])
    if chunk_seconds * _MICROS < max(same, any_):
        raise ValueError("a chunk must be at least as long as the quiet time")
    key = f"device_id {alerts.schema['device_id'].dataType.simpleString()}"
    chunked = alerts.withColumn("_chunk", F.floor(F.col("at") / F.lit(chunk_seconds * _MICROS)).cast("long"))
    chunks = chunked.groupBy("device_id", "_chunk").applyInPandas(_summarise(same, any_), f"{key}, _chunk long, entries {_TABLE}").withColumn(
        "_node", F.floor(F.col("_chunk") / FAN).cast("long"))
    nodes = chunks.groupBy("device_id", "_node").applyInPandas(_compose(same, any_), f"{key}, _node long, entries {_TABLE}")
    of_nodes = nodes.groupBy("device_id").applyInPandas(_descend(same, any_, "_node"), f"{key}, _node long, {_STATE}")
    of_chunks = chunks.join(of_nodes, ["device_id", "_node"]).groupBy("device_id", "_node").applyInPandas(
        _descend(same, any_, "_chunk"), f"{key}, _chunk long, {_STATE}")
    return chunked.join(of_chunks, ["device_id", "_chunk"]).groupBy("device_id", "_chunk").applyInPandas(
        _replay(same, any_), f"{key}, seq long")


def throttle_alerts(alerts: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Typed channel: urgent at most every 30 s, gentle only 4 s after any alert.

    `alerts`: device_id, seq, ts, tier3, surface. Returns the alerts shown.
    """
    shaped = alerts.withColumn("at", _micros("ts")).withColumn("phrase", F.lit(""))
    urgent = (F.col("surface") == "urgent") | F.col("tier3")
    shown_urgent = _fired(
        shaped.where(urgent).select("device_id", "seq", "at", "phrase", F.lit(False).alias("forced")),
        "typed_urgent", chunk_seconds)
    gentle = shaped.where(~urgent & (F.col("surface") == "gentle"))
    # An urgent alert always quiets gentle ones; a phrase of its own keeps it from counting as a repeat.
    mixed = shaped.join(shown_urgent, ["device_id", "seq"], "left_semi").select(
        "device_id", "seq", "at", F.concat(F.lit("u"), F.col("seq").cast("string")).alias("phrase"),
        F.lit(True).alias("forced")).unionByName(gentle.select(
            "device_id", "seq", "at", F.concat(F.lit("g"), F.col("seq").cast("string")).alias("phrase"),
            F.lit(False).alias("forced")))
    shown = _fired(mixed, "typed_any", chunk_seconds)
    return alerts.join(shown, ["device_id", "seq"], "left_semi")


def throttle_screen(alerts: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Screen channel: the same phrase at most every 40 s, anything but a crisis only 15 s after an alert.

    `alerts`: device_id, seq, ts, tier3, level, surface, phrase. Texts without a level, and softer ones
    judged harmless, never alert.
    """
    able = alerts.where((F.col("level") >= 1) & (F.col("tier3") | (F.col("surface") != "none")))
    shaped = able.select("device_id", "seq", _micros("ts").alias("at"), "phrase", F.col("tier3").alias("forced"))
    return alerts.join(_fired(shaped, "screen", chunk_seconds), ["device_id", "seq"], "left_semi")


# --- Rhythm -------------------------------------------------------------------------------

WINDOW_SECONDS = 15 * 60
REPORT_SECONDS = 45


def rhythm_panes(events: DataFrame, pane_seconds: int = REPORT_SECONDS) -> DataFrame:
    """Switch, key and backspace counts per device and report interval: all later windows start here."""
    switch, key = F.col("kind") == "switch", F.col("kind") == "key"
    pane = F.floor(_micros("ts") / F.lit(pane_seconds * _MICROS)).cast("long")
    return events.groupBy("device_id", pane.alias("pane")).agg(
        F.count_if(switch).alias("switches"), F.count_if(key).alias("keys"),
        F.count_if(key & F.col("key_code").isin(list(BACKSPACE_CODES))).alias("backs"))


def rolling_rates(events: DataFrame, started: DataFrame | None = None, window_seconds: int = WINDOW_SECONDS,
                  report_seconds: int = REPORT_SECONDS) -> DataFrame:
    """Rates at every report over the trailing 15 minutes.

    Events are summed into report-wide panes first; only panes are spread over the windows that
    cover them. Early reports divide by the time since the device's first event, at least 0.01 h.
    """
    panes = rhythm_panes(events, report_seconds)
    per_window = window_seconds // report_seconds
    spread = panes.withColumn("_report", F.explode(F.sequence(F.col("pane") + 1, F.col("pane") + per_window)))
    summed = spread.groupBy("device_id", "_report").agg(
        F.sum("switches").alias("switches"), F.sum("keys").alias("keys"), F.sum("backs").alias("backs"))
    first = started if started is not None else events.groupBy("device_id").agg(F.min("ts").alias("started_at"))
    at = F.col("_report") * report_seconds * _MICROS
    joined = summed.join(first, "device_id")
    elapsed = F.greatest(
        F.least(F.lit(float(window_seconds)), (at - _micros("started_at")) / _MICROS) / 3600.0, F.lit(0.01))
    tab = F.least(F.lit(120.0), F.col("switches") / elapsed)
    return joined.select(
        "device_id", F.timestamp_micros(at).alias("report_at"), "switches", tab.alias("tab_switches"),
        (tab * 0.7).alias("interruptions"), backspace_rate(F.col("backs"), F.col("keys")).alias("backspace_rate"))


def backspace_rate(backs: Column, keys: Column) -> Column:
    return F.when(keys > 0, backs / keys).otherwise(0.0)


def longest_gap(events: DataFrame, tie: Sequence[str] = ("seq",), report_seconds: int = REPORT_SECONDS) -> DataFrame:
    """Longest pause before a switch, in minutes, among the switches of each report interval.

    The first switch of a device pauses since its start: its first event of any kind.
    """
    started = events.groupBy("device_id").agg(F.min("ts").alias("_start"))
    seen = with_previous(events.where(F.col("kind") == "switch"), ["device_id"], "ts", ["ts"], tie, name="_prev").join(started, "device_id")
    gap = (_micros("ts") - F.unix_micros(F.coalesce(F.col("_prev.ts"), F.col("_start")))) / (60.0 * _MICROS)
    report = F.floor(_micros("ts") / F.lit(report_seconds * _MICROS)).cast("long") + 1
    return seen.groupBy("device_id", F.timestamp_micros(report * report_seconds * _MICROS).alias("report_at")).agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("avg_session_min"))


def late_minutes(ticks: DataFrame, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Cumulative late-night minutes (00:00-05:00) and active minutes per device and tick. One pass: a chunk's summary carries its last tick and its sums."""
    us, late = _micros("ts"), F.hour("ts") < 5
    chunked, within, along = in_chunks(ticks, ["device_id"], "ts", ["ts", *tie])
    until_now, before = within.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("_step", us - F.lag(us).over(within))
    local = local.withColumn("_night", F.when(late, F.col("_step")))
    chunks = local.groupBy("device_id", "_chunk").agg(
        F.min(us).alias("opens"), F.max(us).alias("ends"), F.min("ts").alias("ts"), F.coalesce(F.sum("_step"), F.lit(0)).alias("steps"),
        F.coalesce(F.sum("_night"), F.lit(0)).alias("nights"))
    chunks = chunks.withColumn("_gap", F.coalesce(F.col("opens") - F.lag("ends").over(along), F.lit(0)))
    chunks = chunks.withColumn("_dark", F.when(late, F.col("_gap")).otherwise(0))
    carried = chunks.select(
        "device_id", "_chunk", (F.coalesce(F.sum(F.col("steps") + F.col("_gap")).over(before), F.lit(0)) + F.col("_gap")).alias("_steps"),
        (F.coalesce(F.sum(F.col("nights") + F.col("_dark")).over(before), F.lit(0)) + F.col("_dark")).alias("_nights"))
    so_far = local.withColumns({"_sum": F.coalesce(F.sum("_step").over(until_now), F.lit(0)), "_dark_sum": F.coalesce(F.sum("_night").over(until_now), F.lit(0))})
    return so_far.join(carried, ["device_id", "_chunk"]).select(
        *ticks.columns, ((F.col("_nights") + F.col("_dark_sum")) / (60.0 * _MICROS)).alias("late_night_min"),
        ((F.col("_steps") + F.col("_sum")) / (60.0 * _MICROS)).alias("active_minutes"))


def app_spans(activations: DataFrame, tie: Sequence[str] = ("seq",), tick_seconds: int = 60) -> DataFrame:
    """Foreground seconds per device, report and app. A span runs to the next activation and is split at
    report ticks; the last one of a device stays open and is not credited."""
    spans = with_next(activations, ["device_id"], "ts", ["ts"], tie, name="_next").where(
        F.col("_next").isNotNull() & (F.col("_next.ts") > F.col("ts")))
    width = tick_seconds * _MICROS
    start, end = _micros("ts"), F.unix_micros(F.col("_next.ts"))
    ticks = spans.select("device_id", "app", start.alias("_s"), end.alias("_e"), F.explode(
        F.sequence(F.floor(start / F.lit(width)).cast("long"), F.floor((end - 1) / F.lit(width)).cast("long"))).alias("_tick"))
    inside = F.least(F.col("_e"), (F.col("_tick") + 1) * width) - F.greatest(F.col("_s"), F.col("_tick") * width)
    return ticks.groupBy("device_id", F.timestamp_micros((F.col("_tick") + 1) * width).alias("report_at"), "app").agg(
        (F.sum(inside) / _MICROS).alias("seconds"))


def app_days(activations: DataFrame, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Foreground seconds per device, day and app, from whole spans split at midnight."""
    return app_spans(activations, tie, tick_seconds=86_400).select(
        "device_id", F.to_date(F.col("report_at") - F.expr("INTERVAL 1 MICROSECOND")).alias("day"), "app", "seconds")


def web_rhythm(ticks: DataFrame, tie: Sequence[str] = ("seq",), default_session: float = 50.0) -> DataFrame:
    """Signals of a browser session from visibility ticks (device_id, ts, visible, blur, keys, backspaces).

    Visible time accrues between ticks; a blur ends a focus stretch. Rates divide by the visible hours,
    at least 0.08 h.
    """
    us = _micros("ts")
    chunked, within, along = in_chunks(ticks, ["device_id"], "ts", ["ts", *tie])
    until_now, before = within.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("_step", F.coalesce(us - F.lag(us).over(within), F.lit(0)))
    blur = F.col("blur").cast("int")
    # The blur that ends a stretch belongs to it
    local = local.withColumns({"_on": F.when(F.col("visible"), F.col("_step")).otherwise(0), "_blurs": F.sum(blur).over(until_now) - blur})
    stretches = local.groupBy("device_id", "_chunk", "_blurs").agg(
        F.sum("_on").alias("on"), F.sum(F.when(F.hour("ts") < 5, F.col("_on")).otherwise(0)).alias("late"), F.sum(blur).alias("blurs"),
        F.sum("keys").alias("keys"), F.sum("backspaces").alias("backs"), F.min(us).alias("opens"), F.max(us).alias("ends"),
        F.min_by(F.struct("visible", (F.hour("ts") < 5).alias("late")), F.struct("ts", *tie)).alias("first"))
    chunks = stretches.groupBy("device_id", "_chunk").agg(
        *[F.sum(c).alias(c) for c in ("on", "late", "blurs", "keys", "backs")], F.min("opens").alias("opens"), F.max("ends").alias("ends"),
        F.min_by("first", "_blurs").alias("first"), F.min_by("on", "_blurs").alias("head"), F.max_by("on", F.when(F.col("blurs") == 0, F.col("_blurs"))).alias("tail"),
        F.max(F.when((F.col("_blurs") > 0) & (F.col("blurs") > 0), F.col("on"))).alias("inner"))
    gap = F.coalesce(F.col("opens") - F.lag("ends").over(along), F.lit(0))
    chunks = chunks.withColumn("_gap", F.when(F.col("first.visible"), gap).otherwise(0))
    # A stretch that crosses chunks is the tail of one, whole chunks without a blur, and the head of the one that ends it
    chunks = chunks.withColumn("_nth", F.coalesce(F.sum((F.col("blurs") > 0).cast("int")).over(before), F.lit(0)))
    parts = F.array(F.struct(F.col("_nth").alias("stretch"), (F.col("head") + F.col("_gap")).alias("on"), F.lit(True).alias("counts")),
                    F.struct((F.col("_nth") + 1).alias("stretch"), F.when(F.col("blurs") > 0, F.coalesce("tail", F.lit(0))).alias("on"), F.lit(False).alias("counts")))
    flat = chunks.select("device_id", "late", "blurs", "keys", "backs", "inner", "first", "_gap", F.col("on").alias("total"), F.inline(parts))
    merged = flat.where("on IS NOT NULL").groupBy("device_id", "stretch").agg(
        F.sum("on").alias("stretch_on"), F.max("inner").alias("inner"),
        *[F.sum(F.when(F.col("counts"), value)).alias(name) for name, value in (
            ("on", F.col("total") + F.col("_gap")), ("late", F.col("late") + F.when(F.col("first.late"), F.col("_gap")).otherwise(0)),
            ("blurs", F.col("blurs")), ("keys", F.col("keys")), ("backs", F.col("backs")))])
    total = merged.groupBy("device_id").agg(
        *[F.sum(c).alias(c) for c in ("on", "late", "blurs", "keys", "backs")],
        F.greatest(F.max("stretch_on"), F.max("inner")).alias("longest"))
    hours = F.greatest(F.col("on") / (3600.0 * _MICROS), F.lit(0.08))
    tab = F.least(F.lit(120.0), F.col("blurs") / hours)
    return total.select(
        "device_id", tab.alias("tab_switches"), (tab * 0.7).alias("interruptions"),
        F.when(F.col("blurs") == 0, default_session).otherwise(F.col("longest") / (60.0 * _MICROS)).alias("avg_session_min"),
        backspace_rate(F.col("backs"), F.col("keys")).alias("backspace_rate"),
        (F.col("late") / (60.0 * _MICROS)).alias("late_night_min"))


def strain_counter(checks: DataFrame, tie: Sequence[str] = ("seq",), chunk_seconds: int = 86_400) -> DataFrame:
    """Counter per device: up by one on a strained check, down by one, never below zero, on any other.

    Equals the running sum minus its running minimum (0 at the start). Both are combined across
    chunks from one (sum, lowest point) pair per chunk.
    """
    move = F.when(F.col("strained"), 1).otherwise(-1)
    chunked = checks.withColumn("_chunk", time_chunk("ts", chunk_seconds)).withColumn("_move", move)
    within = Window.partitionBy("device_id", "_chunk").orderBy("ts", *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_sum", F.sum("_move").over(within)).withColumn("_low", F.min("_sum").over(within))
    totals = local.groupBy("device_id", "_chunk").agg(F.sum("_move").alias("_t"), F.min("_sum").alias("_m"))
    before = Window.partitionBy("device_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    lows = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    carried = lows.withColumn("_floor", F.min(F.col("_base") + F.col("_m")).over(before)).select(
        "device_id", "_chunk", "_base", "_floor")
    joined = local.join(carried, ["device_id", "_chunk"])
    lowest = F.least(F.lit(0), F.col("_base") + F.col("_low"), F.coalesce("_floor", F.lit(0)))
    return joined.select(*checks.columns, (F.col("_base") + F.col("_sum") - lowest).alias("streak"))


def web_gate(tier3: Column, matched: Column, risk: Column, streak: Column) -> Column:
    """crisis, regular or null for a browser check."""
    mild = risk.isin("low", "moderate")
    crisis = tier3 | risk.isin("high", "crisis")
    content = matched | mild
    return F.when(F.coalesce(crisis, F.lit(False)), "crisis").when(
        F.coalesce((content & (streak >= 4)) | (matched & mild), F.lit(False)), "regular")


def report_signals(events: DataFrame, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Rolling rates with the longest pause of each report: 50 minutes when the window has no switch."""
    gaps = longest_gap(events, tie)
    joined = rolling_rates(events).join(gaps, ["device_id", "report_at"], "left")
    return joined.withColumn(
        "avg_session_min",
        F.when(F.col("switches") == 0, 50.0).otherwise(F.coalesce("avg_session_min", F.lit(0.0))))
