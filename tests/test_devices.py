"""Order-dependent device logic against plain loops, and streams against batches."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.ordered import top_per_key, with_running
from tidewell.operators import devices
from tidewell.streaming.processors import (
    drop_repeats_stream, settle_stream, throttle_alerts_stream, throttle_screen_stream,
)
from tidewell.streaming.rates import rolling_counts_stream

US = 1_000_000


@pytest.fixture(scope="module")
def alert_rows():
    rng, rows = random.Random(3), []
    for device in (1, 2, 3):
        at = 0
        for seq in range(400):
            at += rng.choice([100_000, 700_000, 2_000_000, 4_000_000, 15_000_000, 30_000_000, 41_000_000])
            rows.append((device, device * 1000 + seq, at, rng.random() < 0.15, rng.randint(0, 3),
                         rng.choice(["urgent", "gentle", "gentle", "none"]), rng.choice("abc")))
    return rows


@pytest.fixture(scope="module")
def alerts(spark, alert_rows):
    raw = spark.createDataFrame(
        alert_rows, "device_id long, seq long, at long, tier3 boolean, level int, surface string, phrase string")
    return raw.withColumn("ts", F.timestamp_micros("at")).drop("at")


def _typed(rows):
    shown, urgent_until, quiet_until = set(), {}, {}
    for device, seq, at, tier3, _, surface, _ in rows:
        if surface == "urgent" or tier3:
            if at < urgent_until.get(device, -1):
                continue
            urgent_until[device] = at + 30 * US
        elif surface != "gentle" or at < quiet_until.get(device, -1):
            continue
        quiet_until[device] = at + 4 * US
        shown.add(seq)
    return shown


def _screen(rows):
    shown, last = set(), {}
    for device, seq, at, tier3, level, surface, phrase in rows:
        old_phrase, old_at = last.get(device, (None, -10 ** 15))
        if level < 1 or (phrase == old_phrase and at < old_at + 40 * US):
            continue
        if not tier3 and (at < old_at + 15 * US or surface == "none"):
            continue
        last[device] = (phrase, at)
        shown.add(seq)
    return shown


@pytest.mark.parametrize("chunk", [60, 3600])
def test_throttles_equal_the_loop_whatever_the_chunks(alerts, alert_rows, chunk):
    assert {r["seq"] for r in devices.throttle_alerts(alerts, chunk).collect()} == _typed(alert_rows)
    assert {r["seq"] for r in devices.throttle_screen(alerts, chunk).collect()} == _screen(alert_rows)


@pytest.mark.parametrize("rule", ["typed_urgent", "typed_any", "screen", "odd"])
def test_next_firings_equal_the_loop(rule):
    same, any_ = (int(x * US) for x in devices._QUIET.get(rule, (5.0, 9.0)))
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 80))
        at = np.cumsum(rng.choice([0, US, 4 * US, 15 * US, 41 * US], n))
        phrase, forced = rng.integers(0, 3, n), rng.random(n) < rng.choice([0.0, 0.2, 1.0])
        got = devices._next_firings(at, phrase, forced, same, any_)
        for i in range(n):
            later = [j for j in range(i + 1, n) if not (phrase[j] == phrase[i] and at[j] < at[i] + same) and (forced[j] or at[j] >= at[i] + any_)]
            assert got[i] == min(later, default=n)


def test_one_phrase_very_often(spark):
    rows = spark.range(100_000).selectExpr("1L AS device_id", "id AS seq", "timestamp_micros(id * 36000) AS ts", "false AS tier3", "2 AS level",
                                           "'gentle' AS surface", "'the phrase' AS phrase")
    start = time.time()
    shown = sorted(r["seq"] for r in devices.throttle_screen(rows).collect())
    assert time.time() - start < 60
    want, last = [], None
    for seq in range(100_000):
        if last is None or seq * 36_000 >= last + 40 * US:
            want.append(seq)
            last = seq * 36_000
    assert shown == want


def test_throttle_over_years(spark):
    """Alerts spread over many nodes of the tree, most nodes with a single one."""
    rng, rows, at = random.Random(2), [], 0
    for seq in range(600):
        at += rng.choice([US, 5 * US, 20 * US, 3_600 * US, 86_400 * US, 40 * 86_400 * US])
        rows.append((1, seq, at, rng.random() < 0.2, 2, "gentle", rng.choice("ab")))
    alerts = spark.createDataFrame(rows, "device_id long, seq long, at long, tier3 boolean, level int, surface string, phrase string").withColumn(
        "ts", F.timestamp_micros("at")).drop("at")
    assert {r["seq"] for r in devices.throttle_screen(alerts, 60).collect()} == _screen(rows)
    assert {r["seq"] for r in devices.throttle_alerts(alerts, 60).collect()} == _typed(rows)


def _stream(spark, df, path, run, name, files=3, order="ts"):
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (run(source).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", path + "_state").trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_throttle_streams(spark, alerts, alert_rows, tmp_path):
    one = alerts.coalesce(1)
    typed = _stream(spark, one, str(tmp_path / "a"), throttle_alerts_stream, "typed_alerts", files=1)
    assert {r["seq"] for r in typed.collect()} == _typed(alert_rows)
    screen = _stream(spark, one, str(tmp_path / "b"), throttle_screen_stream, "screen_alerts", files=1)
    assert {r["seq"] for r in screen.collect()} == _screen(alert_rows)


def test_snapshot_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    rows, at = [], 0
    for seq in range(500):
        at += rng.choice([400_000, 900_000, 1_200_000])
        rows.append((seq % 2, seq, at, rng.choice(["short", "  first message", "first message", "second message"])))
    shots = spark.createDataFrame(rows, "device_id long, seq long, at long, text string").withColumn(
        "ts", F.timestamp_micros("at")).drop("at")
    batch = {(r["seq"], r["text"]) for r in devices.settle(shots, ["seq"]).collect()}
    pending, since, scanned, want = {}, {}, {}, set()
    for device, seq, at, text in rows:
        text = text.strip()
        if len(text) < 8:
            pending[device] = ""
        elif text != pending.get(device, ""):
            pending[device], since[device] = text, at
        elif at - since[device] >= 1_100_000 and text != scanned.get(device):
            scanned[device] = text
            want.add((seq, text))
    assert batch == want and want
    streamed = _stream(spark, shots, str(tmp_path / "s"), settle_stream, "settled", files=1)
    assert {(r["seq"], r["text"]) for r in streamed.collect()} == want
    repeats = {r["seq"] for r in devices.drop_repeats(shots, ["seq"]).collect()}
    streamed = _stream(spark, shots, str(tmp_path / "r"), drop_repeats_stream, "repeats", files=1)
    assert {r["seq"] for r in streamed.collect()} == repeats


def test_rate_stream_counts_equal_batch(spark, tmp_path):
    events = spark.range(600).select(
        (F.col("id") % 2).alias("device_id"), F.timestamp_micros(F.col("id") * 7 * US).alias("ts"),
        F.when(F.col("id") % 3 == 0, "key").otherwise("switch").alias("kind"), F.lit(51).alias("key_code"))
    # A last event far ahead moves the watermark past every window of the others.
    ahead = spark.sql("SELECT 9L AS device_id, timestamp_micros(864000000000) AS ts, 'none' AS kind, 0 AS key_code")
    streamed = _stream(spark, events.unionByName(ahead), str(tmp_path / "w"), rolling_counts_stream, "rates", files=2)
    got = {(r["device_id"], r["report_at"], r["switches"]) for r in streamed.where("device_id < 9").collect()}
    want = {(r["device_id"], r["report_at"], r["switches"]) for r in devices.rolling_rates(events).collect()}
    assert got and got <= want


def test_strain_counter_equals_the_loop(spark):
    rng = random.Random(11)
    rows = [(1, i, i * 3_600_000_000, rng.random() < 0.5) for i in range(300)]
    checks = spark.createDataFrame(rows, "device_id long, seq long, at long, strained boolean").withColumn(
        "ts", F.timestamp_micros("at")).drop("at")
    got = {r["seq"]: r["streak"] for r in devices.strain_counter(checks, chunk_seconds=7200).collect()}
    streak = 0
    for _, seq, _, strained in rows:
        streak = streak + 1 if strained else max(0, streak - 1)
        assert got[seq] == streak


def test_one_hot_key_is_exact(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), "id", F.timestamp_micros(F.col("id") * US).alias("ts"),
                                    F.lit(1).alias("one"))
    top = top_per_key(rows, ["k"], [F.desc("id")], 500, ["id"])
    assert sorted(r["id"] for r in top.collect()) == list(range(4500, 5000))
    running = with_running(rows, ["k"], "ts", ["id"], sums={"n": "one"}, seconds=60)
    assert running.where(F.col("n") != F.col("id") + 1).count() == 0
