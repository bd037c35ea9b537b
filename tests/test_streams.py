"""Streams over several micro-batches, out of order and late, against the batch forms and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_devices import US, _screen, _typed
from tidewell.operators import devices
from tidewell.operators.history import trend_gate
from tidewell.streaming.gate import gate_at, gate_changes, gate_stream
from tidewell.streaming.processors import drop_repeats_stream, late_rows, settle_stream, throttle_alerts_stream, throttle_screen_stream
from tidewell.streaming.rates import report_signals_stream

DAY = 86_400 * US


def feed(spark, rows, schema, path, cuts):
    """Writes the rows (their `at` becomes ts) as one file a micro-batch, in the given order."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        frame = spark.createDataFrame(rows[a:b], schema).withColumn("ts", F.timestamp_micros("at")).drop("at")
        frame.coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, out, name, path):
    query = (out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path + "_state")
             .trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect(), query


def mixed(rng, rows, reach):
    """The rows out of order, none more than `reach` microseconds after a later one."""
    return sorted(rows, key=lambda r: r[2] + rng.randrange(reach))


ALERTS = "device_id long, seq long, at long, tier3 boolean, level int, surface string, phrase string"


@pytest.fixture(scope="module")
def alert_rows():
    rng, rows = random.Random(21), []
    for device in (1, 2, 3):
        at = DAY
        for seq in range(150):
            at += rng.choice([100_000, 700_000, 2 * US, 4 * US, 15 * US, 30 * US, 41 * US])
            rows.append((device, device * 1000 + seq, at, rng.random() < 0.15, rng.randint(0, 3), rng.choice(["urgent", "gentle", "gentle", "none"]), rng.choice("abc")))
    return rows


AHEAD = (99, 0, 9 * DAY, False, 0, "none", "z")  # moves the watermark past all others


@pytest.mark.parametrize("stream, loop", [(throttle_alerts_stream, _typed), (throttle_screen_stream, _screen)])
def test_out_of_order_alerts_equal_the_loop(spark, tmp_path, alert_rows, stream, loop):
    rows = mixed(random.Random(4), alert_rows, 55 * US)
    assert rows != sorted(rows, key=lambda r: r[2])
    source = feed(spark, [*rows, AHEAD], ALERTS, str(tmp_path / "a"), [100, 200, 300, 400])
    got, query = drain(spark, stream(source, lateness="60 seconds"), f"mixed_{loop.__name__}", str(tmp_path / "a"))
    assert {r["seq"] for r in got if r["device_id"] != 99} == loop(alert_rows) and len(got) == len(set(r["seq"] for r in got))
    assert late_rows(query) == 0


def test_late_rows_are_counted_and_leave_the_rest_alone(spark, tmp_path, alert_rows):
    rows = sorted(alert_rows, key=lambda r: r[2])
    late = [(d, s + 100_000, at, *rest) for d, s, at, *rest in rows[:7]]
    source = feed(spark, [*rows, *late, AHEAD], ALERTS, str(tmp_path / "a"), [150, 300, 450, 457])
    got, query = drain(spark, throttle_alerts_stream(source, lateness="10 seconds"), "late_alerts", str(tmp_path / "a"))
    assert {r["seq"] for r in got if r["device_id"] != 99} == _typed(alert_rows)
    assert late_rows(query) == 7


def test_out_of_order_snapshots_equal_the_batch(spark, tmp_path):
    rng, rows, at = random.Random(8), [], DAY
    for seq in range(400):
        at += rng.choice([400_000, 900_000, 1_200_000])
        rows.append((seq % 3, seq, at, rng.choice(["short", "  first message", "first message", "second message", None])))
    schema = "device_id long, seq long, at long, text string"
    batch = spark.createDataFrame([r for r in rows if r[3]], schema).withColumn("ts", F.timestamp_micros("at")).drop("at")
    shuffled = mixed(rng, [r for r in rows if r[3]], 20 * US)
    ahead = (99, 0, 9 * DAY, "far ahead")
    for name, stream, want in (("settled", settle_stream, devices.settle(batch, ["seq"])), ("repeats", drop_repeats_stream, devices.drop_repeats(batch, ["seq"]))):
        path = str(tmp_path / name)
        got, _ = drain(spark, stream(feed(spark, [*shuffled, ahead], schema, path, [90, 180, 270]), lateness="30 seconds"), f"mixed_{name}", path)
        assert {(r["seq"], r["text"].strip()) for r in got if r["device_id"] != 99} == {(r["seq"], r["text"].strip()) for r in want.collect()}


def test_reports_come_from_idle_intervals_too(spark, tmp_path):
    rng, rows, at = random.Random(9), [], DAY + 13 * US
    for seq in range(500):
        # pauses longer than the window silence a device, pauses of minutes do not
        at += rng.choice([US, 3 * US, 20 * US, 20 * US, 100 * US]) if rng.random() < 0.97 else rng.choice([500 * US, 2_000 * US])
        rows.append((seq % 2, seq, at, rng.choice(["switch", "switch", "key", "key", "other"]), rng.choice([51, 117, 12, None])))
    schema = "device_id long, seq long, at long, kind string, key_code int"
    batch = devices.report_signals(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")).drop("at"))
    source = feed(spark, [*mixed(rng, rows, 50 * US), (99, 0, 9 * DAY, "other", None)], schema, str(tmp_path / "r"), [120, 240, 360])
    got, _ = drain(spark, report_signals_stream(source, "1 minute"), "reports", str(tmp_path / "r"))
    columns = ["device_id", "report_at", "switches", "tab_switches", "interruptions", "avg_session_min", "backspace_rate"]

    def plain(found):
        return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in found if r["device_id"] != 99)
    events = {(d, at // (45 * US) + 1) for d, _, at, _, _ in rows}
    assert plain(got) == plain(batch.collect())
    assert sum((r["device_id"], int(r["report_at"].timestamp()) // 45) not in events for r in got) > 50


EVENTS = "user_id long, seq long, at long, layer int, level string, category string"


def history_rows(seed, users=6, events=60, days=40):
    rng, rows = random.Random(seed), []
    for user in range(users):
        for seq in range(events if user else 2):
            rows.append((user, user * 1000 + seq, (20 * DAY + rng.randrange(days * 86_400) * US), rng.choice([1, 2, 3, 4, None]),
                         rng.choice(["none", "none", "low", "moderate", "high", "crisis", None]) if rng.random() < 0.5 else "none", "x"))
    return sorted(rows, key=lambda r: r[2])


def settings_of(spark):
    return spark.sql("SELECT id AS user_id, map('trend', id % 2 = 0) AS toggles FROM range(4)")


def as_set(gate):
    return {(r["user_id"], r["streak"], tuple(r["layers"]), r["urgent"], r["gentle"]) for r in gate.collect()}


def active(gate):
    return {g for g in as_set(gate) if g[1] or g[2] or g[3] or g[4]}


def test_gate_stream_equals_the_batch_at_any_time(spark, tmp_path):
    rows = history_rows(1)
    ahead = (99, 0, 80 * DAY, 1, "none", "x")
    source = feed(spark, [*rows, ahead], EVENTS, str(tmp_path / "h"), [60, 120, 180, 240])
    query = gate_stream(source, settings_of, str(tmp_path / "gate"), str(tmp_path / "state"))
    query.awaitTermination(240)
    assert query.exception() is None
    changes = spark.read.parquet(str(tmp_path / "gate"))
    batch = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_micros("at")).drop("at")
    seen = 0
    for at in [20 * DAY + random.Random(3).randrange(50 * 86_400) * US for _ in range(1)] + [rows[i][2] + d for i in (10, 150, -1) for d in (0, 4 * DAY, 4 * DAY + 1, 7 * DAY, 7 * DAY + 1)]:
        as_of = F.timestamp_micros(F.lit(at))
        want = active(trend_gate(batch, settings_of(spark), as_of))
        assert active(gate_at(changes, as_of).where("user_id < 99")) == want
        seen += len(want)
    assert seen > 20
    assert changes.where("user_id < 99").count() > len(rows) / 10


def test_gate_stream_out_of_order_ends_like_the_batch(spark, tmp_path):
    rows = mixed(random.Random(6), history_rows(2), 3 * DAY)
    source = feed(spark, [*rows, (99, 0, 62 * DAY, 1, "none", "x")], EVENTS, str(tmp_path / "h"), [50, 100, 150, 200, 250])
    got, query = drain(spark, gate_changes(source, "3 days"), "gate_changes", str(tmp_path / "h"))
    assert late_rows(query) == 0
    last = {}
    for i, r in enumerate(got):
        last[r["user_id"]] = max(last.get(r["user_id"], (r["as_of"], i, None)), (r["as_of"], i, (r["streak"], r["crisis"], r["bits"])), key=lambda x: x[:2])
    as_of = F.timestamp_micros(F.lit(59 * DAY))  # where the watermark ends
    assert max(r[2] for r in rows) < 60 * DAY
    batch = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_micros("at")).drop("at")
    want = {r["user_id"]: r["streak"] for r in trend_gate(batch, settings_of(spark), as_of).collect() if r["streak"]}
    newest = {u: max(r[2] for r in rows if r[0] == u) for u in range(6)}
    assert all(last[u][2][0] == n for u, n in want.items() if newest[u] <= 59 * DAY) and want
