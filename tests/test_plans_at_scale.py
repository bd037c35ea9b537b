"""Operators that must hold for one key with most rows, large vocabularies and long spans: same rows, and plans that spread the work."""

import json
import random
import re

from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.functions import sizing
from tidewell.operators import devices, fuzzy, identity
from tidewell.plans import inputs
from tidewell.sources import documents as docs
from tests.test_scan import _one_edit

SF = "/root/testdata/sf0.001"
US = 1_000_000


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_pass_scans(spark):
    for name, exchanges in (("settle", 4), ("late_minutes", 4), ("web_rhythm", 4)):
        plan = executed(catalog.queries()[name](spark, SF))
        assert len(re.findall(r"\bExchange ", plan)) <= exchanges and plan.count("FileScan") == 1, name
    assert executed(catalog.queries()["monthly_wrap"](spark, SF)).count("FileScan") <= 8


def test_open_ended_snoozes(spark):
    rng = random.Random(5)
    alerts = [(rng.randint(1, 3), i, rng.randrange(10_000) * 3_600 * US) for i in range(800)] + [(None, 900, 5), (1, 901, None)]
    snoozes = [(d, s * 3_600 * US, u * 3_600 * US) for d, s, u in ((1, 4_000, 20_000_000), (2, 100, 200), (2, 150, 160), (2, 190, 400), (2, 300, 250), (3, 9_999, 9_999))]
    a = spark.createDataFrame(alerts, "device_id long, seq long, at long").withColumn("ts", F.timestamp_micros("at")).withColumn("_until", F.lit("clash"))
    z = spark.createDataFrame(snoozes, "device_id long, s long, u long").select(
        "device_id", F.timestamp_micros("s").alias("start"), F.timestamp_micros("u").alias("until"))
    got = devices.apply_snooze(a, z)
    assert got.columns == a.columns and {r["_until"] for r in got.collect()} == {"clash"}
    want = {i for d, i, at in alerts if d is None or at is None or not any(d == e and s <= at < u for e, s, u in snoozes)}
    assert {r["seq"] for r in got.collect()} == want and 100 < len(want) < 800


def test_one_edit_against_a_hundred_thousand_words(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 9))) for _ in range(110_000)}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    vocabulary = spark.createDataFrame([(w, 1, i) for i, w in enumerate(sorted(words))], "word string, level int, rank int")
    tokens = ["", "a", "zz"]
    for w in rng.sample(sorted(words), 60):
        i = rng.randrange(len(w) - 1)
        tokens.append(rng.choice([w, w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i + 1] + w[i] + w[i + 2:]]))
    given = spark.createDataFrame([(t, i) for i, t in enumerate([*tokens, tokens[5], None])], "token string, n long")
    got = sorted((r["n"], r["word"]) for r in fuzzy.within_one_edit(given, "token", vocabulary).collect())
    want = sorted((n, w) for n, t in enumerate([*tokens, tokens[5]]) for k in (-1, 0, 1) for w in by_length.get(len(t) + k, []) if _one_edit(t, w))
    assert got == want and len(want) > 60


def test_anti_joins_split_a_hot_user(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("user_id"), "id", F.array("id").alias("many"),
                                      F.create_map(F.lit("k"), "id").alias("map"))
    rows = rows.unionByName(rows.limit(1).withColumn("user_id", F.lit(None).cast("long")))
    gone = spark.createDataFrame([(40,), (50,), (None,)], "user_id long")
    want = sorted(r["id"] for r in rows.collect() if r["user_id"] not in (40, 50))
    small = identity.erase({"t": rows}, gone)["t"]
    assert "BroadcastExchange" in executed(small) and sorted(r["id"] for r in small.collect()) == want
    monkeypatch.setattr(sizing, "BROADCAST_LIMIT_BYTES", -1)
    salted = identity.erase({"t": rows}, gone)["t"]
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert salted.columns == rows.columns and sorted(r["id"] for r in salted.collect()) == want


def test_erasing_rewrites_only_the_days_that_hold_the_user(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [(u, i, f"2024-01-0{1 + i % 5} 10:00:00", 1, "low", "x") for i, u in enumerate([1, 2, 3, 4, 5] * 4)] + [(9, 99, "2024-01-09 01:00:00", 1, "low", "x")]
    events = spark.createDataFrame(rows, "user_id long, seq long, ts string, layer int, level string, category string").withColumn("ts", F.col("ts").cast("timestamp"))
    docs.append_events(events, path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "h").rglob("*.parquet")}
    before = files()
    days = docs.erase_history(spark, path, spark.createDataFrame([(2,), (9,), (77,)], "user_id long"))
    assert days == ["2024-01-02", "2024-01-09"]
    left = spark.read.parquet(path)
    assert {r["user_id"] for r in left.collect()} == {1, 3, 4, 5} and left.count() == 16
    after = files()
    assert all(after[p] == t for p, t in before.items() if "day=2024-01-02" not in str(p) and "day=2024-01-09" not in str(p))
    assert docs.erase_history(spark, path, spark.createDataFrame([(2,)], "user_id long")) == []


def test_compaction_keeps_the_history(spark, tmp_path):
    path = str(tmp_path / "h")
    events = inputs.history(spark, SF).withColumn("day", F.to_date("ts"))
    for batch in range(6):
        events.where(F.col("seq") % 6 == batch).write.partitionBy("day").parquet(f"{path}/stream=monitor/batch={batch}")
    rows = lambda: sorted(map(tuple, spark.read.parquet(path).select("user_id", "seq", "level", "day").collect()))
    whole, files = rows(), lambda: len(list((tmp_path / "h").rglob("*.parquet")))
    many = files()
    docs.compact_history(spark, path, "monitor", 3)
    assert rows() == whole and {r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect()} == {3, 4, 5}
    docs.compact_history(spark, path, "monitor", 5)
    assert rows() == whole and files() < many / 3
    # A run that was cut off after the rename: the source is still there, and the next run takes it away
    events.where(F.col("seq") % 6 == 2).write.partitionBy("day").parquet(f"{path}/stream=monitor/batch=2")
    docs.compact_history(spark, path, "monitor", 5)
    assert rows() == whole


def test_user_documents_are_cut_by_size(spark, tmp_path):
    out = str(tmp_path / "docs")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "user_a.json").write_text(json.dumps({"settings": {"name": "A"}}))
    one = docs.read_user_docs(spark, str(tmp_path / "in"))
    many = one.drop("user_id").crossJoin(spark.range(1_500).select(F.concat(F.lit("u"), "id").alias("user_id"))).select(*one.columns)
    docs.write_user_docs(many, out, buckets=3, most_rows_per_file=1)
    assert len(list((tmp_path / "docs").rglob("*.json"))) == 1_500
    docs.write_user_docs(many.limit(10), out, buckets=3)
    assert docs.read_written_docs(spark, out).count() == 1_500 and len(list((tmp_path / "docs").rglob("*.json"))) < 100
