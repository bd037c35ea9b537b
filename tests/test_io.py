"""Documents, lexicon files, history folders and the monitor stream."""

import json

from pyspark.sql import functions as F

from tidewell.operators.history import gate_days, gate_from_days
from tidewell.operators.scan import load_matchers
from tidewell.plans import inputs
from tidewell.sources import documents as docs
from tidewell.sources.lexicon import SHIPPED, read_corpus, read_lexicon, read_words
from tidewell.streaming.monitor import gate_from_history, monitor_stream

SF = "/root/testdata/sf0.001"


def _write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_user_documents(spark, tmp_path):
    folder = tmp_path / "users"
    _write(folder, "user_a.json", {
        "settings": {"name": "A", "toggles": {"keyword": False}},
        "events": [{"ts": "2024-01-02T03:04:05", "layer": 1, "level": "low", "category": "x"}],
        "days": {"2024-01-02": {"signals": {"tab_switches": 3.0}, "metrics": {"mental_battery": 90}}},
        "app_usage": {"2024-01-02": {"Mail": 30.0, "Web": 5.0}}})
    _write(folder, "user_b.json", "{ not json")
    read = docs.read_user_docs(spark, str(folder))
    rows = {r["user_id"]: r for r in read.collect()}
    assert rows["a"]["settings"]["popup_policy"] == "balanced" and rows["a"]["settings"]["toggles"] == {"keyword": False}
    assert rows["b"]["events"] == [] and rows["b"]["settings"]["toggles"]["trend"]
    tables = docs.explode_docs(read)
    assert tables.app_usage.count() == 2 and tables.events.count() == 1 and tables.daily.first()["mental_battery"] == 90
    lines = docs.export_user({"events": tables.events, "app_usage": tables.app_usage}, "a").collect()
    assert sorted(r["section"] for r in lines) == ["app_usage", "app_usage", "events"]

    out = str(tmp_path / "out")
    docs.write_user_docs(read, out, buckets=2)
    changed = read.where("user_id = 'a'").withColumn("app_usage", F.from_json(F.lit("{}"), read.schema["app_usage"].dataType))
    docs.write_user_docs(changed, out, buckets=2)
    again = docs.read_written_docs(spark, out)
    assert {r["user_id"] for r in again.collect()} == {"a", "b"}
    assert docs.explode_docs(again.drop("bucket")).app_usage.count() == 0


def test_lexicon_and_word_files(spark, tmp_path):
    lexicon = read_lexicon(spark, str(SHIPPED))
    assert {r["category"] for r in lexicon.phrases.select("category").distinct().collect()} == {
        "everyday_stress", "major_stress", "crisis"}
    assert lexicon.patterns.where("kind = 'template' AND regex IS NOT NULL").count() == 8
    _write(tmp_path / "c", "corpus.json", {"p": {"texts": ["one", "two"]}, "q": {"texts": ["three"]}})
    assert {tuple(r) for r in read_corpus(spark, str(tmp_path / "c")).collect()} == {("p", "one"), ("p", "two"), ("q", "three")}
    _write(tmp_path / "w", "words", "Tree\nox\nit's\n tree \n")
    assert [r["word"] for r in read_words(spark, str(tmp_path / "w")).collect()] == ["tree"]


def test_history_rows_carry_no_text(spark, tmp_path):
    events = inputs.history(spark, SF)
    docs.append_events(events, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == events.count()
    try:
        docs.append_events(events.withColumn("text", F.lit("x")), str(tmp_path / "h"))
    except ValueError:
        return
    raise AssertionError("text reached the history")


def test_monitor_stream_equals_its_history(spark, tmp_path):
    sent = inputs.messages(spark, SF).drop("sentence")
    source = str(tmp_path / "in")
    sent.write.parquet(source)
    settings = lambda s: s.sql("SELECT CAST(-1 AS BIGINT) AS user_id, map('trend', true) AS toggles, 'balanced' AS popup_policy")
    verdicts = lambda s: s.sql("SELECT CAST(-1 AS BIGINT) AS msg_id, '' AS raw, CAST(NULL AS STRING) AS error")
    stream = spark.readStream.schema(sent.schema).parquet(source)
    query = monitor_stream(stream, load_matchers(read_lexicon(spark, str(SHIPPED))), verdicts, settings,
                           str(tmp_path / "history"), str(tmp_path / "state"))
    query.awaitTermination(240)
    assert query.exception() is None
    history = spark.read.parquet(str(tmp_path / "history"))
    assert set(history.columns) == {"user_id", "seq", "ts", "layer", "level", "category", "day", "stream", "batch"}
    # Without any verdict every message fails safe to high or is a crisis.
    assert history.count() == sent.count()
    assert {r["level"] for r in history.select("level").distinct().collect()} == {"high", "crisis"}
    as_of = F.lit("2024-01-20").cast("timestamp")
    gate = gate_from_history(spark, str(tmp_path / "history"), settings(spark), as_of)
    direct = gate_from_days(gate_days(history, as_of), settings(spark))
    assert sorted(map(str, gate.collect())) == sorted(map(str, direct.collect()))
