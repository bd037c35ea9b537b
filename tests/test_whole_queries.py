"""Queries on inputs that outgrow a type, a plan or a limit: whole and right results."""

from math import prod

from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.functions import sizing
from tidewell.functions.text import bounded_phrases, normalize_text
from tidewell.operators import fuzzy, guards, lexicon, scan
from tidewell.plans import inputs
from tests.test_plans_at_scale import executed

SF = "/root/testdata/sf0.001"


def test_more_combinations_than_a_bigint_holds(spark):
    slots = spark.createDataFrame([(f"t_{c}", c, i, s) for c in ("few", "many", "most") for i, s in enumerate(("states", "modifiers", "contexts"))],
                                  "template_id string, category string, pos int, slot string")
    sizes = {"few": (2, 3, 4), "many": (4_000_000, 3_000_000, 2_000_000), "most": (3, 1, 1)}
    rows = [(c, s, f"{s} {i}") for c in ("few", "most") for s, n in zip(("states", "modifiers", "contexts"), sizes[c]) for i in range(n)]
    listed = spark.createDataFrame(rows, "category string, slot string, phrase string")
    for s, n in zip(("states", "modifiers", "contexts"), sizes["many"]):
        listed = listed.unionByName(spark.range(n).select(F.lit("many").alias("category"), F.lit(s).alias("slot"), F.col("id").cast("string").alias("phrase")))
    got = {r["template_id"]: (r["combinations"], r["combinations_exact"]) for r in lexicon.combination_count(slots, listed).collect()}
    want = {c: prod(n if s == "states" else n + 1 for s, n in zip(("states", "modifiers", "contexts"), sizes[c])) for c in sizes}
    assert want["many"] > 2**63
    assert {c: int(got[f"t_{c}"][1]) for c in want} == want
    assert got["t_few"][0] == want["few"] and got["t_most"][0] == want["most"] and got["t_many"][0] is None
    assert catalog.queries()["combination_count"](spark, SF).columns == ["template_id", "combinations"]


def test_a_small_vocabulary_leaves_the_messages_where_they_are(spark, monkeypatch):
    for name in ("exact_hits", "root_hits", "pair_hits"):
        plan = executed(catalog.queries()[name](spark, SF))
        assert "BroadcastHashJoin" in plan and "_salt" not in plan, name
    texts = ["", None, "kill", "they kill him", "kill him kill him", "Kill  HIM.", "skill him", "him kill", "a him", "end"]
    given = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = spark.createDataFrame([("kill him", "x"), ("kill him", "y"), ("him", "x"), ("they kill him", "z"), ("end", "x"), ("", "e"), (None, "e")], "phrase string, category string")
    pairs = (("kill him", "x"), ("kill him", "y"), ("him", "x"))
    want = sorted([(i, p, c) for i in (3, 4, 5) for p, c in pairs] + [(3, "they kill him", "z"), (6, "him", "x"), (7, "him", "x"), (8, "him", "x"), (9, "end", "x"), (0, "", "e"), (1, "", "e")])
    found = lambda: sorted(map(tuple, scan.phrase_hits(given, words, "id").collect()))
    assert found() == want
    monkeypatch.setattr(scan, "HEADS", 0)
    assert found() == want
    monkeypatch.setattr(scan, "BROADCAST_LIMIT_BYTES", -1)
    monkeypatch.setattr(sizing, "BROADCAST_LIMIT_BYTES", -1)
    assert found() == want
    # The texts must not be what is broadcast, however small their files are
    assert "BroadcastHashJoin" not in executed(scan.phrase_hits(inputs.messages(spark, SF), words, "msg_id"))
    assert scan.phrase_hits(given, words.where("phrase = 'nowhere'"), "id").collect() == []


def test_every_user_keeps_threads(spark, tmp_path):
    turns = spark.range(600).selectExpr("id DIV 2 AS conv_id", "CAST(id % 2 AS INT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "'x' AS text")
    more = spark.range(60).selectExpr("7 + 20 * (id + 100) AS conv_id", "0 AS turn", "'user' AS role", "'x' AS text")
    turns.unionByName(more).write.parquet(str(tmp_path / "conversations.parquet"))
    kept = {r["user_id"]: r["count"] for r in catalog.queries()["archivable_threads"](spark, str(tmp_path)).groupBy("user_id").count().collect()}
    assert kept == {u: 50 if u == 7 else 15 for u in range(20)}


def test_tokens_without_places(spark):
    texts = ["", None, "a bc def", "don't  -x- it's 'q' É1abc", "z", "\n\ta\nb"]
    given = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", F.lower("text"))
    for shortest in (1, 3):
        with_places = fuzzy.tokens(given, "id", F.col("text"), shortest).select("id", "token")
        without = fuzzy.tokens(given, "id", F.col("text"), shortest, places=False)
        assert sorted(map(tuple, without.collect())) == sorted(map(tuple, with_places.collect()))
    for name in ("drop_real_words", "collapse_repeats", "within_one_edit"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and "regexp_extract_all(" in plan, name


def test_edge_hints_and_short_cuts_of_spaces_change_nothing(spark):
    words = ["i", "im", "kill", "lol", "haha", "so funny", "you", "2day", "é", "é1", "xkill", "_kill", "'kill", "a kill", "́kill", "ſkill", "Kkill", "😂", "x😂", "lolx", "jk", "me", "feeling",
             "going to", "kill yourself", "you should die", "\tkill", " lol", " im", "\x1cgo die", " ", "  ", "\n \t", "\x85", "-", "3kill"]
    texts = [a + gap + b for a in words for b in words for gap in ("", " ", "\n ")]
    given = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lower(F.trim(F.regexp_replace(F.translate("t", "’‘", "''"), r"(?U)[\s\x1c-\x1f]+", " ")))
    pairs = [(guards.LAUGH, scan._LAUGH), (guards.RECEIVED_THREAT, scan._THREAT), (guards.MUNDANE, scan._MUNDANE), (guards.SELF_ATTRIBUTION, fuzzy._SELF),
             (r"(?U)(?<!\w)(?:kill|lol|2day|é1)(?!\w)", bounded_phrases(["kill", "lol", "2day", "é1"]))]
    n = F.col("n")
    same = given.select((normalize_text("t") == plain).alias("s"), plain.alias("n")).select(
        "s", *[(F.regexp_extract_all(n, F.lit(a), F.lit(0)) == F.regexp_extract_all(n, F.lit(b), F.lit(0))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    assert {tuple(r) for r in same.distinct().collect()} == {(True,) * (1 + len(pairs))}
    # What makes the scan of long texts cheap: no position behind a plain letter is tried
    assert all("(?<![a-z])(?=" in b for _, b in pairs)
