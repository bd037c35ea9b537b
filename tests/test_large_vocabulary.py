"""Phrases found by a join: the same hits as by patterns, and a vocabulary far too large for them."""

import json
import random
import re

from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.sources.lexicon import Lexicon, read_lexicon, shipped_lexicon
from tests.test_scan import CASES

COLUMNS = ("level", "level_name", "tier3", "matched", "categories", "hits", "joking_context", "received_threat")


def rows_of(scanned):
    return sorted((str(r["case_id"]), *[str(r[c]) for c in COLUMNS]) for r in scanned.collect())


def both_ways(spark, lexicon, texts):
    cases = spark.createDataFrame(texts, "case_id long, text string").withColumn("phrase", F.lit("clash"))
    by_pattern = scan.scan_messages(cases, scan.load_matchers(lexicon))
    by_join = scan.scan_messages(cases, scan.load_matchers(lexicon, literals=False), vocabulary=scan.literal_vocabulary(lexicon), key=["case_id"])
    assert by_join.columns == by_pattern.columns
    return rows_of(by_pattern), rows_of(by_join)


def test_shipped_lexicon(spark):
    texts = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(500, None), (None, "i give up"), (501, "i give up i give up, kms!"), (501, "he wants to kill that guy")]
    texts += [(600 + i, f"{a} and {b}") for i, (a, b) in enumerate(zip([c[0] for c in CASES], [c[0] for c in reversed(CASES)]))]
    one, two = both_ways(spark, shipped_lexicon(spark), texts)
    assert one == two and len(one) == len(texts)


def test_odd_phrases(spark, tmp_path):
    """Overlaps, prefixes, signs at the ends and in the middle, signs alone, accents."""
    rng = random.Random(12)
    words = ["kill", "end", "me", "it", "all", "can't", "é", "ö_k", "x1", "now"]
    phrases = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)}
    phrases |= {"'em all", "stop!", "!!", "end-it", "💀", "💀 me", "now...", "-x1-", "me,it"}
    targets, actions = ["me", "it", "me now", "them all", "'em"], ["kill", "end", "end it", "kill it all", "stop!"]
    (tmp_path / "l3.json").write_text(json.dumps({
        "level": 3, "name": "l3", "exact_high_precision_phrases": sorted(phrases),
        "components": {"violent_actions": actions, "person_targets": targets, "states": sorted(phrases)[:40]}}))
    glue = ["", " ", " ", " ", ", ", "!", "!!", "-", "' ", "'", "... ", "💀", " 💀 "]
    texts = [(i, "".join(rng.choice(words + ["them", "stop", "em", "zzz"]) + rng.choice(glue) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    one, two = both_ways(spark, read_lexicon(spark, str(tmp_path)), texts)
    wrong = [(a, b) for a, b in zip(one, two) if a != b]
    assert not wrong, wrong[:3]
    assert sum("crisis" in r[5] for r in one) > 200


def test_a_million_phrases(spark):
    n = 1_000_000
    spelled = spark.range(n).select(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" on the "), (F.col("id") % 977).cast("string")).alias("phrase"))
    shipped = shipped_lexicon(spark)
    phrases = spelled.select(F.lit(2).alias("severity"), F.lit("major_stress").alias("category"), F.lit("exact").alias("slot"), "phrase")
    lexicon = Lexicon(shipped.patterns.where("kind = 'rule'"), phrases, shipped.slots.where("false"))
    rng, texts = random.Random(3), []
    for i in range(300):
        ids = [rng.randrange(2 * n) for _ in range(rng.randint(0, 3))]
        texts.append((i, " then ".join(f"word{j} on the {j % 977 if rng.random() < 0.7 else 5}" for j in ids) or "nothing here"))
    cases = spark.createDataFrame(texts, "case_id long, text string")
    got = {r["case_id"]: sorted(h["phrase"] for h in r["hits"]) for r in scan.scan_messages(
        cases, scan.load_matchers(lexicon, literals=False), vocabulary=scan.literal_vocabulary(lexicon), key=["case_id"]).collect()}
    known = lambda j, k: int(j) < n and int(k) == int(j) % 977
    want = {i: sorted({m.group() for m in re.finditer(r"word(\d+) on the (\d+)", t) if known(m.group(1), m.group(2))}) for i, t in texts}
    assert got == want and sum(map(len, want.values())) > 50
