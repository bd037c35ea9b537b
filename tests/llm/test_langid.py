"""Sums over segmentations and learnt probabilities against enumeration, and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid
from tidewell.llm.catalog import queries

MIDDLE = "/root/testdata/sf0.1"


def cuts(word, pieces):
    """All segmentations, as tuples of piece numbers; a character that is no piece is piece 0."""
    if not word:
        return [()]
    out = []
    for n in range(1, len(word) + 1):
        piece = pieces.index(word[:n]) if word[:n] in pieces else 0 if n == 1 else None
        out += [] if piece is None else [(piece, *rest) for rest in cuts(word[n:], pieces)]
    return out


PIECES = ("", "a", "ab", "aba", "b", "ba", "é", langid.MARK, langid.MARK + "a", langid.MARK + "ab")


def model(rng, langs):
    p = np.array([[rng.random() + 0.01 for _ in PIECES] for _ in langs])
    return langid.Model(langs, PIECES, np.log(p / p.sum(axis=1, keepdims=True)))


def test_sums_over_all_segmentations():
    rng = random.Random(2)
    now = model(rng, ["x", "y", "z"])
    words = ["".join(rng.choice("abéq") for _ in range(rng.randint(1, 9))) for _ in range(80)] + ["a", "\U0001D552b"]
    got = langid.word_scores(words, now)
    for word, row in zip(words, got):
        for lang in range(3):
            want = math.log(sum(math.exp(sum(now.logp[lang, p] for p in cut)) for cut in cuts(langid.MARK + word, PIECES)))
            assert abs(row[lang] - want) < 1e-9
    of = np.array([rng.randrange(3) for _ in words])
    n = np.array([rng.randint(1, 5) for _ in words])
    want = np.zeros(now.logp.shape)
    for word, lang, times in zip(words, of, n):
        ways = cuts(langid.MARK + word, PIECES)
        p = [math.exp(sum(now.logp[lang, x] for x in cut)) for cut in ways]
        for cut, share in zip(ways, p):
            for x in cut:
                want[lang, x] += times * share / sum(p)
    assert np.allclose(langid.expected(words, of, n, now), want)


def test_long_words_do_not_underflow():
    now = model(random.Random(5), ["x"])
    one, two = langid.word_scores(["ab" * 3_000, "ab" * 6_000], now)[:, 0]
    assert -1e5 < two < one < -1_000 and abs(two - 2 * one) < 10


def test_learning_is_expectation_maximisation(spark, monkeypatch):
    monkeypatch.setattr(langid, "vocabulary", lambda path: PIECES)
    rows = [("x", "abab ba!"), ("x", "Ab, aba"), ("y", "éb éa"), ("y", None), (None, "ab"), ("z", "12 ..."), ("x", "abab ba!")]
    learnt = langid.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3), rounds=2)
    assert learnt.langs == ["x", "y"]
    words = {"x": ["abab", "ba", "ab", "aba", "abab", "ba"], "y": ["éb", "éa"]}
    logp = np.full((2, len(PIECES)), -math.log(len(PIECES)))
    for _ in range(2):
        uses = np.full(logp.shape, langid.SMOOTH)
        for i, lang in enumerate(learnt.langs):
            for w in words[lang]:
                ways = cuts(langid.MARK + w, PIECES)
                p = [math.exp(sum(logp[i, x] for x in cut)) for cut in ways]
                for cut, share in zip(ways, p):
                    for x in cut:
                        uses[i, x] += share / sum(p)
        logp = np.log(uses / uses.sum(axis=1, keepdims=True))
    assert np.allclose(learnt.logp, logp)


@pytest.fixture(scope="module")
def table(spark):
    texts = {"en": "the house stands at the end of the road", "de": "das Haus steht am Ende der Straße", "fr": "la maison est au bout de la rue"}
    rows = [(i, texts[lang], lang) for i, lang in enumerate(["en", "de", "fr"] * 5)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 - 3 ½ !", "fr"), (None, "la rue", None), (103, "THE ROAD", "en"), (103, "THE ROAD", "en"),
             (104, "Straße " * 50_000, "de"), (2**60, "école maison", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("word", "n", "score", "lang_pred", "piece")})


def test_edges(table):
    learnt = langid.learn(table)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(table, learnt).collect()]
    assert len(got) == 23 and all(0 <= s <= 1 for _, _, s in got)
    by = {i: (lang, s) for i, lang, s in got}
    assert by[100] == by[101] == by[102] == ("und", 0.0) and by[None][0] == "fr" and by[103][0] == "en" and by[104] == ("de", 1.0) and by[2**60][0] == "fr"
    assert [by[i][0] for i in range(3)] == ["en", "de", "fr"]
    assert langid.identify(table.where("false"), learnt).count() == 0
    nothing = langid.learn(table.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(table, nothing).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    got = queries()["op12_langid"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet"), "doc_id").where("held_out").collect()
    letters = [r for r in got if any(c.isalpha() for c in r["text"] or "")]
    assert len(letters) > 2000 and sum(r["lang_pred"] == r["lang"] for r in letters) / len(letters) > 0.98
    assert {r["lang_pred"] for r in got} - {"und"} <= {r["lang"] for r in got}
