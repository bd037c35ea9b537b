"""Runs of words against a plain search over all periods, and texts without their repeats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import wordruns


def plain_runs(w, least):
    best = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in best.items())


def document(rng):
    n = rng.randint(0, rng.choice([5, 30, 120, 300]))
    kind, letters = rng.random(), rng.choice([1, 2, 2, 3, 5, 50])
    w = [rng.randrange(letters) for _ in range(n)]
    if kind < 0.4 and n:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 10)
        return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    if kind < 0.5:  # Fibonacci words hold runs of very many periods
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    return [bin(i).count("1") % 2 for i in range(n)] if kind < 0.6 else w


@pytest.mark.parametrize("least", [12, 2, 5])
def test_against_all_periods(least):
    rng, found = random.Random(least), 0
    for _ in range(150):
        docs = [document(rng) for _ in range(rng.randint(1, 6))]
        docs += docs[:2] if rng.random() < 0.5 else []
        d, s, n, q = wordruns.find_runs(np.array([x for t in docs for x in t], dtype=np.int64), np.array([len(t) for t in docs]), least)
        for i, t in enumerate(docs):
            got = [(a, b, c) for a, b, c in zip(s[d == i].tolist(), q[d == i].tolist(), n[d == i].tolist())]
            want = plain_runs(t, least)
            assert got == want
            found += len(want)
    assert found > 500


def test_grammar_gives_back_the_words():
    rng = np.random.default_rng(3)
    words = np.concatenate((rng.integers(0, 4, 500), np.arange(300) % 7, np.zeros(200, dtype=np.int64)))
    doc = np.repeat([0, 1, 2], [500, 300, 200])
    grammar = wordruns.Grammar(words, doc)
    assert grammar.of.size == words.size - 3  # a binary tree over each document
    for rule in range(grammar.length.size):
        places = grammar.at[grammar.of == rule]
        n = grammar.length[rule]
        assert places.size and grammar.first[rule] in places
        assert all((words[p:p + n] == words[places[0]:places[0] + n]).all() and doc[p] == doc[p + n - 1] for p in places)


@pytest.mark.parametrize("words", [np.zeros(400_000), np.arange(400_000) % 5, np.arange(400_000) % 30_000, np.arange(400_000)], ids=["one", "five", "many", "none"])
def test_very_long(words):
    d, s, n, q = wordruns.find_runs(words.astype(np.int64), np.array([words.size]))
    period = int(words.max()) + 1
    assert list(zip(s, n, q)) == ([] if period > 200_000 else [(0, 400_000, period)])


def test_edges(spark):
    song = "la la la " * 10
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, song), (4, song), (None, song + "end"), (5, "a b " * 12), (6, "one two three " * 3),
            (7, "x y " * 60_000), (8, "中 \U0001F600 " * 7 + "\x00 tail"), (2**60, "k " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "n_words", "lang")})
    got = {(r["doc_id"], r["n_words"]): (r["runs"], r["collapsed"]) for r in wordruns.collapse_runs(docs.repartition(3)).collect()}
    assert len(got) == len(rows) - 1
    plain = {k: ([tuple(x) for x in runs], text) for k, (runs, text) in got.items()}
    assert plain[1, 0] == plain[2, 0] == plain[3, 0] == ([], "")
    assert plain[4, 30] == ([(0, 30, 1)], "la") and plain[None, 31] == ([(0, 30, 1)], "la end")
    assert plain[5, 12] == ([(0, 12, 1)], "a b") and plain[6, 9] == ([], "one two three " * 2 + "one two three")
    assert plain[7, 120_000] == ([(0, 120_000, 2)], "x y") and plain[8, 16] == ([(0, 14, 2)], "中 \U0001F600 \x00 tail")
    assert plain[2**60, 12] == ([(0, 12, 1)], "k")
    assert wordruns.collapse_runs(docs.where("false")).count() == 0
    assert wordruns.collapse_runs(docs.select(F.col("doc_id").cast("string"), "text")).count() == len(rows)
