"""The keyword scan against hand-written ranges, and against its own parts."""

import re
import random

from pyspark.sql import functions as F

from tidewell.functions.text import hinted, literal_starts, match_spans, normalize_text, phrase_pattern
from tidewell.operators import fuzzy, guards, scan
from tidewell.operators.evaluation import evaluate_cases
from tidewell.sources.lexicon import SHIPPED, read_lexicon

# (text, lowest level, highest level): silent, jokes, level 1, level 2, crisis, threats, misspellings, attribution.
CASES = [
    ("when does the cafeteria open tomorrow", 0, 0), ("my laptop is dead again", 0, 0),
    ("he cut himself off in traffic", 0, 0), ("i cut myself some cake", 0, 0), ("cutting paper for art class", 0, 0),
    ("this song is to die for", 0, 0), ("", 0, 0), ("   ", 0, 0), ("my boss", 0, 0), ("tonight", 0, 0),
    ("im dead lol that clip", 0, 0), ("i want to die haha", 0, 0), ("i give up on this puzzle", 0, 0),
    ("i give up with more homework coming", 0, 0), ("running on empty today and i am slow", 0, 0),
    ("i'm so stressed out because of school", 2, 2), ("my friend is worn out", 1, 1), ("screw this test", 1, 1),
    ("i am so fried for the finals", 1, 1),
    ("i feel completely overwhelmed by everything", 2, 2), ("i give up", 2, 2), ("i can't take this anymore", 2, 2),
    ("nobody cares about me", 2, 2), ("I’m   falling\tapart", 2, 2),
    ("haha i want to kill myself", 4, 4), ("kms lmao", 4, 4), ("i might stab my boss tomorrow", 4, 4),
    ("she said she wants to hurt themselves", 4, 4), ("i keep thinking about ending my life", 4, 4),
    ("they threatened to follow me home", 4, 4), ("no reason to live", 4, 4),
    ("i will hurt you", 3, 3), ("you are worthless", 3, 3), ("watch your back", 3, 3), ("i will hurt you lol", 0, 0),
    ("i feel so lonley", 3, 3), ("im exhuasted", 1, 1), ("i am soooo tiredd", 1, 1), ("i was scared", 2, 2),
    ("i feel scared", 2, 2), ("the dog is sad", 0, 0), ("i am drawing along the sacred wall", 0, 0),
    ("i feel alone jk", 0, 0),
]


def _scan(spark, texts):
    matchers = scan.load_matchers(read_lexicon(spark, str(SHIPPED)))
    cases = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "case_id long, text string")
    return scan.scan_messages(cases, matchers)


def test_ranges(spark):
    expected = spark.createDataFrame([(i, lo, hi) for i, (_, lo, hi) in enumerate(CASES)],
                                     "case_id long, min_level int, max_level int")
    judged = evaluate_cases(expected, _scan(spark, [c[0] for c in CASES])).collect()
    wrong = [(CASES[r["case_id"]], r["level"]) for r in judged if not r["ok"]]
    assert not wrong


def test_laughing_never_raises_a_level(spark):
    texts = [c[0] for c in CASES]
    before = {r["case_id"]: r["level"] for r in _scan(spark, texts).collect()}
    after = {r["case_id"]: r["level"] for r in _scan(spark, [t + " lol" for t in texts]).collect()}
    assert all(after[k] <= before[k] for k in before)


def test_hits_and_shape(spark):
    row = _scan(spark, ["lol i want to kill myself"]).first()
    assert row["tier3"] and row["matched"] and row["categories"] == ["crisis"] and row["level_name"] == "crisis"
    assert [tuple(h) for h in row["hits"]] == [("i want to kill myself", "crisis", "3"), ("kill myself", "crisis", "3")]
    assert not row["joking_context"]
    assert not [c for c in row.asDict() if c.startswith("_")]


def test_spans_equal_finditer(spark):
    texts = ["", "aa", "lol x lol", "é lol😂 loool", "no match", "lol" * 3 + " " + " lol" * 300]
    pattern = r"lo+l|x"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", match_spans(F.col("t"), pattern).alias("m")).collect()
    for r in rows:
        assert [(m["s"], m["e"], m["t"]) for m in r["m"]] == [
            (m.start(), m.end(), m.group()) for m in re.finditer(pattern, r["t"])]


def test_normalize(spark):
    row = spark.createDataFrame([("  It’s  A\n\ttest ",), (None,)], "t string").select(
        normalize_text("t").alias("n")).collect()
    assert [r["n"] for r in row] == ["it's a test", ""]


def test_phrase_pattern_is_longest_first():
    words = ["kill", "kill me", "kill me now", "ki", "a.b"]
    trie = re.compile(r"(?<!\w)(?:" + phrase_pattern(words) + r")(?!\w)")
    plain = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?!\w)")
    for text in ("kill me now", "kill me nowhere", "ki kill", "a.b axb", "kills"):
        assert [m.span() for m in trie.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_hints_keep_every_match():
    assert literal_starts(r"(?iU)\b(?:i'm|im|he\ is)\s+x") == {"i", "h"}
    assert literal_starts(r"\b(?:[ab]c|d)x") is None and literal_starts(r"\b(?:a?b|d)x") is None
    assert hinted("(?U)ab|cd", ["a", "c"]) == "(?U)(?=(?:a|c))(?:ab|cd)"


def _one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        return len(diff) == 1 or (len(diff) == 2 and diff[1] == diff[0] + 1
                                  and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def _fold(word):
    return re.sub(r"(.)\1+", r"\1", word)


def test_misspellings_against_brute_force(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz'"
    tokens = set()
    for word in guards.FUZZY_WORDS:
        for _ in range(25):
            t = list(word)
            for _ in range(rng.randint(0, 2)):
                i, kind = rng.randrange(len(t)), rng.randrange(5)
                if kind == 0:
                    t.insert(i, rng.choice(letters))
                elif kind == 1 and len(t) > 2:
                    del t[i]
                elif kind == 2:
                    t[i] = rng.choice(letters)
                elif kind == 3 and i + 1 < len(t):
                    t[i], t[i + 1] = t[i + 1], t[i]
                else:
                    t.insert(i, t[i])
            tokens.add("".join(t))
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    rows = frame.select("t", fuzzy.canonical_word(F.col("t"))["word"].alias("w"),
                        F.col("t").rlike("^" + fuzzy._CANDIDATES + "$").alias("shaped")).collect()
    for r in rows:
        want = next((w for w in guards.FUZZY_WORDS if (
            _fold(r["t"]) == _fold(w) if len(w) < 4 else _one_edit(_fold(r["t"]), _fold(w)) or _one_edit(r["t"], w))), None)
        assert r["w"] == want, r
        assert want is None or r["shaped"], r


def test_dictionary_words_are_not_misspellings(spark):
    matchers = scan.load_matchers(read_lexicon(spark, str(SHIPPED)))
    text = spark.createDataFrame([(1, "i am tined")], "case_id long, text string")
    words = spark.createDataFrame([("tined",), ("tired",), ("zebra",)], "word string")
    assert scan.scan_messages(text, matchers).first()["level"] == 1
    assert scan.scan_messages(text, matchers, words=words).first()["level"] == 0


def test_phrase_hits_by_join(spark):
    texts = spark.createDataFrame([(1, "Please: kill that guy, now"), (2, "skill that guy")], "id long, text string")
    words = spark.createDataFrame([("kill that guy", "crisis"), ("now", "time")], "phrase string, category string")
    rows = {tuple(r) for r in scan.phrase_hits(texts, words, "id").collect()}
    assert rows == {(1, "kill that guy", "crisis"), (1, "now", "time")}
