"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text (`FEATURES`): the share of its words that are in the lexicon, as written and after undoing
obfuscation, by whole word and by word stem; the share of lexicon words that stand within `NEAR` words of a second
person pronoun; shares of capitals, punctuation, exclamation marks and words in capitals; the share of obfuscated
words; and the length. The lexicon is `SEEDS` plus the words and stems (first 4, 5 or 6 letters) that labelled
toxic documents hold far more often than others. Folds of the labelled rows: 0-3 teach the lexicon, 4-7 the trees,
8-9 the calibration, so that each is judged on rows the step before it has not seen.

At most `FIT_ROWS` labelled rows are used (a documented bound); every document is scored over its whole text.
Null text is the empty text: all features are 0, and it gets a score like any other. Without labels of both classes in the
folds the score is the share of toxic rows, or 0 if there are none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm.common import read, saved
from tidewell.llm.labelled import FIT_ROWS, fit_sample, remainder
from tidewell.llm.registry import query

SEEDS = frozenset((
    "idiot", "moron", "stupid", "trash", "worthless", "disgusting", "pathetic", "scum", "loser", "clown", "dumb", "ugly"))
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "ya", "u", "ur", "tu", "toi", "te", "ton", "ta", "vous", "votre", "du", "dich", "dir", "dein",
    "ihr", "euch", "usted", "ustedes", "ti", "tus", "vos"))
FEATURES = ("word_share", "stem_share", "plain_word_share", "plain_stem_share", "word_count", "stem_count", "second_person",
            "capitals", "shouted", "punctuation", "exclamation", "obfuscated", "length")
LEXICON_SIZE, LEAST_DOCS, LEAST_RATIO, NEAR, THRESHOLD = 5_000, 6, 2.5, 5, 0.7
LETTERS_FOR = str.maketrans("013457@$!|", "oieastasil")
_EDGE = ".,;:!?\"'()[]{}<>*&%#|-_~`…"
_INSIDE = re.compile(r"[\W_\d]")


def plain(word: str) -> str:
    """The word with look-alike digits and signs turned back to letters, inner signs gone, runs of 3 shortened."""
    return re.sub(r"(.)\1\1+", r"\1", _INSIDE.sub("", word.translate(LETTERS_FOR)))


def terms(text: str) -> set[str]:
    """What may enter the lexicon: words and, marked by a final '-', their stems."""
    out = set()
    for raw in set(text.lower().split()):
        word = raw.strip(_EDGE)
        if 3 <= len(word) <= 30:
            out.add(word)
            out.update(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)
    return out


def features(text: str, words: frozenset, stems: frozenset) -> list[float]:
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    lower = [t.strip(_EDGE) for t in text.lower().split()]
    n = len(lower)
    by_word = by_stem = plain_word = plain_stem = hidden = 0
    hits, second, known = [], [], {}
    for at, word in enumerate(lower):
        kind = known.get(word)
        if kind is None:
            w = word in words
            s = word[:4] in stems or word[:5] in stems or word[:6] in stems
            p = _INSIDE.search(word) is not None and plain(word) or ""
            kind = known[word] = (
                w, s, bool(p) and not w and p in words, bool(p) and not s and (p[:4] in stems or p[:5] in stems or p[:6] in stems),
                len(p) > 2 and any(c.isalpha() for c in word), word in SECOND_PERSON)
        if kind[5]:
            second.append(at)
        if kind[0] or kind[1] or kind[2] or kind[3]:
            by_word, by_stem, plain_word, plain_stem = by_word + kind[0], by_stem + kind[1], plain_word + kind[2], plain_stem + kind[3]
            hits.append(at)
        hidden += kind[4]
    close = 0.0
    if hits and second:
        gaps = np.searchsorted(second, hits)
        near = [min(abs(h - second[min(g, len(second) - 1)]), abs(h - second[max(g - 1, 0)])) <= NEAR for h, g in zip(hits, gaps)]
        close = sum(near) / len(near)
    size = len(text)
    capitals = sum(map(str.isupper, text)) / size
    marks = size - sum(map(str.isalnum, text)) - sum(map(str.isspace, text))
    return [by_word / n, by_stem / n, plain_word / n, plain_stem / n, float(by_word + plain_word), float(by_stem + plain_stem), close,
            capitals, sum(1 for t in tokens if len(t) > 1 and t.isupper()) / n, marks / size, text.count("!") / size, hidden / n,
            float(np.log1p(n))]


def learn_lexicon(sample: DataFrame) -> tuple[frozenset, frozenset]:
    """Words and stems, at most `LEXICON_SIZE` of them. Counts are summed per task, then by term."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other, docs = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                (toxic if y > 0 else other).update(terms(text))
                docs[y > 0] += 1
        toxic[""], other[""] = docs[1], docs[0]
        names = list(toxic.keys() | other.keys())
        yield pd.DataFrame({"term": names, "p": [toxic[t] for t in names], "q": [other[t] for t in names]})

    counts = sample.mapInPandas(count, "term string, p long, q long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = saved(counts, "terms")
    total = counts.where("term = ''").first()
    p, q = (total["p"], total["q"]) if total else (0, 0)
    ratio = F.log((F.col("p") + 0.5) / F.lit(p + 1.0)) - F.log((F.col("q") + 0.5) / F.lit(q + 1.0))
    best = counts.where((F.col("term") != "") & (F.col("p") >= LEAST_DOCS)).withColumn("r", ratio).where(
        F.col("r") >= LEAST_RATIO).orderBy(F.desc(F.col("r") * F.log("p")), "term").limit(LEXICON_SIZE).collect()
    learnt = [r["term"] for r in best]
    return SEEDS | {t for t in learnt if t[-1] != "-"}, frozenset(t[:-1] for t in learnt if t[-1] == "-")


def with_features(docs: DataFrame, lexicon: tuple[frozenset, frozenset]) -> DataFrame:
    """`docs` with `features`, an array in the order of `FEATURES`."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        words, stems = sent.value
        return texts.map(lambda t: features(t or "", words, stems))

    return docs.withColumn("features", dense(F.coalesce(F.col("text"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, of: int = 3, held: int = 1, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.7), a row per row of `docs`."""
    sample = saved(fit_sample(docs, labels, "toxic", of, held, rows), "fit")
    lexicon = learn_lexicon(sample.where("fold < 4"))
    known = saved(with_features(sample.where("fold >= 4"), lexicon).select(
        "fold", F.col("y").cast("double").alias("y"), array_to_vector("features").alias("x")), "features")
    seen = {(r["trees"], r["y"]): r["n"] for r in known.groupBy((F.col("fold") < 8).alias("trees"), "y").agg(F.count("*").alias("n")).collect()}
    out = docs.select("doc_id", "text").withColumn("held_out", remainder(of) == held)
    result = ["doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")]
    if len(seen) < 4:
        share = sample.agg(F.avg("y")).first()[0] or 0.0
        return out.withColumn("score", F.lit(float(share))).select(*result)
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.3, seed=7).fit(known.where("fold < 8"))

    def raw(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("raw", vector_to_array("probability")[1])

    steps = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="score").fit(
        raw(known.where("fold >= 8")).select("raw", "y"))
    scored = raw(with_features(out, lexicon).withColumn("x", array_to_vector("features")))
    scored = steps.transform(scored.drop("prediction", "probability", "rawPrediction"))
    return scored.select(*result)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
