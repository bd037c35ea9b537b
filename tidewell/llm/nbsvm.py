"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Indicators of a text (each counts once, however often it occurs), hashed into `DIMS` places:
  - n-grams (1 to 5) of its shape: letters become A or a, digits 9, runs of one letter class collapse, other
    characters stay;
  - words, folded to lower case;
  - runs of one word repeated 2, 3, 4 or 5 times (the word n-gram "w w ...").
The ratio of an indicator is log((p + a) / (P + 2a)) - log((q + a) / (Q + 2a)) over the documents of either
class; indicators in fewer than `LEAST` documents weigh nothing. The model is fitted by dual coordinate
descent on at most `FIT_ROWS` labelled rows (a documented bound), two folds of which calibrate the score by
a sigmoid. Without labels the score is 0.5; with labels of one class it is that class.

Null text is the empty text, which is scored by the bias alone. Whole texts are read, in slices for the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.llm.common import read
from tidewell.llm.labelled import FIT_ROWS, fit_sample, remainder
from tidewell.llm.registry import query

DIMS, LEAST, SMOOTH, GRAMS = 1 << 18, 5, 1.0, 5
COST, EPOCHS, THRESHOLD = 0.5, 12, 0.7
SLICE = 1 << 20


def _classes() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[ord("a"):ord("z") + 1] = kind[128:] = ord("a")
    kind[ord("A"):ord("Z") + 1] = ord("A")
    kind[ord("0"):ord("9") + 1] = ord("9")
    kind[9:14] = ord(" ")
    return kind


KIND = _classes()
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _place(codes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (codes + np.uint64(salt * 0x632BE5AB)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MULTIPLIER) >> np.uint64(46)).astype(np.int64)


def indicators(text: str) -> np.ndarray:
    """Sorted distinct places of a text's indicators."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if not raw.size:
        return np.zeros(0, dtype=np.int64)
    shape = KIND[raw]
    letters = (shape == ord("a")) | (shape == ord("A")) | (shape == ord("9")) | (shape == ord(" "))
    keep = np.ones(raw.size, dtype=bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~letters[1:]
    shape = shape[keep].astype(np.uint64)
    seen = np.zeros(DIMS, dtype=bool)
    for at in range(0, shape.size, SLICE):
        part = shape[at:at + SLICE + GRAMS - 1]
        codes = part
        for n in range(1, GRAMS + 1):
            if n > 1:
                codes = codes[:-1] * np.uint64(256) + part[n - 1:]
            if codes.size:
                seen[_place(codes, n)] = True
    lower = raw.copy()
    capitals = (raw >= 65) & (raw <= 90)
    lower[capitals] += 32
    space = (KIND[raw] == 32)
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if starts.size:
        value = np.where(space, 0, lower).astype(np.uint64) + np.uint64(1)
        ends = np.append(starts[1:], raw.size)
        first = np.concatenate((np.zeros(starts[0], dtype=np.int64), np.repeat(starts, ends - starts)))
        offset = np.arange(raw.size) - first
        power = _POWERS[offset % _POWERS.size]
        words = np.add.reduceat(np.where(space, np.uint64(0), value * power), starts)
        seen[_place(words, 11)] = True
        same = words[1:] == words[:-1]
        for n in range(2, 6):
            if same.size and same.any():
                seen[_place(np.array([n], dtype=np.uint64), 13)] = True
                same = same[1:] & same[:-1]
    return np.flatnonzero(seen)


def _powers() -> np.ndarray:
    out = np.empty(4096, dtype=np.uint64)
    step = 0x100000001B3
    value = 1
    for i in range(out.size):
        out[i] = value
        value = value * step % (1 << 64)
    return out


_POWERS = _powers()


def log_ratios(sample: DataFrame) -> tuple[np.ndarray, int, int]:
    """The ratio per place, and the number of documents of either class. Counts are summed per task first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, DIMS + 1), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                sums[int(y > 0), indicators(text)] += 1
                sums[int(y > 0), DIMS] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"place": used, "q": sums[0, used], "p": sums[1, used]})

    rows = sample.mapInPandas(count, "place long, q long, p long").groupBy("place").agg(
        F.sum("q").alias("q"), F.sum("p").alias("p")).toPandas()  # at most DIMS + 1 rows
    p, q = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    p[rows["place"]], q[rows["place"]] = rows["p"], rows["q"]
    docs_p, docs_q = p[DIMS], q[DIMS]
    ratio = np.log((p[:DIMS] + SMOOTH) / (docs_p + 2 * SMOOTH)) - np.log((q[:DIMS] + SMOOTH) / (docs_q + 2 * SMOOTH))
    ratio[p[:DIMS] + q[:DIMS] < LEAST] = 0.0
    return ratio, int(docs_p), int(docs_q)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST,
                 epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last one the bias, of the L1-loss linear model over rows scaled to unit length."""
    weights = np.zeros(DIMS + 1)
    alpha = np.zeros(len(rows))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(rows) * cost
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / (np.sqrt((v * v).sum()) or 1.0))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (weights[r] @ v + weights[DIMS]) - 1.0
            new = min(max(alpha[i] - slope / (v @ v + 1.0), 0.0), share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[r] += step * v
                weights[DIMS] += step
                alpha[i] = new
    return weights


def margin(text: str, ratio: np.ndarray, weights: np.ndarray) -> float:
    places = indicators(text)
    v = ratio[places]
    return float(weights[places] @ v / (np.sqrt((v * v).sum()) or 1.0) + weights[DIMS])


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibration, by Newton steps on smoothed targets; the slope stays positive."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    if not pos or not neg:
        return 2.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w, d = p * (1 - p) + 1e-9, p - target
        hessian = np.array([[w @ (m * m) + 1e-3, w @ m], [w @ m, w.sum()]])
        step = np.linalg.solve(hessian, np.array([d @ m + 1e-3 * (a - 1), d.sum()]))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(sample: DataFrame) -> tuple:
    """(ratio, weights, slope, offset, share of class 1); weights are None where only one class is known."""
    ratio, pos, neg = log_ratios(sample.where("fold < 8"))
    if not pos or not neg:
        return ratio, None, 0.0, 0.0, (pos / (pos + neg) if pos + neg else 0.5)

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fold", "text"], kind="stable")
        rows = [indicators(t) for t in frame["text"]]
        y = np.where(frame["y"] > 0, 1.0, -1.0)
        use = (frame["fold"] < 8).to_numpy()
        weights = dual_descent([r for r, u in zip(rows, use) if u], y[use], ratio)
        held = [i for i in range(len(rows)) if not use[i]]
        m = np.array([float(weights[rows[i]] @ ratio[rows[i]] / (np.sqrt((ratio[rows[i]] ** 2).sum()) or 1.0) + weights[DIMS])
                      for i in held])
        a, b = sigmoid_fit(m, y[held])
        return pd.DataFrame({"weights": [weights.tobytes()], "a": [a], "b": [b]})

    # One task, over at most FIT_ROWS rows
    out = sample.groupBy(F.lit(0).alias("g")).applyInPandas(train, "weights binary, a double, b double").first()
    return ratio, np.frombuffer(out["weights"]), out["a"], out["b"], pos / (pos + neg)


def score(text: Column, model: tuple, spark: SparkSession) -> Column:
    """The score (0 to 1) of a text column."""
    ratio, weights, a, b, share = model
    if weights is None:
        return F.lit(float(share))
    sent = spark.sparkContext.broadcast((ratio, weights))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        r, w = sent.value
        m = np.array([margin(t or "", r, w) for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))))

    return scored(text)


def quality(docs: DataFrame, labels: DataFrame, of: int = 4, held: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.7), a row per row of `docs`."""
    model = fit(fit_sample(docs, labels, "quality", of, held, rows))
    return docs.select("doc_id", "text").select(
        "doc_id", (remainder(of) == held).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, of: int = 4, held: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs`, all their columns, that the classifier accepts."""
    model = fit(fit_sample(docs, labels, "quality", of, held, rows))
    return docs.where(score(F.col("text"), model, docs.sparkSession) >= THRESHOLD)


@query("op6_nbsvm_quality")
def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
