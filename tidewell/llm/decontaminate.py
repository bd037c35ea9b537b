"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

Words are runs of digits, letters and non-ASCII characters, A-Z folded. A phrase is `WINDOW` consecutive words of a
benchmark item, or the whole item if it has fewer. A task turns its documents, shard by shard, into word numbers.
Words that no phrase has can be in no occurrence; they cut the text, and pieces shorter than the shortest phrase are
left out of the index (never out of the counts). The shard's Burrows-Wheeler transform is kept in a wavelet matrix;
all phrases are searched backwards at once by its ranks, and occurrences are located from sampled suffix positions.
Overlapping occurrences merge into removal spans.

The benchmark is broadcast; its size is checked against `MOST_BENCHMARK_CHARS`. Documents are not shuffled and nothing is gathered
on the driver. Null text has no words; without words or without phrases nothing is hit. A repeated document row is judged
like the first; an item_id that occurs on several rows counts once; a null item_id is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.llm.common import LOWER, UPPER, read, sha256_hex
from tidewell.llm.registry import query

WINDOW, SHARD_WORDS, SAMPLE_EVERY = 10, 1 << 21, 8
MOST_BENCHMARK_CHARS = 200_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BLANKS = bytes(32 if i < 48 or 58 <= i <= 96 or 123 <= i <= 127 else i for i in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().translate(_BLANKS).split()


class Phrases:
    """The distinct phrases of a benchmark, grouped by length, as word numbers from 1 up."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        of_items: dict[tuple, set[str]] = {}
        for item, text in items:
            w = words(text or "")
            n = min(len(w), window)
            for i in range(len(w) - n + 1 if n else 0):
                of_items.setdefault(tuple(w[i:i + n]), set()).add(item)
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for p in of_items for w in p}))}
        self.shortest = min(map(len, of_items), default=0)
        self.groups = []
        for n in sorted({len(p) for p in of_items}):
            same = [p for p in of_items if len(p) == n]
            codes = np.array([[self.number[w] for w in p] for p in same], dtype=np.int64)
            self.groups.append((codes, [of_items[p] for p in same]))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling."""
    n = symbols.size
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:-step or n] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """rank(symbols, positions): how often each symbol stands before each position."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if values.size else 1
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(values.size - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[low], ones[at]
            low = np.where(bit, zeros + a, low - a)
            at = np.where(bit, zeros + b, at - b)
        return at - low


class FMIndex:
    """Over pieces of word numbers (from 1 up); 0 in `text` stands before the first and after every piece."""

    def __init__(self, text: np.ndarray):
        cuts = np.flatnonzero(text == 0)
        symbols = text + cuts.size
        symbols[cuts] = np.arange(cuts.size)  # every cut is unlike any other, so no comparison runs past a piece
        order = suffix_order(symbols)
        self.last = text[order - 1]  # the transform; cuts all read 0 and are never searched
        counts = np.bincount(text)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.tree = WaveletMatrix(self.last)
        sampled = (order % SAMPLE_EVERY == 0) | (self.last == 0)
        self.sampled, self.samples = sampled, order[sampled]
        self.sample_at = np.cumsum(sampled) - 1
        self.top = counts.size

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.last.size, dtype=np.int64)
        alive = np.arange(len(phrases))
        for at in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, at]
            known = c < self.top
            low[alive[~known]] = high[alive[~known]] = 0
            alive, c = alive[known], c[known]
            if not alive.size:
                break
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        high[low >= high] = low[low >= high]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found = np.empty(rows.size, dtype=np.int64)
        left, steps = np.arange(rows.size), 0
        while left.size:
            done = self.sampled[rows]
            found[left[done]] = self.samples[self.sample_at[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.last[rows].astype(np.int64)
            rows = self.before[c] + self.tree.rank(c, rows)
            steps += 1
        return found


def search_shard(numbers: list[np.ndarray], phrases: Phrases) -> list[tuple[set[str], list[list[int]]]]:
    """Per document, given as word numbers: the items that occur in it, and merged [start, end) spans of words."""
    out: list[tuple[set[str], list[list[int]]]] = [(set(), []) for _ in numbers]
    sizes = np.array([n.size for n in numbers], dtype=np.int64)
    total = int(sizes.sum())
    if not total or not phrases.groups:
        return out
    codes = np.concatenate(numbers).astype(np.int64)
    doc = np.repeat(np.arange(len(numbers), dtype=np.int32), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = codes > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    piece = np.cumsum(opens) - 1
    lengths = np.bincount(piece[inside], minlength=0)
    kept = np.flatnonzero(inside)
    kept = kept[lengths[piece[kept]] >= phrases.shortest]
    if not kept.size:
        return out
    fresh = np.concatenate(([True], piece[kept][1:] != piece[kept][:-1]))
    place = np.arange(kept.size) + np.cumsum(fresh)  # a cut before every piece
    text = np.zeros(place[-1] + 2, dtype=np.int64)
    text[place] = codes[kept]
    origin = np.zeros(text.size, dtype=np.int64)
    origin[place] = kept
    index = FMIndex(text)
    edges = np.zeros(total + 1, dtype=np.int64)
    for group, items in phrases.groups:
        low, high = index.search(group)
        many = high - low
        which = np.repeat(np.arange(len(group)), many)
        if not which.size:
            continue
        rows = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        at = origin[index.locate(rows)]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + group.shape[1], -1)
        for d, p in set(zip(doc[at].tolist(), which.tolist())):
            out[d][0].update(items[p])
    hit = np.cumsum(edges[:-1]) > 0
    begins = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & (doc[1:] == doc[:-1]))))
    ends = np.flatnonzero(hit & ~np.concatenate((hit[1:] & (doc[1:] == doc[:-1]), [False]))) + 1
    for b, e in zip(begins.tolist(), ends.tolist()):
        d = int(doc[b])
        out[d][1].append([b - int(starts[d]), e - int(starts[d])])
    return out


def load_phrases(benchmark: DataFrame, window: int = WINDOW) -> Phrases:
    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), "text")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > MOST_BENCHMARK_CHARS:
        raise ValueError(f"the benchmark has {chars} characters, more than may be broadcast ({MOST_BENCHMARK_CHARS}); search it in parts")
    return Phrases([tuple(r) for r in known.collect()], window)


def _shards(batches: Iterator[pd.DataFrame], phrases: Phrases) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Slices of the batches with their word numbers and findings; a shard ends at `SHARD_WORDS` words or with its batch.

    The words of one text are held at a time; of the others only the numbers.
    """
    get = phrases.number.get
    for batch in batches:
        begin, numbers, size = 0, [], 0
        for i, text in enumerate(batch["text"]):
            found = words(text or "")
            numbers.append(np.fromiter((get(w, 0) for w in found), dtype=np.int32, count=len(found)))
            size += len(found)
            if size >= SHARD_WORDS or i == len(batch) - 1:
                yield batch.iloc[begin:i + 1], numbers, search_shard(numbers, phrases)
                begin, numbers, size = i + 1, [], 0


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), spans ([start, end) in words, merged) per document."""
    sent = docs.sparkSession.sparkContext.broadcast(load_phrases(benchmark, window))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, numbers, found in _shards(batches, sent.value):
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "n_words": [n.size for n in numbers],
                "n_hit": [sum(e - b for b, e in spans) for _, spans in found],
                "items": [sorted(items) for items, _ in found], "spans": [spans for _, spans in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<array<int>>")


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between words of one span."""
    if not len(spans):
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for b, e in spans:
        out.append(text[at:places[b][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the removal spans cut from their texts, n_chars counted anew; texts with no word left go.

    A document that is not hit stays as it is, also if it is null or empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_phrases(benchmark, window))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for part, _, found in _shards(iter([pd.DataFrame({"text": texts})]), sent.value):
            for text, (_, spans) in zip(part["text"], found):
                left = text if not spans else cut_spans(text, spans)
                out.append(left if not spans or WORD.search(left) else "\x00")
        return pd.Series(out, dtype=object)

    # Not deterministic for the optimizer, which would otherwise search every text twice, in two workers at a time: for the filter and for the result
    gone = F.col("text").isNotNull() & (F.col("text") == "\x00")
    out = docs.withColumn("text", cleaned.asNondeterministic()(F.col("text"))).where(~gone)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _sql() -> str:
    def split(key: str, table: str) -> str:
        return (f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
                rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}")
    return f"""
WITH d AS ({split("doc_id", "documents")}), b AS ({split("CAST(item_id AS VARCHAR) AS item_id", "benchmark WHERE item_id IS NOT NULL")}),
sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
spots AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM spots),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) q
    JOIN phrases p USING (n, s)),
marked AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)"""


def digest(found: DataFrame) -> list[Column]:
    return ["doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            sha256_hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")]


@query("op10_fm_decontamination", _sql())
def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(*digest(found))
