"""Periodic runs of words, found on a grammar of the words, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are identical), at least two periods and `LEAST` words long, that no
neighbouring word extends. A task numbers the words of its documents and treats them in slices of about `SLICE_WORDS` words, a longer document as one:

1. Re-Pair: pairs of neighbouring symbols that occur twice or more are replaced by a new symbol, the most frequent first. It goes in rounds: a round replaces
   every pair that is more frequent than the pairs it overlaps (by powers of two, then in a fixed order). What is left of a document when no pair
   repeats is paired up to one symbol. Documents of a slice share their symbols, so copies are looked at once.
2. For each symbol of `LEAST` words or more, the runs that cross the boundary between its two parts are found once, on its first occurrence: for each possible period, how far
   words that far apart agree before and behind the boundary. Periods go by powers of two, so that multiples of a period whose run is known are passed over.
3. A symbol's runs are carried to all places it is derived at. A place where the words around extend the run is part of a longer one, which a symbol further up
   holds whole, so only maximal intervals stay; of equal intervals the smallest period.

Every run lies in exactly one lowest symbol of its document whose boundary it crosses, so none is missed, whatever the grammar. A task holds the words of one batch and the grammar of one slice.

Null text and text without words have no runs and collapse to ''. Rows are judged one by one: a repeated row is given twice, a null doc_id is carried. Nothing is shuffled. Only doc_id and text are
read from `docs`. Very long texts are treated whole; the grammar takes about 100 bytes a word, the search at most `CHUNK` candidates at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import read, sha256_hex
from tidewell.llm.registry import query

LEAST, SLICE_WORDS, CHUNK = 12, 1 << 18, 1 << 22
Edit = Callable[[object, list[bytes]], list[bytes]]


class Grammar:
    """Rules symbol -> (left, right), and all places (`at`, word numbers) where each symbol (`of`) is derived."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.terminals = int(words.max()) + 1 if words.size else 0
        self._rules: list[tuple[np.ndarray, ...]] = []
        self._places: list[tuple[np.ndarray, np.ndarray]] = []
        self._length = np.ones(self.terminals + words.size, dtype=np.int64)
        self._next = self.terminals
        self._seq, self._start, self._doc = words.astype(np.int64), np.arange(words.size), doc
        self._repair()
        self._finish()
        self.left, self.split, self.first, self.length = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (
            list(zip(*self._rules)) or [[]] * 4))
        self.of, self.at = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*self._places)) or [[]] * 2))

    def _replace(self, at: np.ndarray, rule: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """The pairs at the places `at` become symbols, numbered by `rule`; leads: a place of each rule. Returns which places stay."""
        left, start = self._seq[at[leads]], self._start[at[leads]]
        split = self._length[left]
        length = split + self._length[self._seq[at[leads] + 1]]
        fresh = self._next + rule
        self._length[self._next:self._next + leads.size] = length
        self._rules.append((left, split, start, length))
        self._places.append((fresh - self.terminals, self._start[at]))
        self._next += leads.size
        self._seq[at] = fresh
        stays = np.ones(self._seq.size, dtype=bool)
        stays[at + 1] = False
        self._seq, self._start, self._doc = self._seq[stays], self._start[stays], self._doc[stays]
        return stays

    def _repair(self) -> None:
        order = np.random.default_rng(11)
        live = np.ones(self._seq.size, dtype=bool)  # pairs that may occur twice
        while True:
            live[-1:] = False
            live[:-1] &= self._doc[1:] == self._doc[:-1]
            at = np.flatnonzero(live)
            code = self._seq[at] * np.int64(self._length.size) + self._seq[at + 1]
            _, kind, count = np.unique(code, return_inverse=True, return_counts=True)
            often = count[kind] > 1
            if not often.any():
                return
            rank = np.frexp(count)[1] * np.int64(count.size) + order.permutation(count.size) + 1
            at, kind = at[often], kind[often]
            weight = np.zeros(self._seq.size + 2, dtype=np.int64)
            weight[at + 1] = own = rank[kind]
            # Of a pair that overlaps itself, as in "a a a", every second one is taken
            opens = np.ones(at.size, dtype=bool)
            opens[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])
            places = np.arange(at.size)
            nth = places - np.maximum.accumulate(np.where(opens, places, 0))
            taken = (weight[at] <= own) & (weight[at + 2] <= own) & (nth % 2 == 0)
            live = np.zeros(self._seq.size, dtype=bool)
            live[at] = True
            at, kind = at[taken], kind[taken]
            _, leads, rule = np.unique(kind, return_index=True, return_inverse=True)
            live[at] = True
            live[np.maximum(at - 1, 0)] = True
            live = live[self._replace(at, rule, leads)]

    def _finish(self) -> None:
        while True:
            same = self._doc[1:] == self._doc[:-1]
            if not same.any():
                return
            opens = np.concatenate(([True], ~same))
            places = np.arange(self._seq.size)
            nth = places - np.maximum.accumulate(np.where(opens, places, 0))
            at = np.flatnonzero((nth[:-1] % 2 == 0) & same)
            self._replace(at, np.arange(at.size), np.arange(at.size))


def agree(words: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from x and from y on, `most` at most, forwards (step 1) or backwards (-1)."""
    done = np.zeros(x.size, dtype=np.int64)
    active, width = np.flatnonzero(most > 0), 8
    while active.size:
        part = max(1, CHUNK // width)
        going = []
        for i in range(0, active.size, part):
            a = active[i:i + part]
            off = done[a][:, None] + np.arange(width)
            inside = off < most[a][:, None]
            off = np.where(inside, off, 0) * step
            equal = (words[x[a][:, None] + off] == words[y[a][:, None] + off]) & inside
            n = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            done[a] += n
            going.append(a[n == width])
        active, width = np.concatenate(going), min(2 * width, 4096)
    return done


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) for `counts` items an owner."""
    owner = np.repeat(np.arange(counts.size), counts)
    return owner, np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)


def crossing(words: np.ndarray, grammar: Grammar, least: int) -> tuple[np.ndarray, ...]:
    """(rule, offset, length, period) of the runs that cross a rule's boundary, as far as they lie in it."""
    rules = np.flatnonzero(grammar.length >= least)
    s = grammar.first[rules]
    m, e = s + grammar.split[rules], s + grammar.length[rules]
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
    w = words.astype(np.uint64)
    three = np.zeros(words.size + 3, dtype=np.uint64)  # a hash of the three words from here on, to sort out most periods
    if words.size > 2:
        three[:words.size - 2] = w[:-2] * odd[0] + w[1:-1] * odd[1] + w[2:] * odd[2]
    known = np.zeros((3, rules.size), dtype=np.int64)  # period, start and end of the longest run found for a rule
    half, found, low = (e - s) // 2, [], 1
    while low <= (half.max() if rules.size else 0):
        wave = []
        for behind in (True, False):
            # A run of period q that crosses m has q words behind m, or q words before it
            top = np.minimum(half, e - m if behind else m - s)
            use = np.flatnonzero(top >= low)
            counts = np.minimum(top[use], 2 * low - 1) - low + 1
            for part in np.split(use, np.flatnonzero(np.diff(np.cumsum(counts) // CHUNK)) + 1):
                owner, q = ragged(np.minimum(top[part], 2 * low - 1) - low + 1)
                o, q = part[owner], q + low
                near = m[o] - 1 if behind else m[o]
                keep = words[near] == words[near + (q if behind else -q)]
                o, q = o[keep], q[keep]
                p, i, j = known[:, o]
                keep = (p == 0) | (q % np.maximum(p, 1) != 0) | ((m[o] + q > j) if behind else (m[o] - q < i))
                o, q = o[keep], q[keep]
                M, S, E = m[o], s[o], e[o]
                to = q if behind else -q
                ahead = (M + np.maximum(to, 0) + 2 < E) & (three[M] == three[M + to])
                back = (M - 3 + np.minimum(to, 0) >= S) & (three[M - 3] == three[M - 3 + to])
                keep = ahead | back | (np.maximum(q, least - q) < 5)  # of five words or more, three are on one side
                o, q, to, M, S, E = (x[keep] for x in (o, q, to, M, S, E))
                f = agree(words, M, M + to, E - M - np.maximum(to, 0), 1)
                b = agree(words, M - 1, M - 1 + to, M - S + np.minimum(to, 0), -1)
                i, j = M - b + np.minimum(to, 0), M + f + np.maximum(to, 0)
                keep = j - i >= np.maximum(least, 2 * q)
                wave.append((o[keep], i[keep], j[keep], q[keep]))
        o, i, j, q = (np.concatenate(x) for x in zip(*wave))
        by = np.argsort(j - i, kind="stable")
        longer = by[(j - i)[by] > (known[2] - known[1])[o[by]]]
        known[:, o[longer]] = q[longer], i[longer], j[longer]
        found.append((rules[o], i - s[o], j - i, q))
        low *= 2
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 4


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, by document, start and period; words: word numbers of documents of `sizes` words."""
    doc = np.repeat(np.arange(sizes.size), sizes)
    ends = np.cumsum(sizes)
    grammar = Grammar(words, doc)
    rule, offset, length, period = crossing(words, grammar, least)
    by = np.argsort(rule, kind="stable")
    rule, offset, length, period = rule[by], offset[by], length[by], period[by]
    low, high = np.searchsorted(rule, grammar.of, "left"), np.searchsorted(rule, grammar.of, "right")
    has = np.flatnonzero(high > low)
    place, nth = ragged((high - low)[has])
    run = low[has][place] + nth
    s, q = grammar.at[has][place] + offset[run], period[run]
    e = s + length[run]
    d = doc[s]
    opens, shuts = (ends - sizes)[d], ends[d]
    extended = ((s > opens) & (words[s - 1] == words[s - 1 + q])) | ((e < shuts) & (words[np.minimum(e, words.size - 1)] == words[e - q]))
    s, e, q, d = (x[~extended] for x in (s, e, q, d))
    by = np.lexsort((q, e, s))
    s, e, q, d = s[by], e[by], q[by], d[by]
    once = np.ones(s.size, dtype=bool)
    once[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q, d = (x[once] for x in (s, e, q, d))
    by = np.lexsort((q, s))
    return d[by], (s - (ends - sizes)[d])[by], (e - s)[by], q[by]


def _collapsed(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[dict], bytes]]:
    """The runs and the collapsed text of each document of a slice."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for t in texts for w in t]
    words = pd.factorize(flat)[0].astype(np.int64)
    doc, start, length, period = find_runs(words, sizes, least)
    bounds = np.searchsorted(doc, np.arange(sizes.size + 1))
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield [], b" ".join(text)
            continue
        s, n, q = start[a:b], length[a:b], period[a:b]
        gone = np.zeros(sizes[i] + 1, dtype=np.int64)
        np.add.at(gone, s + q, 1)
        np.add.at(gone, s + n, -1)
        kept = np.cumsum(gone[:-1]) == 0
        yield [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), n.tolist(), q.tolist())], b" ".join(compress(text, kept.tolist()))


def collapse_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed: the words that no run repeats; a row per row of `docs`.

    A word is left out if any run holds it after that run's first period. `edit(doc_id, words)`, if given, changes a document's words (UTF-8) first.
    """
    id_type = docs.schema["doc_id"].dataType
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def treat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in batch.column("text")]
            if edit:
                texts = [edit(i, t) for i, t in zip(ids.to_pylist(), texts)]
            out, at = [], 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end]) <= SLICE_WORDS):
                    total += len(texts[end])
                    end += 1
                out += _collapsed(texts[at:end], least)
                at = end
            collapsed = pa.array([c for _, c in out], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids.cast(to_arrow_type(id_type)), pa.array([len(t) for t in texts], pa.int64()), pa.array([r for r, _ in out], runs_type), collapsed],
                ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {id_type.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(treat, schema)


def plant_repeats(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by a hash of doc_id, with a tail that repeats a stretch of theirs."""
    g, of_ten = divmod(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), 10)
    if of_ten or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]


def _sql() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    bit = "lambda c, _: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = "list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"
    repeated = "w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]"
    return f"""
WITH base AS (SELECT doc_id, {words} AS w, {crc} AS h FROM documents),
cut AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM base),
texts AS (SELECT doc_id, n, CASE WHEN a = n THEN w ELSE list_transform(range(0, n), lambda i: {repeated}) END AS w FROM cut),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
    HAVING count(*) >= greatest(q, {LEAST} - q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing,
    list(row(start, length, period) ORDER BY length DESC, start, period)[1] AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top[1]::BIGINT AS start, top[2]::BIGINT AS length, top[3]::BIGINT AS period,
    (1000 * top[2]::BIGINT) // top[3]::BIGINT AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


@query("op11_word_runs", _sql())
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(read(spark, sf_dir, "documents"), edit=plant_repeats)
    by_length = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listing = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), by_length.alias("top"), "collapsed",
                       F.when(F.size("runs") > 0, F.concat(listing, F.lit("\n"))).otherwise("").alias("listing"))
    return one.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.expr("(-1000 * top.less) div top.period").alias("exponent_milli"), sha256_hex(F.col("listing")).alias("runs_sha256"),
        sha256_hex(F.col("collapsed")).alias("collapsed_sha256"))
