"""Language identification by piece probabilities per language, summed over all segmentations.

The pieces are those of a fixed public vocabulary (a sentencepiece model file, `VOCABULARY`; it is never trained here) that hold letters only, in lower case. Words are
runs of letters of the composed, lower-case text, each behind a mark of its start. A segmentation cuts a word into pieces; a character that is no piece
may stand alone as the unknown piece, so every word has one. A language gives a word the sum, over all its segmentations, of the product of its piece probabilities:
the forward algorithm, in logarithms, at any length. A text has the product of its words; the languages are weighed alike, the score is the
share of the predicted language in their sum.

The probabilities are learnt by `ROUNDS` of expectation-maximisation over the distinct words of all training rows, as many as there are, with their counts per language: forward and backward sums
give the expected uses of each piece, which are added up by tasks, then by Spark. Only the table of languages by pieces comes to the driver and is broadcast. It
is bounded by the vocabulary times the languages, which must be few enough for it (a thousand languages are some 200 MB).

Null text and text without a letter are "und" with score 0, as is everything where no language was learnt. Of equally likely languages the first by name is predicted. Rows with null lang or
without letters teach nothing; repeated rows teach as often as they occur. Rows are judged one by one: a repeated row is given twice, a null doc_id is carried. Only doc_id,
text and, to learn, lang are read. Very long texts and words are treated whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import forget, read, saved
from tidewell.llm.labelled import remainder
from tidewell.llm.registry import query

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, NO_LANGUAGE, UNKNOWN = "▁", "und", 0
ROUNDS, SMOOTH = 3, 0.1
SLICE_CHARS, SLICE_WORDS, KEPT_WORDS = 1 << 22, 1 << 18, 1 << 19
_CODE_BITS = 21
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """Languages by name, pieces (the first stands for any unknown character) and their log probabilities, a row a language."""

    langs: list[str]
    pieces: tuple[str, ...]
    logp: np.ndarray


def vocabulary(path: str = VOCABULARY) -> tuple[str, ...]:
    """The pieces of letters of a sentencepiece vocabulary, in lower case, after the unknown one. The mark alone is a piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {MARK}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lower()
            if piece.removeprefix(MARK).isalpha():
                found.add(piece)
    return ("", *sorted(found))


def words_of(text: str) -> list[str]:
    """The runs of letters of a text. Other numerals count as letters only beside one."""
    found = _LETTERS.findall(unicodedata.normalize("NFC", text).lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


class Trie(NamedTuple):
    """All pieces as paths from node 0: edges sorted by (node, character), the node each leads to, and the piece that ends at a node (-1: none)."""

    edges: np.ndarray
    leads: np.ndarray
    piece: np.ndarray


@lru_cache(maxsize=4)
def trie_of(pieces: tuple[str, ...]) -> Trie:
    nodes: dict[tuple[int, int], int] = {}
    ends = {}
    for i, piece in enumerate(pieces[1:], 1):
        at = 0
        for c in piece:
            at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
        ends[at] = i
    edges = np.array([at << _CODE_BITS | code for at, code in nodes], dtype=np.int64)
    order = np.argsort(edges)
    piece = np.full(len(nodes) + 1, -1)
    piece[list(ends)] = list(ends.values())
    return Trie(edges[order], np.arange(1, len(nodes) + 1)[order], piece)


class Lattice:
    """All ways to cut words of one length into pieces.

    `steps` are (t, n, rows, piece): the words `rows` have the piece `piece` of n characters at character t; by t.
    """

    def __init__(self, words: list[str], trie: Trie):
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes.reshape(len(words), -1).astype(np.int64)
        self.rows, self.size = codes.shape
        self.steps = []
        for t in range(self.size):
            rows, node, n = np.arange(self.rows), np.zeros(self.rows, dtype=np.int64), 0
            while rows.size and t + n < self.size:
                wanted = node << _CODE_BITS | codes[rows, t + n]
                at = np.minimum(np.searchsorted(trie.edges, wanted), trie.edges.size - 1)
                met = trie.edges[at] == wanted
                n += 1
                if n == 1:
                    piece = np.where(met, trie.piece[trie.leads[at]], UNKNOWN)
                    self.steps.append((t, 1, rows, np.where(piece < 0, UNKNOWN, piece)))
                    rows, node = rows[met], trie.leads[at][met]
                    continue
                rows, node = rows[met], trie.leads[at][met]
                piece = trie.piece[node]
                ends = piece >= 0
                if ends.any():
                    self.steps.append((t, n, rows[ends], piece[ends]))

    def sums(self, logp: np.ndarray, lang: np.ndarray | None = None, forward: bool = True) -> tuple[np.ndarray, bool]:
        """Per word, place and language the sum over all cuts of what stands before that place (or, backwards, behind it), and whether it is a logarithm.

        `lang`, if given, is the one language of each word. Products of all but long words fit plain numbers; logarithms take over where they might not.
        """
        logs = -(self.size + 1) * logp.min(initial=0.0) > 700
        plus, times, values = (np.logaddexp, np.add, logp) if logs else (np.add, np.multiply, np.exp(logp))
        values = np.ascontiguousarray(values.T)
        total = np.full((self.rows, self.size + 1, values.shape[1] if lang is None else 1), -np.inf if logs else 0.0)
        total[:, 0 if forward else -1] = 0.0 if logs else 1.0
        for t, n, rows, piece in self.steps if forward else reversed(self.steps):
            source, out = (t, t + n) if forward else (t + n, t)
            p = values[piece] if lang is None else values[piece, lang[rows]][:, None]
            total[rows, out] = plus(total[rows, out], times(total[rows, source], p))
        return total, logs


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of words of one length, with their places in `words`."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(words) else []:
        for i in range(0, group.size, step := max(1, SLICE_WORDS // (int(lengths[group[0]]) + 1))):
            part = group[i:i + step]
            yield part, [words[j] for j in part]


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language, a row a word."""
    out, trie = np.empty((len(words), len(model.langs))), trie_of(model.pieces)
    for at, group in by_length(words):
        total, logs = Lattice(group, trie).sums(model.logp)
        out[at] = total[:, -1] if logs else np.log(total[:, -1])
    return out


def expected(words: list[str], lang: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    """Expected uses of each piece in each language, over words of one language each."""
    uses, trie = np.zeros(model.logp.size), trie_of(model.pieces)
    for at, group in by_length(words):
        lattice, of = Lattice(group, trie), lang[at]
        (ahead, logs), (back, _) = lattice.sums(model.logp, of), lattice.sums(model.logp, of, forward=False)
        ahead, back = (x[:, :, 0] if logs else np.log(x[:, :, 0], where=x[:, :, 0] > 0, out=np.full(x.shape[:2], -np.inf)) for x in (ahead, back))
        for t, n, rows, piece in lattice.steps:
            share = np.exp(ahead[rows, t] + model.logp[of[rows], piece] + back[rows, t + n] - ahead[rows, -1])
            uses += np.bincount(of[rows] * model.logp.shape[1] + piece, weights=share * count[at][rows], minlength=uses.size)
    return uses.reshape(model.logp.shape)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (text, lang); a task adds up its batches' words first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                                                  pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    known = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    return known.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """The model of all rows of (text, lang). Starts from equal probabilities."""
    counts = saved(word_counts(texts), "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    pieces = vocabulary(path)
    model = Model(langs, pieces, np.full((len(langs), len(pieces)), -np.log(len(pieces))))
    for _ in range(rounds if langs else 0):
        sent = counts.sparkSession.sparkContext.broadcast(model)

        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value
            at = {lang: i for i, lang in enumerate(now.langs)}
            total = np.zeros(now.logp.shape)
            for batch in batches:
                of = np.array([at[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
                total += expected(batch.column("word").to_pylist(), of, batch.column("n").to_numpy(), now)
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "uses"])

        rows = counts.mapInArrow(uses, "lang long, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.full(model.logp.shape, SMOOTH)
        total[rows["lang"], rows["piece"]] += rows["uses"]
        model = model._replace(logp=np.log(total / total.sum(axis=1, keepdims=True)))
        sent.unpersist()
    forget(counts)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score; a row per row of `docs`. A task keeps the scores of the words it has met, up to `KEPT_WORDS` of them."""
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, lang_pred string, score double"
    if not model.langs:
        return docs.select("doc_id", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def slices(texts: list[str | None]) -> Iterator[list[list[str]]]:
        part, chars = [], 0
        for text in texts:
            if chars > SLICE_CHARS:
                yield part
                part, chars = [], 0
            part.append(words_of(text) if text else [])
            chars += len(text or "")
        yield part

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        number: dict[str, int] = {}
        known = np.zeros((0, len(now.langs)))
        for batch in batches:
            lang, score = [], []
            for part in slices(batch.column("text").to_pylist()):
                if len(number) > KEPT_WORDS:
                    number, known = {}, known[:0]
                flat = [w for words in part for w in words]
                fresh = [w for w in dict.fromkeys(flat) if w not in number]
                number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
                known = np.concatenate((known, word_scores(fresh, now))) if fresh else known
                rows = known[np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))]
                sizes = np.array([len(words) for words in part], dtype=np.int64)
                of = np.repeat(np.arange(sizes.size), sizes)
                total = np.stack([np.bincount(of, weights=rows[:, i], minlength=sizes.size) for i in range(len(now.langs))], axis=1)
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang += [now.langs[b] if n else NO_LANGUAGE for b, n in zip(best, sizes)]
                score += np.where(sizes > 0, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(to_arrow_type(id_type)), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


@query("op12_langid")
def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(remainder(4) != 2))
    return identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
