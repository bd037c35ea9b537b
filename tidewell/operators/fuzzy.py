"""Misspelt emotion words: one edit, first-person attribution, real-word guard."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.sizing import collect_bounded, lookup_anti, lookup_join
from tidewell.functions.text import hinted, inside_any, match_spans
from tidewell.operators import guards

FOUND_TYPE = "array<struct<word:string,level:int>>"
SPELT_TYPE = "array<struct<word:string,level:int,s:int,e:int>>"
TOKEN = r"[a-z']+"
_WORD_TYPE = ("array<struct<word:string,level:int,short:boolean,folded:string,"
              "swaps:array<string>,folded_swaps:array<string>>>")


def collapse_repeats(word: Column) -> Column:
    """Any run of one character becomes a single one."""
    return F.regexp_replace(word, r"(.)\1+", "$1")


def _collapse(word: str) -> str:
    return "".join(ch for i, ch in enumerate(word) if i == 0 or word[i - 1] != ch)


def _swaps(word: str) -> list[str]:
    return [word[:i] + word[i + 1] + word[i] + word[i + 2:] for i in range(len(word) - 1)]


def _word_table(words: Mapping[str, int]) -> Column:
    rows = [
        {"word": w, "level": level, "short": len(w) < 4, "folded": _collapse(w),
         "swaps": _swaps(w), "folded_swaps": _swaps(_collapse(w))}
        for w, level in words.items()
    ]
    return F.from_json(F.lit(json.dumps(rows)), _WORD_TYPE)


def one_edit(left: Column, right: Column, right_swaps: Column) -> Column:
    """At most one insertion, deletion, substitution or adjacent swap apart."""
    close = F.abs(F.length(left) - F.length(right)) <= 1
    return close & ((F.levenshtein(left, right) <= 1) | F.array_contains(right_swaps, left))


def _edit_shapes(word: str) -> list[str]:
    """Patterns that together cover the one-edit neighbourhood of a word, with letters repeated at will."""
    any_letters, runs = "[a-z']+", [ch + "+" for ch in word]
    shapes = ["".join(runs)]
    for i in range(len(word) + 1):
        shapes.append("".join(runs[:i]) + any_letters + "".join(runs[i:]))
    for i in range(len(word)):
        shapes.append("".join(runs[:i]) + any_letters + "".join(runs[i + 1:]))
        shapes.append("".join(runs[:i] + runs[i + 1:]))
    for swapped in _swaps(word):
        shapes.append("".join(ch + "+" for ch in swapped))
    return list(dict.fromkeys(shapes))


def candidate_pattern(words: Mapping[str, int] = guards.FUZZY_WORDS) -> str:
    """Tokens that could be one edit from a word. A superset; `fuzzy_words` decides."""
    root: dict = {}
    for word in words:
        for form in {word, _collapse(word)}:
            for shape in _edit_shapes(form):
                node = root
                for atom in _atoms(shape):
                    node = node.setdefault(atom, {})
                node[""] = {}

    def render(node: dict) -> str:
        branches = [atom + render(child) for atom, child in node.items() if atom]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return "(?:" + body + ")?" if "" in node else body

    return r"(?<![a-z'])" + render(root) + r"(?![a-z'])"


def _atoms(shape: str) -> list[str]:
    atoms, i = [], 0
    while i < len(shape):
        width = len("[a-z']+") if shape[i] == "[" else 2
        atoms.append(shape[i:i + width])
        i += width
    return atoms


_CANDIDATES = candidate_pattern()
_SELF = hinted(guards.SELF_ATTRIBUTION, ["i", "me", "my", "fe", "be", "am"], edge=True)


def may_misspell(text: Column) -> Column:
    """Cheap test: a first-person marker and some token shaped like a core word."""
    return text.rlike(_SELF) & text.rlike(_CANDIDATES)


def canonical_word(token: Column, words: Mapping[str, int] = guards.FUZZY_WORDS) -> Column:
    """First word, in table order, that the token is a spelling of; null when none."""
    folded = collapse_repeats(token)
    table = _word_table(words)
    matches = F.filter(table, lambda w: F.when(w["short"], folded == w["folded"]).otherwise(
        one_edit(folded, w["folded"], w["folded_swaps"]) | one_edit(token, w["word"], w["swaps"])))
    return F.get(matches, F.lit(0))


def is_stop_word(token: Column, words: Mapping[str, int] = guards.FUZZY_WORDS,
                 stops: Sequence[str] = guards.STOP_WORDS) -> Column:
    return token.isin(list(stops)) & ~token.isin(list(words))


def attributed(start: Column, markers: Column, window: int = guards.ATTRIBUTION_WINDOW) -> Column:
    """A first-person marker ends before `start` and begins at most `window` characters before it."""
    return F.exists(markers, lambda m: (m["e"] <= start) & (m["s"] >= start - window))


def spelt_words(text: Column, words: Mapping[str, int] = guards.FUZZY_WORDS,
                stops: Sequence[str] = guards.STOP_WORDS) -> Column:
    """Core words a text spells about its writer, in order, with the offsets of the tokens."""
    candidates = F.filter(match_spans(text, _CANDIDATES), lambda t: (
        (F.length(t["t"]) >= 3) & ~is_stop_word(t["t"], words, stops)))
    markers = match_spans(text, _SELF)
    attributed_tokens = F.filter(
        F.transform(candidates, lambda t: F.struct(t.alias("t"), canonical_word(t["t"], words).alias("w"))),
        lambda x: x["w"].isNotNull())
    own = F.when(F.size(attributed_tokens) > 0, F.filter(
        attributed_tokens, lambda x: attributed(x["t"]["s"], markers)))
    named = F.transform(own, lambda x: F.struct(
        x["w"]["word"].alias("word"), x["w"]["level"].alias("level"),
        x["t"]["s"].alias("s"), x["t"]["e"].alias("e")))
    return F.coalesce(named, F.array().cast(SPELT_TYPE))


def found_words(spelt: Column, benign: Column) -> Column:
    """Spelt words outside idioms, each once, in order of first appearance."""
    outside = F.filter(spelt, lambda w: ~inside_any(w["s"], w["e"], benign))
    return F.array_distinct(F.transform(outside, lambda w: F.struct(
        w["word"].alias("word"), w["level"].alias("level"))))


def dictionary_lookalikes(words: DataFrame, limit: int = 100_000) -> list[str]:
    """Dictionary words that would count as a spelling of a core word.

    Only words shaped like one of the ~40 core words qualify, so the list has a natural bound; it is
    checked all the same.
    """
    shaped = words.where(F.col("word").rlike("^" + _CANDIDATES + "$"))
    near_core = shaped.where(canonical_word(F.col("word")).isNotNull() & ~F.col("word").isin(list(guards.FUZZY_WORDS)))
    return [r["word"] for r in collect_bounded(near_core.select("word").distinct(), limit, "look-alike words")]


def deletions(word: Column) -> Column:
    """The word and what is left of it without one of its characters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def swapped(left: Column, right: Column) -> Column:
    """Whether two words differ by two neighbouring characters that changed places."""
    def turned(i: Column) -> Column:
        return F.concat(F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.lit(1)), F.substring(left, i, F.lit(1)), F.substring(left, i + 2, F.length(left)))
    return (F.length(left) == F.length(right)) & (F.length(left) > 1) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(left) - 1, F.lit(1))), lambda i: turned(i) == right)


def within_one_edit(tokens: DataFrame, token: str, words: Mapping[str, int] | DataFrame) -> DataFrame:
    """The tokens with every word at most one edit away: word, level, rank.

    `words` is a mapping or a table (word, level, rank) of any size. Words one edit apart share a form with one character left out, or one is such a
    form of the other; so both sides spell these out, meet on them, and are then compared. Distinct tokens only are compared, a form that very many share is spread.
    """
    spark = tokens.sparkSession
    table = words if isinstance(words, DataFrame) else spark.createDataFrame(
        [(w, level, rank) for rank, (w, level) in enumerate(words.items())], "word string, level int, rank int")
    by_form = table.withColumn("_form", F.explode(deletions(F.col("word")))).groupBy("_form").agg(
        F.collect_set(F.struct("word", "level", "rank")).alias("_words"))
    own = tokens.select(F.col(token).alias("_token")).where("_token IS NOT NULL").distinct()
    met = lookup_join(own.withColumn("_form", F.explode(deletions(F.col("_token")))), by_form, ["_form"], ["_token"], how="inner")
    pairs = met.select("_token", F.explode("_words").alias("_w")).distinct()
    close = (F.levenshtein("_token", "_w.word", 1) >= 0) | swapped(F.col("_token"), F.col("_w.word"))
    found = pairs.where(close).groupBy("_token").agg(F.collect_list("_w").alias("_found")).withColumnRenamed("_token", token)
    return lookup_join(tokens, found, [token], [c for c in tokens.columns if c != token] or [token], how="inner").select(
        *tokens.columns, F.inline("_found"))


def tokens(messages: DataFrame, key: str, text: Column, shortest: int = 3, places: bool = True) -> DataFrame:
    """Word tokens of a text with their offsets; without `places`, (key, token) only, which one regex pass gives."""
    if not places:
        found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        return messages.select(key, F.explode(F.filter(found, lambda t: F.length(t) >= shortest) if shortest > 1 else found).alias("token"))
    spans = F.filter(match_spans(text, TOKEN), lambda t: F.length(t["t"]) >= shortest)
    return messages.select(key, F.explode(spans).alias("m")).select(
        key, F.col("m.t").alias("token"), F.col("m.s").alias("start"), F.col("m.e").alias("end"))


def drop_real_words(tokens_df: DataFrame, token: str, words: DataFrame) -> DataFrame:
    """Tokens that are not real words; core words stay whatever the dictionary says."""
    guarded = words.where(~F.col("word").isin(list(guards.FUZZY_WORDS))).select(F.col("word").alias(token)).distinct()
    return lookup_anti(tokens_df, guarded, [token])
