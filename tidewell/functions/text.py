"""Text normalisation, match spans and pattern assembly.

Offsets count code points from zero, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

SPAN_TYPE = "array<struct<s:int,e:int,t:string>>"

# Private-use characters that mark the edges of a match while spans are read off.
_OPEN, _CLOSE, _STAND_IN = "\ue000", "\ue001", "\ue002"


# Runs of white space other than one plain space, which would only replace itself. Printable ASCII is ruled out before the costly class is asked.
_SPACES = r"(?U) [\s\x1c-\x1f]+|[^ -~](?<=[\s\x1c-\x1f])[\s\x1c-\x1f]*"


def normalize_text(text: Column | str) -> Column:
    """Straight quotes, single spaces, trimmed, lower case. Null becomes empty."""
    col = F.col(text) if isinstance(text, str) else text
    straight = F.translate(F.coalesce(col, F.lit("")), "’‘" + _OPEN + _CLOSE, "''" + _STAND_IN * 2)
    return F.lower(F.trim(F.regexp_replace(straight, _SPACES, " ")))


_BLOCK = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value evaluated once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of `pattern`, left to right, as spans.

    One regex pass marks every match; the offsets are then a running sum of piece lengths. Pieces are
    folded in blocks, so a text with very many matches does not copy one growing list again and again.
    """
    marked = F.regexp_replace(text, pattern, _OPEN + "$0" + _CLOSE)

    def width(piece: Column) -> Column:
        return F.length(piece) - F.contains(piece, F.lit(_CLOSE)).cast("int")

    def step(state: Column, piece: Column) -> Column:
        found = F.substring_index(piece, _CLOSE, 1)
        here = state["pos"]
        span = F.struct(here.alias("s"), (here + F.length(found)).alias("e"), found.alias("t"))
        grown = F.when(F.contains(piece, F.lit(_CLOSE)), F.concat(state["acc"], F.array(span))).otherwise(state["acc"])
        return F.struct((here + width(piece)).alias("pos"), grown.alias("acc"))

    def fold(pieces: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"))
        block = lambda b: F.slice(pieces, b * _BLOCK + 1, _BLOCK)
        widths = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda n, p: n + width(p)))
        starts = F.aggregate(
            widths, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("acc")),
            lambda st, w: F.struct((st["pos"] + w).alias("pos"), F.concat(st["acc"], F.array(st["pos"])).alias("acc")),
            lambda st: st["acc"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, start: F.aggregate(
            block(b), F.struct(start.alias("pos"), F.array().cast(SPAN_TYPE).alias("acc")), step, lambda st: st["acc"])))

    return bind(F.split(marked, _OPEN, -1), fold)


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def near(start: Column, end: Column, spans: Column, radius: int) -> Column:
    """True when some span lies within `radius` characters of [start, end)."""
    return F.exists(spans, lambda m: (m["s"] <= end + radius) & (m["e"] >= start - radius))


def inside_any(start: Column, end: Column, spans: Column) -> Column:
    """True when [start, end) lies wholly inside some span."""
    return F.exists(spans, lambda m: (m["s"] <= start) & (end <= m["e"]))


_SPECIAL = set("()[]{}?*+-|^$\\.&~# \t\n\r\v\f")


def escape_regex(literal: str) -> str:
    """Backslash-escape characters that are special in a regex."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in literal)


def escape_regex_col(literal: Column) -> Column:
    """Column form of `escape_regex`."""
    return F.regexp_replace(literal, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])", r"\\$1")


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A pattern equal to the longest-first alternation of `phrases`.

    Shared prefixes are factored out, so the matcher compares each text position with one
    branch per next letter and not with every phrase.
    """
    root: dict = {}
    for phrase in phrases:
        node = root
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [escape_regex(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if "" in node:
            body = body if len(branches) > 1 else "(?:" + body + ")"
            return body + "?"
        return body

    return render(root)


def bounded_phrases(phrases: Iterable[str]) -> str:
    """`phrase_pattern` that may not start or end inside a word."""
    words = list(phrases)
    return hinted(r"(?U)(?<!\w)(?:" + phrase_pattern(words) + r")(?!\w)", {w[:2] for w in words}, edge=True)


def hinted(pattern: str, starts: Iterable[str] | None, edge: bool = False) -> str:
    """The same pattern behind a lookahead for the strings its matches can start with.

    Word boundaries are costly to test at every character; the lookahead rules most positions out
    first. `starts` must cover every match. `edge` says that a match that starts with a letter or digit stands behind no word
    character; then no position behind a plain letter is looked at, which leaves one in five.
    """
    if not starts:
        return pattern
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", pattern).group(0)
    starts = set(starts)
    at_edge = {s for s in starts if s[:1].isalnum()} if edge else set()
    ahead = "(?=" + phrase_pattern(starts - at_edge) + ")" if starts - at_edge else ""
    if at_edge:
        behind = "(?<![a-z])(?=" + phrase_pattern(at_edge) + ")"
        ahead = "(?:" + behind + "|" + ahead + ")" if ahead else behind
    return flags + ahead + "(?:" + pattern[len(flags):] + ")"


def _alternates(pattern: str) -> bool:
    """Whether a `|` stands outside all brackets of a pattern's rest."""
    depth, i = 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i += 2 if pattern[i + 1:i + 2] == "^" else 1  # a bracket that comes first is a member
            i += 1
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            return True
        i += 1
    return False


def literal_starts(pattern: str) -> set[str] | None:
    """First letters of a pattern that opens with an alternation of literals; null when unsure."""
    opening = re.match(r"(?:\(\?[a-zA-Z]+\))*(?:\\b|\(\?<!\\w\))\(\?:", pattern)
    if not opening:
        return None
    firsts, depth, at_start, i = set(), 0, True, opening.end()
    while i < len(pattern):
        ch = pattern[i]
        if at_start:
            if not ch.isalnum() or pattern[i + 1:i + 2] in ("?", "*", "{"):
                return None
            firsts.add(ch.lower())
            at_start = False
        if ch == "\\":
            i += 1
        elif ch == "[":
            return None
        elif ch == "(":
            depth += 1
        elif ch == ")":
            if depth == 0:
                optional = pattern[i + 1:i + 2] in ("?", "*", "{")
                return None if optional or _alternates(pattern[i + 1:]) else firsts
            depth -= 1
        elif ch == "|" and depth == 0:
            at_start = True
        i += 1
    return None
