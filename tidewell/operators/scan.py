"""The keyword scan: messages x lexicon -> hits and a level, one output row per message.

The lexicon is a small dimension, so it is folded into patterns once and the messages are never
shuffled: every step is a column of the message's own row. A cheap pass over each text decides
whether the span work is needed at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.levels import level_name
from tidewell.functions.sizing import BROADCAST_LIMIT_BYTES, collect_bounded, lookup_join, spread_small
from tidewell.functions.text import (
    bind, bounded_phrases, hinted, inside_any, literal_starts, match_spans, near, no_spans, normalize_text,
    phrase_pattern,
)
from tidewell.operators import fuzzy, guards, lexicon as lex
from tidewell.sources.lexicon import Lexicon

MAX_LEXICON_ROWS = 200_000
HIT_TYPE = "array<struct<phrase:string,category:string,tier:string>>"


@dataclass
class LevelMatchers:
    """Patterns of one lexicon level. Any of them may be empty."""

    severity: int
    category: str
    bypass: bool
    rules: list[str] = field(default_factory=list)
    templates: list[str] = field(default_factory=list)
    exact: list[str] = field(default_factory=list)
    roots: list[str] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)
    anchored: set[str] = field(default_factory=set)

    def exact_pattern(self) -> str | None:
        return bounded_phrases(self.exact) if self.exact else None

    def root_pattern(self) -> str | None:
        return bounded_phrases(self.roots) if self.roots else None

    def pair_pattern(self) -> str | None:
        if not (self.actions and self.targets):
            return None
        return hinted(r"(?U)(?<!\w)(?:" + phrase_pattern(self.actions) + r")\s+(?:"
                      + phrase_pattern(self.targets) + r")(?!\w)", {a[:2] for a in self.actions}, edge=True)

    def patterns(self) -> list[str]:
        found = [*self.rules, *self.templates, self.exact_pattern(), self.root_pattern(), self.pair_pattern()]
        return [p for p in found if p]

    def gate(self) -> list[str]:
        """Cheap patterns, at least one of which matches wherever a pattern of the level does."""
        literal = [*self.exact, *self.roots, *self.anchors, *(self.actions if self.targets else [])]
        found = [bounded_phrases(literal)] if literal else []
        return [*found, *self.rules, *(t for t in self.templates if t not in self.anchored)]


def _flagged(regex: str) -> str:
    pattern = "(?iU)" + regex
    return hinted(pattern, literal_starts(pattern), edge=True)


# What the matches of the fixed guard patterns can start with.
_SERIOUS = hinted(guards.ALWAYS_SERIOUS, ["su", "ki", "un", "en", "ta", "se", "hu", "cu", "do", "be", "no", "km"])
_LAUGH = hinted(guards.LAUGH, ["lo", "lm", "ro", "ha", "he", "ja", "😂", "🤣", "😹", "💀", "so", "hi", "fu", "co",
                               "me", "jk", "ju", "jo", "im", "cr"], edge=True)
_THREAT = hinted(guards.RECEIVED_THREAT, ["i", "yo", "u ", "go", "ki", "wa", "no"], edge=True)
_MUNDANE = hinted(guards.MUNDANE, list("abcdefghklmnpqrstvw"), edge=True)


def literal_vocabulary(lexicon: Lexicon) -> DataFrame:
    """(severity, category, use, phrase): exact phrases, roots, actions and targets of a lexicon, as a table of any size."""
    phrases = lexicon.phrases
    exact = phrases.where(F.col("slot") == "exact").select(
        "severity", "category", F.lit("exact").alias("use"), F.lower("phrase").alias("phrase"))
    roots = lex.root_vocabulary(phrases).select("severity", "category", F.lit("roots").alias("use"), "phrase")
    actions = lex.action_forms(phrases).select("severity", "category", F.lit("actions").alias("use"), "phrase")
    targets = phrases.where(F.col("slot") == "person_targets").select(
        "severity", "category", F.lit("targets").alias("use"), F.lower("phrase").alias("phrase"))
    return reduce(DataFrame.unionByName, [exact, roots, actions, targets]).distinct()


def load_matchers(lexicon: Lexicon, literals: bool = True) -> list[LevelMatchers]:
    """Matchers per level from the lexicon tables, which must be small.

    A template compiled from its slots needs no pattern pass of its own in the gate: the phrases of
    its last required slot stand for it. One that brings its own regex may match other words.
    Without `literals` the phrases of `literal_vocabulary` stay a table, for `scan_messages` to join, and may be any number.
    """
    patterns, phrases = lexicon.patterns.coalesce(1), lexicon.phrases.coalesce(1)
    required = lexicon.slots.where(F.col("slot").isin(list(guards.REQUIRED_SLOTS)))
    last_slot = {
        (r["category"], r["template_id"]): (r["category"], r["slot"]) for r in collect_bounded(
            required.groupBy("template_id", "category").agg(F.max_by("slot", "pos").alias("slot")),
            MAX_LEXICON_ROWS, "lexicon templates")}
    rows = collect_bounded(
        patterns.select("severity", "category", "kind", "pattern_id", "regex", "compiled", "bypass")
        .orderBy("severity", "kind", "pattern_id"), MAX_LEXICON_ROWS, "lexicon_pattern")
    levels: dict[tuple[int, str], LevelMatchers] = {}

    def level(row) -> LevelMatchers:
        key = (row["severity"], row["category"])
        return levels.setdefault(key, LevelMatchers(row["severity"], row["category"], False))

    if not literals:
        for row in collect_bounded(lexicon.phrases.select("severity", "category").distinct(), MAX_LEXICON_ROWS, "lexicon levels"):
            level(row)
    for row in rows:
        entry = level(row)
        entry.bypass = entry.bypass or bool(row["bypass"])
        if row["kind"] == "rule":
            entry.rules.append(_flagged(row["regex"]))
        elif row["kind"] == "template":
            entry.templates.append(_flagged(row["regex"]))
            if row["compiled"] and (row["category"], row["pattern_id"]) in last_slot:
                entry.anchored.add(entry.templates[-1])
        elif row["kind"] == "negative":
            entry.negative.append(_flagged(row["regex"]))
    anchor_slots = [F.struct(F.lit(c), F.lit(slot)) for c, slot in sorted(set(last_slot.values()))]
    anchors = phrases.where(F.struct("category", "slot").isin(anchor_slots) if anchor_slots else F.lit(False)).select(
        "severity", "category", F.lit("anchors").alias("use"), F.lower("phrase").alias("phrase"))
    words = anchors.unionByName(literal_vocabulary(Lexicon(patterns, phrases, lexicon.slots))) if literals else anchors
    for row in collect_bounded(words.distinct(), MAX_LEXICON_ROWS, "lexicon_phrase"):
        getattr(level(row), row["use"]).append(row["phrase"])
    return [levels[key] for key in sorted(levels)]


def _any_match(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def laugh_spans(text: Column) -> Column:
    return F.when(text.rlike(_LAUGH), match_spans(text, _LAUGH)).otherwise(no_spans())


def benign_spans(text: Column) -> Column:
    return match_spans(text, guards.BENIGN)


def always_serious(text: Column) -> Column:
    return text.rlike(_SERIOUS)


def mundane(text: Column) -> Column:
    return text.rlike(_MUNDANE)


def first_threat(text: Column) -> Column:
    """Span of the first threat said to the user, null when there is none. Later ones are not tested."""
    return F.when(text.rlike(_THREAT), F.get(match_spans(text, _THREAT), F.lit(0)))


def is_ambiguous(phrase: Column, roots: Sequence[str] = guards.AMBIGUOUS_ROOTS) -> Column:
    """The phrase contains an ambiguous root, or a root contains the phrase."""
    listed = F.array(*[F.lit(r) for r in roots])
    return F.exists(listed, lambda r: F.contains(phrase, r) | F.contains(r, phrase))


def innocent_completion(text: Column, end: Column) -> Column:
    """What follows offset `end` re-scopes the phrase onto something concrete."""
    return F.substr(text, end + 1).rlike(guards.INNOCENT_COMPLETION)


def keep_hit(hit: Column, text: Column, benign: Column, laugh: Column, serious: Column,
             everyday: Column) -> Column:
    """Whether a hit survives the idiom, hyperbole and ambiguity guards."""
    joked = near(hit["s"], hit["e"], laugh, guards.JOKE_RADIUS)
    exaggerated = hit["t"].isin(list(guards.HYPERBOLE)) & joked
    explained = is_ambiguous(hit["t"]) & (everyday | joked | innocent_completion(text, hit["e"]))
    return ~inside_any(hit["s"], hit["e"], benign) & (serious | ~(exaggerated | explained))


LITERAL_TYPE = "array<struct<severity:int,category:string,use:string,s:int,e:int,t:string,spaced:boolean>>"
_TOKENS = r"(?U)(?:\w+|[^\w\s])\s*"  # words and single signs, with the space behind them


def _grams(norm: Column, lengths: Sequence[int]) -> Column:
    """array<struct<phrase, s, e, open, shut, spaced>>: every run of as many tokens as some phrase has, with its place in the text.

    open and shut say that no word character stands right before and right behind, spaced that a space stands behind.
    """
    def whole(tokens: Column) -> Column:
        def plain(i: Column) -> Column:
            return F.rtrim(F.get(tokens, i)["t"])

        def word(i: Column) -> Column:
            return F.coalesce(plain(i).rlike(r"(?U)\w"), F.lit(False))

        def run(i: Column, n: int) -> Column:
            last = i + (n - 1)
            head = F.array_join(F.transform(F.slice(tokens, i + 1, n - 1), lambda t: t["t"]), "") if n > 1 else F.lit("")
            end = F.get(tokens, last)["s"] + F.length(plain(last))
            glued = (i > 0) & (plain(i - 1) == F.get(tokens, i - 1)["t"])
            return F.struct(F.concat(head, plain(last)).alias("phrase"), F.get(tokens, i)["s"].alias("s"), end.alias("e"),
                            (~(F.coalesce(glued, F.lit(False)) & word(i - 1))).alias("open"),
                            (~(word(last + 1) & (F.get(tokens, last)["e"] == end))).alias("shut"), (F.get(tokens, last)["e"] > end).alias("spaced"))

        def runs(n: int) -> Column:
            found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: run(i, n))
            return F.when(F.size(tokens) >= n, found)
        return F.flatten(F.array_compact(F.array(*[runs(n) for n in lengths])))
    return bind(match_spans(norm, _TOKENS), whole)


def literal_spans(texts: DataFrame, key: Sequence[str], norm: str, vocabulary: DataFrame) -> DataFrame:
    """(key, hash of the text, literal spans): all places of all phrases, by joining token runs with the vocabulary.

    The scale-out form of the literal patterns. Runs of the lengths that occur in the vocabulary are spelled out and joined with it by their text, a phrase that may stand
    in any number of texts being spread; what matches is gathered per text. A phrase counts where no word character touches its ends.
    """
    size = F.size(F.filter(F.split("phrase", r"(?U)(?<=\W)|(?=\W)"), lambda p: F.trim(p) != ""))
    table = vocabulary.where(F.length("phrase") > 0).groupBy("phrase").agg(F.collect_set(F.struct("severity", "category", "use")).alias("_uses"))
    shape = table.agg(F.collect_set(size).alias("lengths"), F.max((F.trim("phrase") != F.col("phrase")).cast("int")).alias("edges")).first()
    if shape["edges"]:
        raise ValueError("phrases with a space at an end cannot be joined; trim them")
    lengths = sorted(shape["lengths"])
    empty = texts.select(*key, F.xxhash64(norm).alias("_text"), F.lit(None).cast(LITERAL_TYPE).alias("_literal")).where(F.lit(False))
    if not lengths:
        return empty
    runs = texts.select(*key, F.xxhash64(norm).alias("_text"), F.inline(_grams(F.col(norm), lengths)))
    starts, ends = F.col("phrase").rlike(r"(?U)^\w"), F.col("phrase").rlike(r"(?U)\w$")
    met = lookup_join(runs, table, ["phrase"], ["_text", "s"], how="inner").where((starts | F.col("open")) & (ends | F.col("shut")))
    flat = met.select(*key, "_text", "s", "e", F.col("phrase").alias("t"), "spaced", F.inline("_uses"))
    return flat.groupBy(*key, "_text").agg(F.collect_set(F.struct("severity", "category", "use", "s", "e", "t", "spaced")).cast(LITERAL_TYPE).alias("_literal"))


def _apart(spans: Column) -> Column:
    """Of spans sorted by start and then longest first, those a search from the left takes: none begins inside the one before."""
    start = F.struct(F.lit(0).alias("to"), no_spans().alias("kept"))

    def take(state: Column, x: Column) -> Column:
        return F.when(x["s"] >= state["to"], F.struct(x["e"].alias("to"), F.concat(state["kept"], F.array(x)).alias("kept"))).otherwise(state)
    return F.aggregate(spans, start, take, lambda state: state["kept"])


def _sorted_spans(found: Column) -> Column:
    by = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("less"), x["t"].alias("t")))))
    return F.transform(by, lambda x: F.struct(x["s"].alias("s"), (-x["less"]).alias("e"), x["t"].alias("t")))


def joined_spans(literal: Column, level: LevelMatchers) -> Column:
    """The spans a level's exact, root and pair patterns find, from the joined spans of a text."""
    def of(use: str) -> Column:
        return F.filter(literal, lambda x: (x["severity"] == level.severity) & (x["category"] == level.category) & (x["use"] == use))

    def pairs(both: Column) -> Column:
        return F.flatten(F.transform(both["actions"], lambda a: F.transform(
            F.filter(both["targets"], lambda t: a["spaced"] & (t["s"] == a["e"] + 1)),
            lambda t: F.struct(a["s"].alias("s"), a["e"].alias("mid"), t["e"].alias("e"), F.concat(a["t"], F.lit(" "), t["t"]).alias("t")))))

    def longest(found: Column) -> Column:
        # Longest action first, then longest target
        by = F.array_sort(F.transform(found, lambda x: F.struct(
            x["s"].alias("s"), (-x["mid"]).alias("less"), (-x["e"]).alias("shorter"), x["t"].alias("t"))))
        return F.transform(by, lambda x: F.struct(x["s"].alias("s"), (-x["shorter"]).alias("e"), x["t"].alias("t")))
    acts = F.struct(of("actions").alias("actions"), of("targets").alias("targets"))
    # An action is followed by white space, so it needs no word edge of its own; a joined one has it all the same
    found = F.flatten(F.array(_apart(_sorted_spans(of("exact"))), _apart(_sorted_spans(of("roots"))), _apart(longest(bind(acts, pairs)))))
    return F.when(F.size(literal) > 0, found).otherwise(no_spans())


def scan_messages(messages: DataFrame, matchers: Sequence[LevelMatchers], text: str = "text",
                  words: DataFrame | None = None, vocabulary: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Adds tier3, matched, categories, hits, level, level_name, joking_context, received_threat.

    `words` is an optional `word string` dictionary of real words that are never misspellings; it is
    cut to the words that resemble a core word before use, so it may be large. `vocabulary` is that of a lexicon too large for
    patterns (`literal_vocabulary`, with matchers loaded without literals): its phrases are found by a join, for which `key` names the
    columns that tell messages apart. The guards are the same.
    """
    norm = F.col("_norm")
    stops = [*guards.STOP_WORDS, *(fuzzy.dictionary_lookalikes(words) if words is not None else [])]
    gates = [g for m in matchers for g in m.gate()]
    base = spread_small(messages).withColumn("_norm", normalize_text(text))
    literal = F.lit(None).cast(LITERAL_TYPE)
    if vocabulary is not None:
        if not key:
            raise ValueError("a vocabulary is joined by the messages' key; name its columns")
        base = base.withColumn("_text", F.xxhash64("_norm"))
        found_in = literal_spans(base, key, "_norm", vocabulary).select("_literal", F.col("_text").alias("_text_r"), *[F.col(k).alias(f"_r_{k}") for k in key])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key], F.col("_text") == F.col("_text_r"))
        base, literal = base.join(found_in, same, "left"), F.coalesce("_literal", F.array().cast(LITERAL_TYPE))
    has_literal = F.size(literal) > 0 if vocabulary is not None else F.lit(False)
    base = base.select(
        "*",
        laugh_spans(norm).alias("_laugh"),
        first_threat(norm).alias("_threat"),
        (_any_match(norm, gates) | has_literal).alias("_gate"),
        fuzzy.may_misspell(norm).alias("_typo"),
    )
    joking = F.size("_laugh") > 0
    base = base.select(
        "*", joking.alias("_joking"),
        F.when(F.col("_gate") | F.col("_typo") | joking, always_serious(norm)).otherwise(False).alias("_serious"),
        (F.col("_threat").isNotNull() & ~F.coalesce(
            near(F.col("_threat")["s"], F.col("_threat")["e"], F.col("_laugh"), guards.JOKE_RADIUS),
            F.lit(False))).alias("received_threat"),
    )
    # Candidate spans first; the idiom patterns then run only on the few texts that have any.
    raw = [
        F.when(F.col("_gate") & (F.col("_serious") | ~_any_match(norm, level.negative)),
               F.flatten(F.array(*[match_spans(norm, p) for p in level.patterns()], *([joined_spans(literal, level)] if vocabulary is not None else []))))
        .otherwise(no_spans()).alias(f"_raw_{i}")
        for i, level in enumerate(matchers)
    ]
    base = base.select(
        "*", *raw,
        F.when(F.col("_typo") & (F.col("_serious") | ~F.col("_joking")), fuzzy.spelt_words(norm, stops=stops))
        .otherwise(F.array().cast(fuzzy.SPELT_TYPE)).alias("_spelt"))
    has_hits = reduce(lambda a, b: a | b, [F.size(f"_raw_{i}") > 0 for i in range(len(matchers))], F.lit(False))
    base = base.select(
        "*",
        F.when(has_hits | (F.size("_spelt") > 0), benign_spans(norm)).otherwise(no_spans()).alias("_benign"),
        F.when(has_hits, mundane(norm)).otherwise(False).alias("_mundane"),
    )
    found = []
    for i in range(len(matchers)):
        kept = F.filter(f"_raw_{i}", lambda h: keep_hit(
            h, norm, F.col("_benign"), F.col("_laugh"), F.col("_serious"), F.col("_mundane")))
        found.append(F.array_sort(F.array_distinct(F.transform(kept, lambda h: h["t"]))).alias(f"_found_{i}"))
    base = base.select("*", *found, fuzzy.found_words(F.col("_spelt"), F.col("_benign")).alias("_fuzzy"))
    return assemble(base, matchers)


def assemble(found: DataFrame, matchers: Sequence[LevelMatchers]) -> DataFrame:
    """Hits, categories and level from the per-level phrases, the misspellings and the threat."""
    def tagged(column: Column, category: str, tier: str) -> Column:
        return F.transform(column, lambda p: F.struct(
            p.alias("phrase"), F.lit(category).alias("category"), F.lit(tier).alias("tier")))

    threat_hit = F.when(
        F.col("received_threat"),
        tagged(F.array(F.trim(F.col("_threat")["t"])), "received_threat", "3"),
    ).otherwise(F.array().cast(HIT_TYPE))
    fuzzy_hits = F.transform("_fuzzy", lambda f: F.struct(
        f["word"].alias("phrase"), F.lit("fuzzy").alias("category"), F.lit("1").alias("tier")))
    level_hits = [tagged(F.col(f"_found_{i}"), m.category, "3" if m.bypass else "1")
                  for i, m in enumerate(matchers)]
    any_of = [F.size(f"_found_{i}") > 0 for i in range(len(matchers))]
    categories = F.array_distinct(F.array_compact(F.array(
        *[F.when(hit, F.lit(m.category)) for hit, m in zip(any_of, matchers)],
        F.when(F.col("received_threat"), F.lit("received_threat")))))
    tier3 = reduce(lambda a, b: a | b, [hit for hit, m in zip(any_of, matchers) if m.bypass], F.lit(False))
    category_level = F.greatest(F.lit(0), F.lit(0), *[
        F.when(hit, F.lit(guards.CATEGORY_LEVEL.get(m.category, 0))).otherwise(0)
        for hit, m in zip(any_of, matchers)])
    fuzzy_level = F.coalesce(F.array_max(F.transform("_fuzzy", lambda f: f["level"])), F.lit(0))
    rolled = roll_up_level(F.col("tier3"), category_level, fuzzy_level, F.col("received_threat"))
    staged = found.select("*", tier3.alias("tier3"), categories.alias("categories"),
                          F.concat(*level_hits, fuzzy_hits, threat_hit).alias("hits"))
    staged = staged.withColumn("level", rolled.cast("int"))
    scratch = [c for c in staged.columns if c.startswith("_")]
    return staged.select(
        "*", (F.size("hits") > 0).alias("matched"), level_name("level").alias("level_name"),
        (F.col("_joking") & ~F.col("_serious")).alias("joking_context"),
    ).drop(*scratch)


def roll_up_level(tier3: Column, category_level: Column, fuzzy_level: Column, threat: Column) -> Column:
    """4 for tier 3, else the highest of category, misspelling and received threat."""
    return F.when(tier3, 4).otherwise(
        F.greatest(category_level, fuzzy_level, F.when(threat, 3).otherwise(0)))


def hit_rows(scanned: DataFrame, key: str) -> DataFrame:
    """Exploded form: one row per hit."""
    return scanned.select(key, F.explode("hits").alias("hit")).select(key, "hit.phrase", "hit.category", "hit.tier")


HEADS = 1_000


def phrase_hits(messages: DataFrame, phrases: DataFrame, key: str, text: str = "text",
                longest: int = 12) -> DataFrame:
    """Literal phrases found in messages, by joining word n-grams with a phrase table of any size.

    The scale-out form of the exact, root and pair matchers: use it when the vocabulary is too
    large for a pattern. A phrase counts where it stands between word edges. Only n-gram lengths that
    occur in the vocabulary are spelled out, and only from words some phrase begins with if these are at most `HEADS`. A vocabulary is measured,
    not estimated: one of up to `BROADCAST_LIMIT_BYTES` is sent to the messages, which then stay where they are.
    """
    parts = F.split("phrase", " ")
    table = phrases.where(F.size(parts) <= longest).groupBy("phrase").agg(F.collect_set("category").alias("_categories"))
    if phrases.where(F.size(parts) > longest).limit(1).count():
        raise ValueError(f"the vocabulary holds phrases of more than {longest} words; raise `longest`")
    held = F.octet_length("phrase") + F.aggregate("_categories", F.lit(0), lambda n, c: n + F.octet_length(c) + 16) + 64
    lengths, held = table.agg(F.collect_set(F.size(parts)), F.coalesce(F.sum(held), F.lit(0))).first()
    heads = [r["head"] for r in table.select(F.get(parts, F.lit(0)).alias("head")).distinct().limit(HEADS + 1).collect()]
    words, starts = F.col("_words"), F.sequence(F.lit(0), F.size("_words") - 1)
    starts = F.filter(starts, lambda i: F.get(words, i).isin(heads)) if len(heads) <= HEADS else starts

    def grams_of(n: int) -> Column:
        whole = F.filter("_starts", lambda i: i <= F.size(words) - n)
        return F.transform(whole, lambda i: F.array_join(F.slice(words, i + 1, n), " "))

    grams = F.concat(F.array().cast("array<string>"), *[grams_of(n) for n in sorted(lengths)])
    split_up = messages.select(key, F.split(F.trim(
        F.regexp_replace(normalize_text(text), r"(?U)[^\w']+", " ")), " ").alias("_words")).select(key, "_words", starts.alias("_starts"))
    exploded = split_up.select(key, F.explode(F.array_distinct(grams)).alias("phrase"))
    met = (exploded.join(F.broadcast(table), "phrase") if held <= BROADCAST_LIMIT_BYTES
           else lookup_join(exploded, table, ["phrase"], [key], how="inner"))
    return met.select(key, "phrase", F.explode("_categories").alias("category"))
