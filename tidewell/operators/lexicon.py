"""Lexicon tables: roots, variants, templates, counts.

`phrases` frames are `lexicon_phrase(severity, category, slot, phrase)`. The small tables of
contractions and gerunds travel as literals, so none of these operators joins or shuffles until
duplicates are removed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.sizing import lookup_join
from tidewell.functions.text import escape_regex_col
from tidewell.operators import guards

# Longest slot vocabulary that may be folded into one pattern.
MAX_SLOT_PHRASES = 50_000


def _pairs(table: Mapping[str, Sequence[str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(full).alias("full"), F.lit(short).alias("short"))
        for full, shorts in table.items() for short in shorts
    ])


def signal_phrases(phrases: DataFrame, signal: Sequence[str] = guards.SIGNAL_SLOTS,
                   glue: Sequence[str] = guards.GLUE_SLOTS) -> DataFrame:
    """Phrases of slots that mean something alone. Glue and unknown slots stay silent."""
    return phrases.where(F.col("slot").isin(list(signal)) & ~F.col("slot").isin(list(glue)))


def root_filter(phrases: DataFrame, shortest: int = guards.MIN_ROOT_LENGTH,
                allowed: Sequence[str] = guards.SHORT_ROOTS) -> DataFrame:
    """Trimmed, lower-cased phrases that are long enough or expressly allowed."""
    cleaned = phrases.withColumn("phrase", F.lower(F.trim("phrase")))
    return cleaned.where((F.length("phrase") >= shortest) | F.col("phrase").isin(list(allowed)))


def contracted(phrase: Column, table: Mapping[str, Sequence[str]] = guards.CONTRACTIONS) -> Column:
    """Array of the contracted spellings of a phrase, one per short form that applies."""
    applies = F.filter(_pairs(table), lambda p: F.contains(phrase, p["full"]))
    return F.transform(applies, lambda p: F.replace(phrase, p["full"], p["short"]))


def contraction_variants(phrases: DataFrame) -> DataFrame:
    """One row per contracted spelling."""
    return phrases.withColumn("variant", F.explode(contracted(F.col("phrase"))))


def gerund_form(phrase: Column, table: Mapping[str, str] = guards.GERUNDS) -> Column:
    """The phrase with its head verb as a gerund; null when it has no rest or no known verb."""
    head = F.substring_index(phrase, " ", 1)
    rest = F.substr(phrase, F.length(head) + 2)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    gerund = F.element_at(known, head)
    return F.when((rest != "") & gerund.isNotNull(), F.concat(gerund, F.lit(" "), rest))


def inflected(phrase: Column) -> Column:
    """The phrase, its gerund, and the contracted spellings of both."""
    forms = F.array_compact(F.array(phrase, gerund_form(phrase)))
    return F.concat(forms, F.flatten(F.transform(forms, lambda f: contracted(f))))


def gerund_variants(phrases: DataFrame) -> DataFrame:
    """One row per inflected form, the original included."""
    return phrases.withColumn("variant", F.explode(inflected(F.col("phrase"))))


def root_vocabulary(phrases: DataFrame) -> DataFrame:
    """Every root with its variants, distinct per severity and category."""
    roots = gerund_variants(root_filter(signal_phrases(phrases)))
    return roots.select("severity", "category", F.col("variant").alias("phrase")).distinct()


def action_forms(phrases: DataFrame, slot: str = "violent_actions") -> DataFrame:
    """Action phrases in every form, bare verbs gaining their gerund."""
    actions = phrases.where(F.col("slot") == slot).withColumn("phrase", F.lower("phrase"))
    bare = F.create_map(*[F.lit(x) for pair in guards.GERUNDS.items() for x in pair])
    forms = F.array_compact(F.concat(inflected(F.col("phrase")), F.array(F.element_at(bare, F.col("phrase")))))
    return actions.select("severity", "category", F.explode(forms).alias("phrase")).distinct()


def action_target_pairs(phrases: DataFrame, targets: Sequence[str],
                        slot: str = "violent_actions") -> DataFrame:
    """Action followed by target. `targets` is a short list; each action row carries it along."""
    if len(targets) > 1000:
        raise ValueError("the target list must stay short; match it as a pattern instead")
    named = F.array(*[F.lit(t.lower()) for t in targets])
    spelled = F.transform(named, lambda t: F.concat(F.col("phrase"), F.lit(" "), t))
    return action_forms(phrases, slot).select("severity", "category", F.explode(spelled).alias("phrase"))


def compile_alternation(phrases: DataFrame, keys: Sequence[str] = ("category", "slot"),
                        limit: int = MAX_SLOT_PHRASES) -> DataFrame:
    """One escaped, longest-first alternation per group of a bounded vocabulary."""
    distinct = phrases.select(*keys, "phrase").distinct()
    escaped = F.struct((-F.length("phrase")).alias("by"), F.col("phrase").alias("raw"),
                       escape_regex_col(F.col("phrase")).alias("text"))
    grouped = distinct.groupBy(*keys).agg(
        F.count("*").alias("phrases"), F.array_sort(F.collect_list(escaped)).alias("words"))
    checked = F.when(F.col("phrases") <= limit, F.col("words.text")).otherwise(
        F.raise_error(F.lit(f"a slot holds more than {limit} phrases")))
    return grouped.select(*keys, "phrases", F.concat_ws("|", checked).alias("pattern"))


def compile_template(slots: DataFrame, phrases: DataFrame,
                     required: Sequence[str] = guards.REQUIRED_SLOTS) -> DataFrame:
    """Template regex per category and template id; two documents may use the same id.

    `slots` is `(template_id, category, pos, slot)`. Optional slots before the last required one
    keep their space behind them, optional ones after it keep their space in front.
    """
    words = compile_alternation(phrases).withColumnRenamed("pattern", "words").drop("phrases")
    marked = lookup_join(slots, words, ["category", "slot"], ["template_id"], how="inner").withColumn(
        "required", F.col("slot").isin(list(required)))
    part = F.struct("pos", "required", F.concat(F.lit("(?:"), "words", F.lit(")")).alias("group"))
    ordered = marked.groupBy("category", "template_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max(F.when(F.col("required"), F.col("pos"))).alias("last_required"))
    start = F.struct(F.lit("").alias("body"), F.lit(True).alias("separated"))

    def extend(state: Column, part: Column) -> Column:
        gap = F.when((state["body"] != "") & ~state["separated"], F.lit(r"\s+")).otherwise(F.lit(""))
        leading = part["pos"] < F.col("last_required")
        body = (
            F.when(part["required"], F.concat(state["body"], gap, part["group"]))
            .when(leading, F.concat(state["body"], gap, F.lit("(?:"), part["group"], F.lit(r"\s+)?")))
            .otherwise(F.concat(state["body"], F.lit(r"(?:\s+"), part["group"], F.lit(")?")))
        )
        return F.struct(body.alias("body"), (~part["required"] & F.coalesce(leading, F.lit(False))).alias("separated"))

    built = F.aggregate("parts", start, extend, lambda state: state["body"])
    return ordered.select("category", "template_id", F.concat(F.lit(r"(?<!\w)"), built, F.lit(r"(?!\w)")).alias("regex"))


def combination_count(slots: DataFrame, phrases: DataFrame,
                      required: Sequence[str] = guards.REQUIRED_SLOTS) -> DataFrame:
    """Product over the slots of n phrases, or n + 1 when the slot is optional.

    `combinations` is null where the number does not fit a bigint; `combinations_exact` holds up to 38 digits without rounding.
    """
    sizes = phrases.groupBy("category", "slot").agg(F.count_distinct("phrase").alias("n"))
    factor = F.when(F.col("slot").isin(list(required)), F.col("n")).otherwise(F.col("n") + 1)
    digits = lambda value: value.cast("decimal(38,0)")
    # Times a bigint, which is one of at most 20 digits: the scale stays 0, and more than 38 digits become null
    exact = F.aggregate(F.collect_list(factor.cast("decimal(20,0)")), digits(F.lit(1)), lambda product, n: digits(F.try_multiply(product, n)))
    return (
        lookup_join(slots, sizes, ["category", "slot"], ["template_id"], how="inner")
        .groupBy("template_id").agg(F.product(factor.cast("double")).try_cast("long").alias("combinations"), exact.alias("combinations_exact"))
    )


def lexicon_stats(patterns: DataFrame, phrases: DataFrame) -> DataFrame:
    """Entries per category and kind."""
    kinds = patterns.select("severity", "category", "kind").unionByName(
        phrases.select("severity", "category", F.col("slot").alias("kind")))
    return kinds.groupBy("severity", "category", "kind").agg(F.count("*").alias("entries"))


def dedupe_first(items: DataFrame, text: str, pos: str) -> DataFrame:
    """Case-folded distinct values, each at its first position."""
    return items.groupBy(F.lower(text).alias("item")).agg(F.min(pos).alias("first_pos"))


def expand_phrases(roots: DataFrame, starters: Sequence[str], modifiers: Sequence[str]) -> DataFrame:
    """`<starter> <modifier>? <root>` for short starter and modifier lists carried by each root row."""
    if len(starters) * (len(modifiers) + 1) > 10_000:
        raise ValueError("starter and modifier lists must stay short")
    heads = [s + (" " + m if m else "") for s in starters for m in ["", *modifiers]]
    spelled = F.transform(F.array(*[F.lit(h) for h in heads]),
                          lambda h: F.concat(h, F.lit(" "), F.col("phrase")))
    return roots.withColumn("expanded", F.explode(spelled))


def cross_labels(subjects: DataFrame, subject: str, verbs: Sequence[str]) -> DataFrame:
    """`<subject> <verb>` for a short verb list."""
    if len(verbs) > 1000:
        raise ValueError("the verb list must stay short")
    spelled = F.transform(F.array(*[F.lit(v) for v in verbs]),
                          lambda v: F.concat(F.col(subject), F.lit(" "), v))
    return subjects.withColumn("label", F.explode(spelled))


def third_person(reasons: DataFrame, text: str = "phrase", first: str = "because i ",
                 third: str = "because they ") -> DataFrame:
    """The reasons, plus the first-person ones rewritten in the third person."""
    rewritten = reasons.where(F.startswith(F.col(text), F.lit(first))).withColumn(
        text, F.replace(F.col(text), F.lit(first), F.lit(third)))
    return reasons.unionByName(rewritten)
