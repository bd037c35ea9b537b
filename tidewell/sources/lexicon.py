"""Lexicon documents, phrase corpora and word lists as long tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewell.operators.lexicon import compile_template

SHIPPED = Path(__file__).resolve().parent.parent / "data" / "lexicon"

_SCHEMA = """
  level int, name string, bypasses_four_day_trend_gate boolean,
  components map<string, array<string>>,
  regex_rules array<struct<id: string, regex: string>>,
  regex_templates array<struct<id: string, slots: array<string>, regex: string>>,
  exact_high_precision_phrases array<string>,
  negative_context_regex array<string>
"""

# Severity and category of the three document levels.
_SEVERITY = {1: 1, 2: 2, 3: 4}
_CATEGORY = {1: "everyday_stress", 2: "major_stress", 3: "crisis"}


@dataclass
class Lexicon:
    """`patterns(severity, category, kind, pattern_id, regex, compiled, bypass)`,
    `phrases(severity, category, slot, phrase)` and `slots(template_id, category, pos, slot)`."""

    patterns: DataFrame
    phrases: DataFrame
    slots: DataFrame


def shipped_lexicon(spark: SparkSession) -> Lexicon:
    """The lexicon that comes with the package. The driver reads its three files; executors need no copy of them."""
    fields = StructType.fromDDL(_SCHEMA).fieldNames()
    rows = [{f: doc.get(f) for f in fields} for doc in (json.loads(p.read_text(encoding="utf-8")) for p in sorted(SHIPPED.glob("*.json")))]
    return lexicon_of(spark.createDataFrame(rows, _SCHEMA))


def read_lexicon(spark: SparkSession, paths: str | list[str]) -> Lexicon:
    """Load lexicon documents from a place all executors can read."""
    return lexicon_of(spark.read.schema(_SCHEMA).option("multiLine", True).json(paths))


def lexicon_of(docs: DataFrame) -> Lexicon:
    """Lexicon tables of documents. Templates given by slots only are compiled from their phrases."""
    lookup = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("level")]
    docs = docs.where(F.col("level").isNotNull()).select(
        "*", lookup(_SEVERITY).alias("severity"), lookup(_CATEGORY).alias("category"),
        F.coalesce("bypasses_four_day_trend_gate", F.lit(False)).alias("bypass"))
    slotted = docs.select("severity", "category", F.explode("components").alias("slot", "values")).select(
        "severity", "category", "slot", F.explode("values").alias("phrase"))
    exact = docs.select("severity", "category", F.lit("exact").alias("slot"),
                        F.explode("exact_high_precision_phrases").alias("phrase"))
    phrases = slotted.unionByName(exact).where(F.col("phrase").isNotNull())
    templates = docs.select("severity", "category", "bypass", F.explode("regex_templates").alias("t"))
    slots = templates.select(F.col("t.id").alias("template_id"), "category",
                             F.posexplode("t.slots").alias("pos", "slot"))
    compiled = compile_template(slots, phrases).withColumnRenamed("regex", "built")
    from_templates = templates.select("severity", "category", "bypass", F.col("t.id").alias("template_id"),
                                      F.col("t.regex").alias("given")).join(
        compiled, ["category", "template_id"], "left").select(
        "severity", "category", F.lit("template").alias("kind"), F.col("template_id").alias("pattern_id"),
        F.coalesce("given", "built").alias("regex"), F.col("given").isNull().alias("compiled"), "bypass")
    rules = docs.select("severity", "category", "bypass", F.explode("regex_rules").alias("r")).select(
        "severity", "category", F.lit("rule").alias("kind"), F.col("r.id").alias("pattern_id"),
        F.col("r.regex").alias("regex"), F.lit(False).alias("compiled"), "bypass")
    negative = docs.select("severity", "category", "bypass",
                           F.posexplode("negative_context_regex").alias("pos", "regex")).select(
        "severity", "category", F.lit("negative").alias("kind"),
        F.concat(F.lit("negative_"), F.col("pos").cast("string")).alias("pattern_id"), "regex", F.lit(False).alias("compiled"), "bypass")
    patterns = from_templates.unionByName(rules).unionByName(negative).where(F.col("regex").isNotNull())
    return Lexicon(patterns, phrases, slots)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A phrase corpus keyed by pack, as (pack, text)."""
    whole = spark.read.text(path, wholetext=True)
    packs = F.from_json("value", "map<string, struct<texts: array<string>>>")
    return whole.select(F.explode(packs).alias("pack", "spec")).select("pack", F.explode("spec.texts").alias("text"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list: alphabetic words of at least three letters, lower case, distinct."""
    return clean_words(spark.read.text(path), "value")


def clean_words(lines: DataFrame, column: str) -> DataFrame:
    word = F.lower(F.trim(column))
    return lines.select(word.alias("word")).where(
        F.col("word").rlike(r"(?U)^\p{L}+$") & (F.length("word") >= 3)).distinct()
