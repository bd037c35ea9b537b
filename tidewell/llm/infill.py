"""Fill-in-middle transformation by one counted-quantifier match per text, in DataFrame functions only.

A text is tiled by units (lines by default). `regexp_count` gives their number n. Two cuts are drawn from a hash of the doc_id: the prefix ends
after the smaller of a and b units, the middle after the larger. The row's own pattern `\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z` then
captures prefix, middle and suffix in one match, and the replacement writes them in their new order between the markers. The quantifiers are
possessive: the regex engine steps through the units and keeps no way back, so a long text costs its length and no stack.

The form is "psm" (prefix, suffix, middle), "spm" (suffix, prefix, middle) or "plain": the text itself where it is empty, holds a marker,
or is not drawn at `rate`. No marker can start inside a part and end in the next marker, so the first of each marker in an output is the one written there, and
`restored` cuts the output at the markers to give back the exact text.

Null text is the empty text: no units, plain. A null doc_id is drawn like the doc_id ''. Rows that repeat a doc_id are drawn alike; equal
texts of different doc_ids are not. Lines end at a line feed only. No row depends on another: nothing is shuffled. Only doc_id and text are read from `docs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.llm.common import bind, read, sha256_hex, text_of
from tidewell.llm.registry import query

# Patterns of units. Matches of a unit, left to right, must leave no character between them.
LINES, WORDS, CHARACTERS = r"[^\n]*+\n|[^\n]++", r"\s*+\S++|\s++", r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50


def draws(seed: int, doc_id: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of a hash of seed and doc_id."""
    digits = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, text, n (units), first, second (units before the middle and up to its end), form, output; a row per row of `docs`.

    `rate` percent of the texts are transformed, `spm` percent of those in the order suffix, prefix, middle.
    """
    h = [F.col(f"h{i}") for i in range(4)]
    counted = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", "text", F.regexp_count("text", F.lit(unit)).cast("long").alias("n"),
        *[x.alias(f"h{i}") for i, x in enumerate(draws(seed))])
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = counted.select(
        "doc_id", "text", "n", F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).alias("first"),
        F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).alias("second"), form.alias("form"))
    units = [F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)")) for count in (F.col("first"), F.col("second") - F.col("first"))]
    pattern = F.concat(F.lit(r"\A"), *units, F.lit(r"((?s:.*))\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    return cut.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))


def parts(output: Column, form: Column) -> Column:
    """struct<prefix, middle, suffix> of an output; null where the form is plain."""
    def cut(at: Column) -> Column:
        between = F.substring(output, F.lit(len(PREFIX) + 1), at["two"] - len(PREFIX) - 1)
        after = F.substring(output, at["two"] + len(SUFFIX), at["three"] - at["two"] - len(SUFFIX))
        last = F.substring(output, at["three"] + len(MIDDLE), F.length(output))
        return F.struct(F.when(form == "psm", between).otherwise(after).alias("prefix"), last.alias("middle"),
                        F.when(form == "psm", after).otherwise(between).alias("suffix"))
    two = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    places = F.struct(F.instr(output, two).alias("two"), F.instr(output, F.lit(MIDDLE)).alias("three"))
    return F.when(form != "plain", bind(places, cut))


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of."""
    return F.when(form == "plain", output).otherwise(bind(parts(output, form), lambda p: F.concat(p["prefix"], p["middle"], p["suffix"])))


def _sql() -> str:
    hashes = ", ".join(f"('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT AS h{i}" for i in range(4))
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, {hashes} FROM documents),
cut AS (SELECT *, least(h0 % (len(units) + 1), h1 % (len(units) + 1)) AS a, greatest(h0 % (len(units) + 1), h1 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h2 % 100 >= {RATE} THEN 'plain'
        WHEN h3 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM base),
parts AS (SELECT doc_id, text, len(units) AS n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts"""


@query("op13_infill", _sql())
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents")).select("doc_id", "n", "form", "output", parts(F.col("output"), F.col("form")).alias("p"))
    return made.select(
        "doc_id", "n", "form", F.length("p.prefix").cast("long").alias("prefix_chars"), F.length("p.middle").cast("long").alias("middle_chars"),
        sha256_hex(F.col("output")).alias("output_sha256"),
        sha256_hex(F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("p.prefix", "p.middle", "p.suffix"))).alias("restored_sha256"))
