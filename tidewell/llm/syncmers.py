"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into tokens: runs of non-space characters, at most 24 long; each character of a
script written without spaces is a token. A k-mer is `K` tokens in a row. It is a closed
syncmer if the smallest hash among its inner substrings of `S` tokens is that of the first or of the
last one. Whether a k-mer is chosen depends on its own tokens alone, so an edit elsewhere moves no
anchor. `anchors` gives the chosen k-mers with their token positions; the fingerprint is the sketch
of the `SKETCH` smallest distinct anchor hashes, and the likeness of two fingerprints is the share of the
smallest hashes of their union that both hold (an estimate of the Jaccard similarity of the anchors).

Null text is the empty text. A text without tokens has an empty fingerprint; two empty ones have likeness 1,
an empty and another one 0. A text of fewer than `K` tokens has one anchor over all its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewell.llm.common import bind, read, sha256_hex, text_of
from tidewell.llm.registry import query

K, S, SKETCH = 5, 2, 128
PRIME = 4294967291
_STEP, _INNER = 40503, 30011
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai")
_SPACE = r"\x09-\x0D\x20"
BUCKETS_PER_PARTITION, MOST_BUCKETS = 4, 4096


def token_pattern(prefix: str = "Is") -> str:
    scripts = "".join(rf"\p{{{prefix}{s}}}" for s in SCRIPTS)
    return f"[{scripts}]|[^{_SPACE}{scripts}]{{1,24}}"


def _weights(step: int, n: int) -> list[int]:
    return [pow(step, j + 1, 65521) for j in range(n)]


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>>: the closed syncmers of a text, by token position."""
    def token_hash(t: Column) -> Column:
        return F.conv(F.substring(F.md5(F.encode(t, "UTF-8")), 1, 8), 16, 10).cast("long")

    def mix(at: Column, array: Column, weights: list[int]) -> Column:
        total = F.lit(0)
        for j, w in enumerate(weights):
            total = total + F.get(array, at + j) * F.lit(w)
        return total % F.lit(PRIME)

    def chosen(h: Column, inner: Column) -> Column:
        def take(at: Column) -> Column:
            parts = [F.get(inner, at + j) for j in range(k - s + 1)]
            low = F.least(*parts)
            return F.when((low == parts[0]) | (low == parts[-1]),
                          F.struct(at.alias("pos"), mix(at, h, _weights(_STEP, k)).alias("hash")))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - k), take), lambda x: x.isNotNull())

    def whole(h: Column) -> Column:
        one = F.aggregate(h, F.lit(17).cast("long"), lambda acc, x: (acc * F.lit(_STEP) + x) % F.lit(PRIME))
        return F.array(F.struct(F.lit(0).alias("pos"), one.alias("hash")))

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return bind(F.transform(F.regexp_extract_all(text, F.lit(token_pattern()), F.lit(0)), token_hash), lambda h: (
        F.when(F.size(h) == 0, none).when(F.size(h) < k, whole(h)).otherwise(bind(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - s, F.lit(0))), lambda at: mix(at, h, _weights(_INNER, s))),
            lambda inner: chosen(h, inner)))))


def sketch(text: Column, size: int = SKETCH) -> Column:
    hashes = F.transform(anchors(text), lambda a: a["hash"])
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def as_string(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    return bind(F.slice(F.sort_array(F.array_union(a, b)), 1, size), lambda low: F.when(
        F.size(low) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), low)) / F.size(low)))


def with_next_document(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds `next_<c>` for each carried column, from the next document by descending doc_id (after the last: the first).

    Documents go to ranges of ids of about equal size, whose bounds are at most `MOST_BUCKETS` approximate
    quantiles. Each range also gets the first document of the range after it, so that one window
    per range is enough and the texts are shuffled once. Equal ids go by text; null ids come last.
    """
    spark = docs.sparkSession
    buckets = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = sorted(set(keyed.agg(F.percentile_approx("_key", shares)).first()[0] or [0]))
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])

    def bucket(key: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.get(F.lit(bounds), at + step - 1) < key), at + step).otherwise(at))

    keyed = keyed.withColumn("_bucket", bucket(F.col("_key")))
    tops = [tuple(r) for r in keyed.groupBy("_bucket").agg(F.max("_key")).orderBy(F.desc("_bucket")).collect()]
    also: dict[int, list[int]] = {}
    for i, (_, top) in enumerate(tops):
        also.setdefault(top, []).append(tops[i - 1][0])
    ghosts = F.lit(None).cast("array<int>")
    if also:
        ghosts = F.element_at(F.create_map(*[x for top, to in also.items() for x in (
            F.lit(top), F.array(*[F.lit(b) for b in to]))]), F.col("_key"))
    here = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("lap")))
    there = F.transform(F.coalesce(ghosts, F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(1).alias("lap")))
    placed = keyed.select("*", F.explode(F.concat(here, there)).alias("_at"))
    order = Window.partitionBy("_at.b").orderBy(F.col("_at.lap"), F.desc("_key"), F.asc_nulls_first("text"))
    out = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return out.where("_at.lap = 0").drop("_key", "_bucket", "_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    own = docs.select("doc_id", text_of().alias("text")).withColumn("sketch", sketch(F.col("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    after = with_next_document(own, ["text", "sketch"]).withColumn("edited", edited)
    return after.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited", "sketch", "next_sketch",
        sketch(F.col("edited")).alias("edited_sketch"),
    ).select(
        "doc_id", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"), as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def _sql() -> str:
    def mix(array: str, at: str, weights: list[int]) -> str:
        return "(" + " + ".join(f"{array}[{at} + {j}] * {w}" for j, w in enumerate(weights)) + f") % {PRIME}"

    def stages(name: str, source: str, column: str) -> str:
        inner = [f"s[i + {j}]" for j in range(K - S + 1)]
        low = f"least({', '.join(inner)})"
        return f"""
{name}_h AS (SELECT doc_id, list_transform(regexp_extract_all({column}, '{token_pattern("")}'),
    lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT) AS h FROM {source}),
{name}_s AS (SELECT doc_id, h, list_transform(range(1, greatest(len(h) - {S} + 2, 1)), lambda i: {mix("h", "i", _weights(_INNER, S))}) AS s FROM {name}_h),
{name} AS (SELECT doc_id, CASE WHEN len(h) = 0 THEN []::BIGINT[]
    WHEN len(h) < {K} THEN [list_reduce(list_prepend(17::BIGINT, h), lambda a, x: (a * {_STEP} + x) % {PRIME})]
    ELSE list_sort(list_distinct(list_transform(list_filter(range(1, len(h) - {K} + 2),
        lambda i: {low} = {inner[0]} OR {low} = {inner[-1]}), lambda i: {mix("h", "i", _weights(_STEP, K))})))[1:{SKETCH}] END AS k FROM {name}_s)"""

    def text(k: str) -> str:
        return f"array_to_string(list_transform({k}, lambda x: lpad(lower(to_hex(x)), 8, '0')), '')"

    def near(a: str, b: str) -> str:
        low = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{SKETCH}]"
        return f"CASE WHEN len({low}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect({a}, {b}), {low}))::DOUBLE / len({low}) END"

    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM base WINDOW w AS (ORDER BY doc_id DESC)),
eds AS (SELECT doc_id, n, next_id, text[1:n - n // 2] || next_text[1:n // 2] AS edited FROM nexts),
{stages("own", "base", "text")},{stages("ed", "eds", "edited")}
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, {text("o.k")} AS fingerprint, {text("d.k")} AS edited_fingerprint,
    {near("o.k", "d.k")} AS near_edited, {near("o.k", "x.k")} AS near_next
FROM eds e JOIN own o USING (doc_id) JOIN ed d USING (doc_id) JOIN own x ON x.doc_id = e.next_id"""


@query("op1_syncmer_fingerprints", _sql())
def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
