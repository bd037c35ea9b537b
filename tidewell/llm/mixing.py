"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic; a cell weighs its tokens (words between white space). The cell weights are
raked to the target shares of each source, language and topic in turn, `ROUNDS` times. By default a target is the share
of tokens to the power `TEMPERATURE`, normalised, which lifts small sources. A cell's ratio is its raked weight over its tokens: its
documents are sampled with probability min(1, ratio), by a hash of doc_id, and those kept carry weight ratio / probability, so
that the expected weighted tokens meet the targets.

The texts are read twice and not shuffled; only cells are, after they are summed per task. Null source or language is a value of
its own, written ''. A null text has no tokens. A cell without tokens has ratio 1. Repeated rows are sampled alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewell.functions.sizing import lookup_join
from tidewell.llm.common import read, saved
from tidewell.llm.registry import query

ROUNDS, TEMPERATURE = 6, 0.7
DIMENSIONS = ("source", "lang", "topic")
TOPICS = (("licence", "[Ll]icen[sc]e|[Cc]opyright"), ("contact", r"@|\+[0-9]"), ("table", r"\|"), ("prose", ""))


def topic(text: Column, rules: tuple = TOPICS) -> Column:
    """The first rule that matches."""
    out = None
    for name, pattern in rules:
        hit = text.rlike(pattern) if pattern else F.lit(True)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def described(docs: DataFrame) -> DataFrame:
    """The whole row as `row`, whatever its columns are called, with what is raked by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("_lang"), topic(text).alias("_topic"),
        F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")).cast("long").alias("_tokens"))


def rake(cells: DataFrame, rounds: int = ROUNDS, temperature: float = TEMPERATURE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with ratio: raked weight over tokens. `targets` may name shares per dimension."""
    out = cells
    for d in DIMENSIONS:
        if targets and d in targets:
            wanted = F.lit(0.0)
            for value, share in targets[d].items():
                wanted = F.when(F.col(d) == value, F.lit(float(share))).otherwise(wanted)
            out = out.withColumn(f"t_{d}", wanted)
            continue
        sums = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("p"))
        whole = sums.agg(F.sum("p")).first()[0] or 1.0
        out = lookup_join(out, sums.select(d, (F.col("p") / whole).alias(f"t_{d}")), [d], ["source", "lang", "topic"])
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = out.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = F.sum("w").over(Window.partitionBy(d))
            out = out.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"t_{d}") * total / now).otherwise(F.col("w")))
        out = saved(out, "raked")
    return out.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.round(F.col("w") / F.col("tokens"), 9)).otherwise(1.0).alias("ratio"))


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    hashed = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, rounds: int = ROUNDS, temperature: float = TEMPERATURE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of `docs`, with topic, tokens, probability and weight (which replace columns of these names)."""
    own = [c for c in docs.columns if c not in ("topic", "tokens", "probability", "weight")]
    rows = described(docs.select(*own))
    cells = saved(rows.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens")), "cells")
    ratios = rake(cells, rounds, temperature, targets).select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("ratio").alias("_ratio"))
    joined = lookup_join(rows, ratios, [f"_{d}" for d in DIMENSIONS], ["row.doc_id"])
    probability = F.least(F.col("_ratio"), F.lit(1.0))
    return joined.where(chance(F.col("row.doc_id")) < probability).select(
        "row.*", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), probability.alias("probability"),
        F.when(F.col("_ratio") > 0, F.round(F.col("_ratio") / probability, 6)).otherwise(1.0).alias("weight"))


def mix_sql(source: str, columns: str, rounds: int = ROUNDS, temperature: float = TEMPERATURE) -> str:
    """The same in SQL, as the body of a query over relation `source`, and the list of its common table expressions."""
    cases = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in TOPICS if p)
    steps = [f"""
desc_rows AS (SELECT *, coalesce(source, '') AS c_source, coalesce(lang, '') AS c_lang, coalesce(text, '') AS x FROM {source}),
topics AS (SELECT *, CASE {cases} ELSE '{TOPICS[-1][0]}' END AS c_topic,
    CAST(len(regexp_extract_all(x, '[^\\x09-\\x0D\\x20]+')) AS BIGINT) AS c_tokens FROM desc_rows),
cells AS (SELECT c_source AS source, c_lang AS lang, c_topic AS topic, CAST(sum(c_tokens) AS BIGINT) AS tokens FROM topics GROUP BY ALL)"""]
    for d in DIMENSIONS:
        steps.append(f"""
p_{d} AS (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {temperature}) AS p FROM cells GROUP BY {d}),
s_{d} AS (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS t_{d} FROM p_{d})""")
    steps.append("""
w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w, (SELECT sum(tokens) FROM cells) AS total FROM cells
    JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic))""")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"""
w{n + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER q > 0 THEN w * t_{d} * total / sum(w) OVER q ELSE w END AS w) FROM w{n} WINDOW q AS (PARTITION BY {d}))""")
            n += 1
    steps.append(f"""
ratios AS (SELECT source AS c_source, lang AS c_lang, topic AS c_topic,
    CASE WHEN tokens > 0 THEN round(w / tokens, 9) ELSE 1.0::DOUBLE END AS ratio FROM w{n})""")
    return ",".join(steps) + f"""
SELECT {columns}, c_topic AS topic, c_tokens AS tokens, least(ratio, 1.0::DOUBLE) AS probability,
    CASE WHEN ratio > 0 THEN round(ratio / least(ratio, 1.0::DOUBLE), 6) ELSE 1.0::DOUBLE END AS weight
FROM topics JOIN ratios USING (c_source, c_lang, c_topic)
WHERE ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(ratio, 1.0::DOUBLE)"""


@query("op7_raked_mix", "WITH " + mix_sql("documents", "doc_id, source, lang"))
def op7_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")
