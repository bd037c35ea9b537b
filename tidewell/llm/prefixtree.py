"""Chat formatting as a prefix tree: turns that conversations share at their start are emitted once.

A turn is written as `OPEN` role, newline, text, `CLOSE`. Control strings inside roles and texts are escaped reversibly: a
backslash is doubled, and the first sign of every string in `CONTROLS` becomes a backslash and a letter. A node of the tree is a
prefix of turns; its identity is its depth and the exclusive or of position-dependent hashes of its turns. Trees grow from
first turns. Distinct conversations are sorted by their paths of nodes; a node belongs to the first that holds it, and
(that rank, depth) is depth-first order. `start` is the offset of a node in its tree's emission, a running sum over
blocks of the sort, carried from block to block by one total per block, so that no tree, however common its first turn, is
gathered in one task. `position` is where its tokens stand in each conversation that holds it, and `attends` are the merged
[start, end) intervals of its ancestors and itself, which a token may attend to (inside its own node causally).

A token is a code point, or an id of a tokenizer if its file is given. Null role and text are empty. Turns go by number, null first, ties by role
and text; repeated rows are turns of their own. A null conv_id is a conversation. Nothing follows from a table without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewell.llm.common import read, saved, sha256_hex
from tidewell.llm.registry import query

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# Control strings of chat templates in common use
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_LETTER = {"<": "l", "[": "b"}
RANK_BITS = 33  # of monotonically_increasing_id: the number within a partition


class Forest(NamedTuple):
    nodes: DataFrame  # tree, node, parent, depth, role, formatted, start, end, position, attends, loss_from, loss_to, ids
    conversations: DataFrame  # conv_id, tree, leaf, starts (of the nodes of its path)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit("\\" + _LETTER[c[0]] + c[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    def part(p: Column) -> Column:
        for letter, sign in (("l", "<"), ("b", "["), ("n", "\n")):
            p = F.replace(p, F.lit("\\" + letter), F.lit(sign))
        return p
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their node, tree, length and position."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    said = escape(F.col("text"))
    rows = rows.select("*", F.row_number().over(order).alias("depth"), F.concat(head, said, F.lit(CLOSE)).alias("formatted"),
                       F.length(head).alias("loss_from"), F.length(said).alias("said"))
    run = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.select("*", F.bit_xor(F.xxhash64("depth", "role", "text")).over(run).alias("x"),
                        F.bit_xor(F.xxhash64("text", F.lit(0x5bd1), "role", "depth")).over(run).alias("y"))
    return keyed.select(
        "conv_id", "depth", "role", "formatted", "x", "y", F.concat_ws("-", F.col("depth").cast("string"), F.hex("x"), F.hex("y")).alias("node"),
        F.when(F.col("role") == "assistant", F.col("loss_from")).alias("loss_from"),
        F.when(F.col("role") == "assistant", F.col("loss_from") + F.col("said")).alias("loss_to"))


def _with_tokens(nodes: DataFrame, tokenizer_file: str | None) -> DataFrame:
    """Adds ids (null without a tokenizer) and size, the number of tokens."""
    if tokenizer_file is None:
        return nodes.withColumn("ids", F.lit(None).cast("array<int>")).withColumn("size", F.length("formatted").cast("long"))
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = nodes.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(sent.value)
        for texts in batches:
            yield pd.Series([e.ids for e in tokenizer.encode_batch(texts.tolist(), add_special_tokens=False)])

    return nodes.withColumn("ids", encode("formatted")).withColumn("size", F.size("ids").cast("long"))


def build(conversations: DataFrame, tokenizer_file: str | None = None) -> Forest:
    spark = conversations.sparkSession
    turns = saved(_turns(conversations), "turns")
    light = turns.select("conv_id", "depth", "node", "x", "y")
    convs = light.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).getField("node").alias("leaf"), F.sort_array(
        F.collect_list(F.struct("depth", "x", "y", "node"))).alias("path"))
    convs = saved(convs, "paths")
    paths = convs.groupBy("leaf").agg(F.first("path").alias("path"))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = paths.repartitionByRange(blocks, "path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id())
    ranked = saved(ranked, "ranks")
    on_path = ranked.select("leaf", "rank", F.col("path")[0]["node"].alias("tree"), F.posexplode("path.node").alias("at", "node"))
    first = on_path.groupBy("node").agg(F.min(F.struct("rank", "tree")).alias("f")).select("node", "f.rank", "f.tree")
    texts = turns.groupBy("node").agg(*[F.first(c).alias(c) for c in ("depth", "role", "formatted", "loss_from", "loss_to")])
    texts = _with_tokens(texts, tokenizer_file).join(first, "node")
    block = F.shiftright("rank", RANK_BITS)
    placed = texts.withColumn("block", block)
    inside = Window.partitionBy("block").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = saved(placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))), "placed")
    totals = placed.groupBy("block").agg(F.sum("size").alias("total"))  # a row per sort partition
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carried"))
    spots = placed.select("node", "block", "tree", "depth", "rank", "size", "before").join(carried, "block").withColumn(
        "offset", F.col("before") + F.col("carried"))
    roots = spots.where("depth = 1").select("tree", F.col("offset").alias("root"))
    spots = spots.join(roots, "tree").select("node", "tree", "size", (F.col("offset") - F.col("root")).alias("start"))
    spots = saved(spots.withColumn("end", F.col("start") + F.col("size")), "spots")
    along = on_path.join(spots.select("node", "start", "end"), "node").groupBy("leaf", "rank", "tree").agg(
        F.sort_array(F.collect_list(F.struct("at", "node", "start", "end"))).alias("path"))
    along = saved(along, "along")
    owned = along.select("rank", "path", F.explode("path").alias("p")).join(first.select("node", "rank"), (F.col("p.node") == F.col("node")) & (
        along["rank"] == first["rank"])).select("p", F.slice("path", 1, F.col("p.at") + 1).alias("up"))
    shown = owned.select(
        F.col("p.node").alias("node"), F.get(F.col("up.node"), F.size("up") - 2).alias("parent"), F.col("p.start").alias("start"), F.col("p.end").alias("end"),
        F.aggregate("up", F.lit(0).cast("long"), lambda n, u: n + u["end"] - u["start"], lambda n: n).alias("_with"), merged(F.col("up")).alias("attends"))
    nodes = placed.select("node", "tree", "depth", "role", "formatted", "loss_from", "loss_to", "ids").join(shown, "node").select(
        "tree", "node", "parent", "depth", "role", "formatted", "start", "end", (F.col("_with") - F.col("end") + F.col("start")).alias("position"), "attends",
        "loss_from", "loss_to", "ids")
    members = convs.select("conv_id", "leaf").join(along.select("leaf", "tree", F.col("path.start").alias("starts")), "leaf")
    return Forest(saved(nodes, "nodes"), saved(members.select("conv_id", "tree", "leaf", "starts"), "members"))


def merged(path: Column) -> Column:
    """Intervals of a path, in order, with neighbours joined: array<struct<start, end>>."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(out: Column, p: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joins = (F.size(out) > 0) & (last["end"] == p["start"])
        new = F.array(F.struct(F.when(joins, last["start"]).otherwise(p["start"]).alias("start"), p["end"].alias("end")))
        return F.concat(F.when(joins, F.slice(out, 1, F.size(out) - 1)).otherwise(out), new).cast(kind)
    return F.aggregate(path, F.array().cast(kind), step)


def read_back(forest: Forest) -> DataFrame:
    """conv_id, tree and turns: array<struct<at, role, text, formatted, loss>> as the nodes hold them."""
    spots = forest.conversations.groupBy("leaf", "tree").agg(F.first("starts").alias("starts")).select("leaf", "tree", F.posexplode("starts").alias("at", "start"))
    turn = rf"(?s)^{OPEN.replace('|', chr(92) + '|')}(.*?)\n(.*){CLOSE.replace('|', chr(92) + '|')}$"
    nodes = forest.nodes.select(
        "tree", "start", F.col("formatted"), unescape(F.regexp_extract("formatted", turn, 1)).alias("role"), unescape(F.regexp_extract("formatted", turn, 2)).alias("text"),
        F.when(F.col("loss_from").isNotNull(), unescape(F.substring(
            F.col("formatted"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))).alias("loss"))
    whole = spots.join(nodes, ["tree", "start"]).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "formatted", "loss"))).alias("turns"))
    return forest.conversations.select("conv_id", "tree", "leaf").join(whole, "leaf").drop("leaf")


def _sql() -> str:
    def sql_escape(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in CONTROLS:
            x = f"replace({x}, '{c}', '\\{_LETTER[c[0]]}{c[1:]}')"
        return x
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({sql_escape("role")}, chr(10), '\\n')) + length({sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op4_prefix_tree_chat", _sql())
def op4_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(build(given.union(extra)))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.filter(F.col("turns.loss"), lambda x: x.isNotNull()), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(all_turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha256_hex(loss).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["formatted"])).alias("formatted_chars"))
