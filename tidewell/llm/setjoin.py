"""N-gram Jaccard join: a size-aware heavy-light join over word shingles, exact.

Words are what ASCII white space separates, A-Z folded; a document's set is its distinct shingles of `k` words, or its whole
word sequence if it has fewer; without words the set is empty and linked with nothing. Two documents link when
intersection / union >= `percent` / 100. Equal sets are one from the start (by two 64-bit hashes and the size).

Let n be the size of a set. Two linked sets A, B satisfy |A \\ B| + |B \\ A| <= |A & B| * (100 - percent) / percent.

Small sets (n up to a boundary) enumerate their subsets of the fixed sizes n - a that a link may leave, a = 0, 1, ...; two linked
sets meet in the subset that is their intersection. Whoever shares a subset of size i with the member that drops fewest
shingles (a) while dropping b itself is linked to it if a + b <= i * (100 - percent) / percent. Of two linked members one
link to that member follows for each, so one star per subset loses no connection and needs no further check.

Large sets are found through lists. Up to `MIDDLE` shingles a set is listed under its first shingles by hash: linked sets share one of the first
n - ceil(n * percent / 100) + 1 of each. Beyond that, single shingles say little, because passages that many documents share bring
unrelated ones together; the set is dealt by hash into more groups than there can be differing shingles, so that linked sets agree on a
whole group, and is listed under its groups. Each list becomes a cluster around its smallest id, and clusters are scanned in tasks: the
members' shingles form inverted lists, and each member counts its overlaps along them. A large cluster is scanned block against
block, so no task holds more than two blocks, and a task returns only links that join parts of the graph, not all pairs.

The boundary is the size from which listing prefix shingles costs less than enumerating subsets, worked out from the counts of
documents by size. Null text has no words. Rows that repeat a doc_id are one document: what one of them links to, all do. A null doc_id
links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.sizing import BROADCAST_LIMIT_BYTES, estimated_bytes, lookup_anti
from tidewell.llm.common import components, forget, read, saved
from tidewell.llm.registry import query

MIDDLE, BLOCK_SHINGLES, BUCKET_KEYS, MOST_SUBSETS, LIST_COST = 64, 1 << 19, 1 << 19, 64, 0.1
# What a Python worker holds at a time besides the batch it was given: word hashes, rows to return, list keys being dealt
KNOWN_WORDS, ROWS_OUT, SLICE_KEYS = 100_000, 512, 1 << 18
LADDER = 2 ** 0.5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. `known` keeps word hashes between calls."""
    import xxhash

    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh3_64_intdigest(t)
    h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if len(known) > KNOWN_WORDS:
        known.clear()
    width = min(k, h.size)
    out = np.full(h.size - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        out = mixed(out * _A + h[j:h.size - width + 1 + j])
    return np.unique(out)


def dropped(n: int, percent: int) -> int:
    """How many of its n shingles a set may lack in a linked one."""
    return n * (100 - percent) // 100


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, a) for a in range(dropped(n, percent) + 1))


def boundary(counts: dict[int, int], percent: int) -> int:
    """The size up to which sets enumerate subsets, chosen by cost over the number of distinct sets of each size.

    A subset costs a row. A prefix shingle costs a row and its part of the scan that follows, `LIST_COST` rows
    for a shingle of the set. Sets just below the boundary do both, which is counted too.
    """
    def cost(limit: int) -> float:
        low = limit * percent // 100
        return sum(c * subset_count(n, percent) for n, c in counts.items() if n <= limit) + sum(
            c * prefix_size(n, percent) * (1 + LIST_COST * n) for n, c in counts.items() if n > low)
    # Seven to drop are always too many; their subsets are not counted, which for large sets takes long
    options = [0, *sorted(n for n in counts if n > 0 and dropped(n, percent) <= 6 and subset_count(n, percent) <= MOST_SUBSETS)]
    return min(options, key=lambda n: (cost(n), n))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def subsets(s: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(hash of the subset, how many shingles it lacks) for every subset a link may leave."""
    parts = mixed(s * _B)
    whole = parts.sum(dtype=np.uint64, keepdims=True)
    lacks = [(drop, a) for a in range(dropped(s.size, percent) + 1) for drop in combinations(range(s.size), a)]
    lost = np.array([parts[list(drop)].sum(dtype=np.uint64) for drop, _ in lacks], dtype=np.uint64)
    left = mixed(whole - lost + np.array([s.size - a for _, a in lacks], dtype=np.uint64))
    return list(zip(_signed(left).tolist(), [a for _, a in lacks]))


def group_count(c: int, percent: int) -> tuple[int, int]:
    """(groups, spare) of size class c, whose sets have fewer than LADDER ** (c + 1) shingles.

    Linked sets of the class differ in `most` shingles at most, so of most + 1 + spare groups at least spare + 1 agree. `spare` is meant
    to exceed the number of empty groups, so that one of those that agree holds shingles.
    """
    most = int(2 * LADDER ** (c + 1) * (100 - percent) / (100 + percent))
    spare = 1
    while spare < most:
        count = most + 1 + spare
        empty = count * math.exp(-LADDER ** c * percent / 100 / count)
        if spare >= empty + 3 * math.sqrt(empty) + 1:
            break
        spare += 1
    return most + 1 + spare, spare


def groups(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of whole hash groups: two linked sets share at least one.

    A set belongs to the class of its size, and also to the next if a linked set could be there. Empty groups are left out
    unless there are more than `spare` of them: then sets might agree on empty groups alone.
    """
    own = int(math.log(s.size) / math.log(LADDER) + 1e-9)
    out = []
    for c in (own, own + 1):
        if c > own and s.size < LADDER ** c * percent / 100 - 1e-6:
            break
        count, spare = group_count(c, percent)
        at = (mixed(s + np.uint64(c)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0)))
        sums = np.zeros(count, dtype=np.uint64)
        sums[at[order][starts]] = np.add.reduceat(mixed(s * _B)[order], starts)
        filled = np.zeros(count, dtype=bool)
        filled[at] = True
        use = filled if (~filled).sum() <= spare else np.ones(count, dtype=bool)
        label = mixed(np.arange(count, dtype=np.uint64) + np.uint64(c * 1_000_003))
        out.append(mixed(sums + label)[use])
    return np.concatenate(out)


def list_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The lists a set is on: prefix shingles up to `MIDDLE`, hash groups beyond; around `MIDDLE`, both."""
    out = [s[:prefix_size(s.size, percent)]] if s.size <= MIDDLE else []
    if s.size * 100 > MIDDLE * percent:
        out.append(groups(s, percent))
    return np.concatenate(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """The number that stands for a set among the links, and another to tell sets apart."""
    sums = np.array([mixed(s * _A).sum(dtype=np.uint64), mixed(s * _B).sum(dtype=np.uint64)], dtype=np.uint64) + np.uint64(s.size)
    return tuple(_signed(mixed(sums)).tolist())


def _listed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, key1 and key2 (of the set), subsets (if there are at most `MOST_SUBSETS`) and lists, a row per document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        few: dict[int, bool] = {}
        for part in (batch[at:at + ROWS_OUT] for batch in batches for at in range(0, max(len(batch), 1), ROWS_OUT)):
            rows = []
            for i, text in zip(part["doc_id"], part["text"]):
                s = shingles(text, k, known)
                if not s.size:
                    rows.append((i, 0, 0, 0, [], []))
                    continue
                if s.size not in few:
                    few[s.size] = dropped(s.size, percent) <= 6 and subset_count(s.size, percent) <= MOST_SUBSETS
                rows.append((i, s.size, *set_key(s), subsets(s, percent) if few[s.size] else [], _signed(list_keys(s, percent))))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "key1", "key2", "subsets", "lists"])

    return docs.mapInPandas(run, "doc_id long, n long, key1 long, key2 long, subsets array<struct<key:long,a:int>>, lists array<long>")


def scan(members: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Links (a, b) found by the members of a block (probe true) among all members; links that add no connection are left out."""
    members = members.sort_values("id", kind="stable")
    ids = members["id"].to_numpy()
    known: dict[bytes, int] = {}
    sets = [shingles(t, k, known) for t in members["text"]]
    sizes = np.array([x.size for x in sets])
    tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    del sets, known
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.diff(np.append(first, tokens.size))
    shared = counts > 1
    first, counts = first[shared], counts[shared]
    row = np.full(order.size, -1, dtype=np.int32)
    spread = np.repeat(np.arange(first.size, dtype=np.int32), counts)
    inside = np.arange(spread.size) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    row[order[inside]] = spread
    del tokens, order, spread, inside
    edge = np.concatenate(([0], np.cumsum(sizes)))
    root = np.arange(sizes.size)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x in np.flatnonzero(members["probe"].to_numpy()):
        lists = row[edge[x]:edge[x + 1]]
        lists = lists[lists >= 0]
        if lists.size * 100 < percent * sizes[x]:  # too few of its shingles are in any other set
            continue
        c = counts[lists]
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[lists], c)
        overlap = np.bincount(of[at], minlength=sizes.size)
        linked = np.flatnonzero(overlap * 100 >= percent * (sizes[x] + sizes - overlap))
        for y in linked.tolist():
            p, q = find(int(x)), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(ids[x]), int(ids[y])))
    return pd.DataFrame(out, columns=["a", "b"])


def dealt(ids: np.ndarray, lists: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """The list keys of some sets, dealt into buckets by hash: bucket, ids and keys, side by side, a row per bucket."""
    keys = np.concatenate([np.zeros(0, dtype=np.int64), *lists])
    ids = np.repeat(ids, [len(x) for x in lists])
    bucket = (mixed(keys.view(np.uint64) + _A) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    starts = np.concatenate(([0], cuts))[:order.size]
    def parts(x: np.ndarray) -> pd.Series:
        return pd.Series(np.split(x[order], cuts) if order.size else [], dtype=object)
    return pd.DataFrame({"bucket": bucket[order][starts], "ids": parts(ids), "keys": parts(keys)})


def packed(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """The list keys (id, lists) dealt into buckets, at most `SLICE_KEYS` at a time or those of one set."""
    for batch in batches:
        ids, lists = batch["id"].to_numpy(), list(batch["lists"])
        ends, start = np.cumsum([len(x) for x in lists]), 0
        while start < len(lists):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + SLICE_KEYS, side="right")))
            yield dealt(ids[start:end], lists[start:end], buckets)
            start = end


def shared_lists(ids: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    """(top, id), once each, of the lists that hold more than one id; top is the smallest id of the list."""
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(fresh, keys.size))
    top, last = ids[fresh], ids[fresh + counts - 1]
    more = np.repeat(top < last, counts)
    return pd.DataFrame({"top": np.repeat(top, counts)[more], "id": ids[more]}).drop_duplicates()


def _clusters(lists: DataFrame) -> DataFrame:
    """(top, id) of the lists (id, lists: the keys of a set) that hold more than one set; top is the smallest id of the list.

    Nearly all keys have one set. So keys travel once, packed as numbers into buckets of bounded volume, and only those that are shared become rows.
    """
    spark = lists.sparkSession
    total = lists.agg(F.sum(F.size("lists"))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-total // BUCKET_KEYS))

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        return shared_lists(np.concatenate(list(frame["ids"])), np.concatenate(list(frame["keys"])))

    dealt_out = lists.mapInPandas(lambda batches: packed(batches, buckets), "bucket long, ids array<long>, keys array<long>")
    return dealt_out.groupBy("bucket").applyInPandas(found, "top long, id long").distinct()


def _scanned(member: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within clusters (top, id). A task scans one block of a cluster against another, each of bounded volume."""
    known = member.join(reps.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n")), "id")
    blocks = known.groupBy("top").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = known.join(blocks, "top").select("top", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    placed = saved(placed.select("top", "id", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own"), "placed")
    # Few places are sent to the texts, so that these travel once, to their blocks
    small = estimated_bytes(placed) <= BROADCAST_LIMIT_BYTES
    rows = texts.withColumnRenamed("doc_id", "id").join(F.broadcast(placed) if small else placed, "id").select(
        "top", "i", "j", "id", "text", (F.col("own") == F.col("i")).alias("probe"))
    return rows.groupBy("top", "i", "j").applyInPandas(lambda frame: scan(frame, k, percent), "a long, b long")


def _stars(small: DataFrame, percent: int) -> DataFrame:
    """Links of the sets that share a subset (key, a, id, n) with the member that lacks fewest shingles."""
    centre = small.groupBy("key").agg(F.min(F.struct("a", "id")).alias("c"), F.count("*").alias("m")).where("m > 1")
    return small.join(centre, "key").where(
        (F.col("a") + F.col("c.a")) * percent <= (F.col("n") - F.col("a")) * (100 - percent)).where("id <> c.id").select(
        F.col("id").alias("a"), F.col("c.id").alias("b"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included; null for a null doc_id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = saved(_listed(texts, k, percent), "listed")
    reps = saved(listed.where("n > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("rep")), "sets")
    counts = {r["n"]: r["c"] for r in reps.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count("*").alias("c")).collect()}
    limit = boundary(counts, percent)
    named = saved(listed.select("doc_id", "n", "key1", "key2"), "named")
    own = named.where("n > 0 AND doc_id IS NOT NULL").select("key1", "key2", "doc_id")
    same = saved(own.join(reps.select("key1", "key2", "rep"), ["key1", "key2"]).where("doc_id <> rep"), "copies")
    # Copies are told apart by their names, so that the lists stay where they are
    once = lookup_anti(listed.where("n > 0 AND doc_id IS NOT NULL"), same, ["doc_id", "key1", "key2"]).withColumnRenamed("doc_id", "id")
    small = once.where(F.col("n") <= limit).select("id", "n", F.inline("subsets"))
    lists = once.where(F.col("n") > limit * percent // 100).select("id", "lists")
    member = saved(_clusters(lists), "clusters")
    edges = saved(_stars(small, percent).union(_scanned(member, reps, texts, k, percent)), "links")
    forget(member), forget(listed)
    same = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # Copies are leaves: only ids that link to another set, or stand under two sets, take part in the iteration
    between = edges.union(same.join(same.groupBy("a").agg(F.countDistinct("b").alias("c")).where("c > 1").select("a"), "a").select("a", "b"))
    reached = components(between)
    forget(edges)
    label = reps.select("key1", "key2", "rep").join(reached.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key1", "key2", F.coalesce("component", "rep").alias("component_id"))
    heads = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key1"))
    return named.select("doc_id", "n", heads.alias("key1"), "key2").join(label, ["key1", "key2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose document has the smallest doc_id of its group; of repeated rows of one id, one.

    Rows with a null doc_id stay.
    """
    found = jaccard_components(docs, k, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
    dropped_ids = saved(found.where("_least <> doc_id").select("doc_id"), "dropped")
    named = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if docs.groupBy("doc_id").count().where(
        "doc_id IS NOT NULL AND count > 1").limit(1).count() else docs.where("doc_id IS NOT NULL")
    return named.join(dropped_ids, "doc_id", "left_anti").select(*docs.columns).union(docs.where("doc_id IS NULL"))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
t AS (SELECT rep, n, unnest(s) AS g FROM u),
p AS (SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
c AS (SELECT node, min(seen) AS least FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.least, u.rep, s.doc_id) AS component_id
FROM s LEFT JOIN u ON u.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN c ON c.node = u.rep"""


@query("op3_jaccard_join", SQL)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
