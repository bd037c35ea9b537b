"""The lists of the set join: what travels, and how the boundary is found."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewell.llm import setjoin


def plain(rows):
    on = {}
    for i, keys in rows:
        for k in keys:
            on.setdefault(k, set()).add(i)
    return {(min(ids), i) for ids in on.values() if len(ids) > 1 for i in ids}


def test_lists_travel_once_and_packed(spark):
    rng = random.Random(5)
    rows = [(i - 40, [rng.choice([-9, 7, 2**62]), *(rng.randrange(-2**63, 2**63) for _ in range(30)), *([i // 5] * 2)]) for i in range(300)]
    rows += [(1000, []), (1001, [5_000])]
    lists = spark.createDataFrame(rows, "id long, lists array<long>").repartition(3)
    out = setjoin._clusters(lists)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = list(map(tuple, out.collect()))
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert setjoin._clusters(lists.where(F.lit(False))).count() == 0
    assert setjoin._clusters(lists.where("id = 1000")).count() == 0


def test_buckets_hold_every_key():
    ids, lists = np.array([3, 1]), [np.array([4, -5, 6]), np.array([6])]
    found = setjoin.dealt(ids, lists, 4)
    assert sorted((i, k) for r in found.itertuples() for i, k in zip(r.ids, r.keys)) == [(1, 6), (3, -5), (3, 4), (3, 6)]
    assert found["bucket"].is_unique and found["bucket"].between(0, 3).all()


def test_boundary_counts_no_subsets_of_large_sets():
    began = time.time()
    assert setjoin.boundary({n: 10 for n in range(1, 4097)}, 80) in range(0, 20)
    assert time.time() - began < 5


def test_dealing_holds_little_at_a_time():
    """A batch of long texts brings millions of keys; what is held besides it does not grow with them."""
    rng = np.random.default_rng(8)
    lists = [rng.integers(-2**63, 2**63 - 1, 300) for _ in range(5_000)] + [rng.integers(0, 9, 400_000), np.zeros(0, dtype=np.int64)]
    batch = pd.DataFrame({"id": np.arange(len(lists)), "lists": pd.Series(lists, dtype=object)})
    tracemalloc.start()
    found, most = [], 0
    for part in setjoin.packed(iter([batch]), 16):
        size = sum(map(len, part["keys"]))
        assert size <= setjoin.SLICE_KEYS or size == 400_000
        found.append((size, sum(int(k.sum() % 1_000_003) + int(i.sum()) for k, i in zip(part["keys"], part["ids"]))))
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert sum(n for n, _ in found) == 1_900_000 and most < 64 * 2**20, most
    whole = [p for x in setjoin.packed(iter([batch.head(40)]), 4) for p in zip(np.concatenate(list(x["ids"])), np.concatenate(list(x["keys"])))]
    assert sorted(whole) == sorted((i, k) for i, keys in enumerate(lists[:40]) for k in keys)
