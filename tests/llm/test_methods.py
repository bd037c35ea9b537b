"""Operators against plain versions of the same definitions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, mixing, nbsvm, pii, prefixtree, setjoin, syncmers, warc
from tidewell.llm.catalog import queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def groups_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_anchors_do_not_depend_on_what_stands_before(spark):
    tail = " ".join(f"w{i * 7919 % 1000}" for i in range(200))
    frame = spark.createDataFrame([(tail,), ("some other words first " + tail,)], "text string").select(syncmers.anchors(F.col("text")).alias("a"))
    first, second = [[(x["pos"], x["hash"]) for x in r["a"]] for r in frame.collect()]
    assert [(p + 4, h) for p, h in first] == [x for x in second if x[0] >= 4] and 60 < len(first) < 140


@pytest.mark.parametrize("name, label, of, held", [("op2_toxicity", "toxic", 3, 1), ("op6_nbsvm_quality", "quality", 4, 2)])
def test_held_out_accuracy(spark, name, label, of, held):
    got = queries()[name](spark, MIDDLE).where("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id")
    rows = got.select("predicted", label, "score").collect()
    assert len(rows) > 500 and sum(r["predicted"] == r[label] for r in rows) / len(rows) > 0.94  # labels hold some noise
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_dual_descent_separates():
    ratio = np.zeros(nbsvm.DIMS)
    ratio[:4] = (1.0, -1.0, 0.5, 0.1)
    rows = [np.array(r) for r in ([0, 2], [0, 3], [1, 3], [1], [0], [1, 3])]
    y = np.array([1, 1, -1, -1, 1, -1.0])
    w = nbsvm.dual_descent(rows, y, ratio)
    assert all(np.sign(w[r] @ ratio[r] + w[-1]) == t for r, t in zip(rows, y))


@pytest.mark.parametrize("k, percent, size", [(3, 90, 14), (3, 90, 90), (3, 90, 400), (5, 80, 12), (5, 80, 45), (5, 80, 150), (1, 50, 30)])
def test_jaccard_against_all_pairs(spark, k, percent, size):
    rng = random.Random(size * percent)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(max(1, size + rng.randrange(-4, 5)))]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(0, 2 + size // 25)):
                at = rng.randrange(len(t))
                t[at:at + 1] = rng.choice(([], [f"e{rng.randrange(50)}"], [t[at], f"e{rng.randrange(50)}"])) if len(t) > 1 else t[at:at + 1]
            texts.append(" ".join(t))
    texts += texts[:5] + ["", "lone"]

    def shingle(t):
        w = t.split()
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    sets = [shingle(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = groups_of(range(len(sets)), pairs)
    got = setjoin.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}


def test_linked_sets_share_a_list():
    rng = np.random.default_rng(5)
    for percent in (90, 80):
        for _ in range(400):
            n = int(rng.integers(20, 700))
            base = setjoin.mixed(rng.integers(1, 1 << 60, n).astype(np.uint64))
            other = np.unique(np.concatenate((base[int(rng.integers(0, n // 12 + 1)):], setjoin.mixed(rng.integers(1, 1 << 60, int(rng.integers(0, n // 12 + 1))).astype(np.uint64)))))
            base = np.unique(base)
            both = np.intersect1d(base, other).size
            if 100 * both >= percent * (base.size + other.size - both):
                assert np.intersect1d(setjoin.list_keys(base, percent), setjoin.list_keys(other, percent)).size


def test_chat_tree_shares_prefixes(spark):
    rows = [(c, i, r, t) for c, turns in enumerate((
        [("system", "S"), ("user", "a"), ("assistant", "1")], [("system", "S"), ("user", "a"), ("assistant", "2"), ("user", "b")],
        [("system", "S"), ("user", "c")], [("user", "other")], [("system", "S"), ("user", "a")])) for i, (r, t) in enumerate(turns)]
    forest = prefixtree.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = {r["node"]: r for r in forest.nodes.collect()}
    assert len(nodes) == 7
    for tree in {r["tree"] for r in nodes.values()}:
        own = sorted((r["start"], r["end"]) for r in nodes.values() if r["tree"] == tree)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    for r in nodes.values():
        chain, at = [r], r
        while at["parent"]:
            at = nodes[at["parent"]]
            assert at["start"] < chain[-1]["start"]  # depth first: parents come before
            chain.append(at)
        assert r["position"] == sum(x["end"] - x["start"] for x in chain[1:])
        assert {i for a in r["attends"] for i in range(a["start"], a["end"])} == {i for x in chain for i in range(x["start"], x["end"])}
        if r["loss_from"] is not None:
            assert r["role"] == "assistant" and r["formatted"][r["loss_from"]:r["loss_to"]] in "12"


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            value = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and value % 10 == 0) \
                    or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data_against_plain_search(spark):
    rng = random.Random(11)
    parts = list("aB9.@ -+()_:%") + ["1.2.3.4", "a@b.com_x@y.org", "4111 1111 1111 1111", "+1 (743) 555-3824", "é", "0000", "call 743 555-3824", "x (at) y (dot) com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["a." * 30000, "1 " * 30000, "9" * 30000, "a@" + "b." * 30000]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        base = [(x["start"], x["rank"], x["end"], x["kind"]) for x in r["base"]]
        assert base == plain_spans(texts[r["doc_id"]])
        assert set(base) <= {(x["start"], x["rank"], x["end"], x["kind"]) for x in r["spans"]}
    assert any(len(r["spans"]) > len(r["base"]) for r in found)


def test_reliabilities_favour_agreeing_labelers():
    prior, true, false = pii.reliabilities({"yyyyy": 60, "yyy-y": 20, "nnnn-": 50, "-nnnn": 30})
    assert 0.3 < prior < 0.7 and pii.posterior("yyyyy", prior, true, false) > 0.95 > 0.05 > pii.posterior("nnnnn", prior, true, false)


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, lang, t, n) for s, lang, t, n in (
        ("a", "en", "x", 900), ("a", "de", "x", 100), ("b", "en", "y", 200), ("b", "de", "y", 300), ("c", "en", "x", 50), ("c", "de", "y", 70))],
        "source string, lang string, topic string, tokens long")
    even = {"lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.5, "y": 0.5}}
    got = mixing.rake(cells, rounds=12, targets={"source": {"a": 0.4, "b": 0.4, "c": 0.2}, **even}).collect()
    weight = {}
    for r in got:
        weight[r["source"]] = weight.get(r["source"], 0) + r["ratio"] * r["tokens"] / 1620
    assert all(abs(weight[s] - x) < 0.02 for s, x in {"a": 0.4, "b": 0.4, "c": 0.2}.items())


def test_header_predicates_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{SMALL}/pages.parquet"), path)
    reader = warc.WarcReader(path, "digest")
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "https:"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and [t[0] for t in reader.tests] == ["record_type", "target_uri"]
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert rows and all(r[1] == "response" and r[2].startswith("https:") for r in rows)
    same = warc.read_archives(spark, path, "skip").where("record_type = 'response' AND target_uri LIKE 'https:%'")
    assert same.count() == len(rows) and all(r["computed_digest"] is None for r in same.collect())


def test_search_against_plain_windows(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(6)]
    texts = [" ".join(rng.choice([*words, "Out!"]) for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice((2, 3, 4, 7))))) for i in range(30)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for window in (3, 4):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, window).collect()}
        for d, text in enumerate(texts):
            w, hit, which = split(text), set(), set()
            for item, t in items:
                v = split(t)
                n = min(window, len(v))
                for i in range(len(v) - n + 1):
                    for j in range(len(w) - n + 1):
                        if w[j:j + n] == v[i:i + n]:
                            hit.update(range(j, j + n))
                            which.add(item)
            spans = [i for b, e in got[d]["spans"] for i in range(b, e)]
            assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"], spans) == (len(w), len(hit), sorted(which), sorted(hit))


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = np.concatenate(([0], rng.integers(1, 4, 500), [0], rng.integers(1, 4, 300), [0]))
    index = decontaminate.FMIndex(text)
    for n in (1, 2, 5, 9):
        at = int(rng.integers(1, 480))
        phrase = text[at:at + n]
        low, high = index.search(phrase[None, :])
        found = np.sort(index.locate(np.arange(low[0], high[0])))
        want = [i for i in range(text.size - n + 1) if (text[i:i + n] == phrase).all()]
        assert found.tolist() == want
