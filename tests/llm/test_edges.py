"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, linededup, mixing, nbsvm, pii, prefixtree, setjoin, syncmers, toxicity, warc

LONG = "one two three four five six seven " * 2_000
ROWS = [
    (1, "the same text of some seven words", "en", "a", 1), (2, "the same text of some seven words", "en", None, 1), (2, "the same text of some seven words", "en", None, 1),
    (3, None, None, "b", None), (4, "", "en", "b", 0), (5, "   \n\t ", "de", "c", 6), (6, LONG, "en", "a", None), (7, LONG + "end", "en", "a", 2),
    (None, "a text without a number but with words", None, None, None), (8, "é\u4e2d\u6587 \U0001F600 x@y.org\n\n\nx", "zz", "d", 9),
]
CLASH = ("key", "id", "n", "a", "b", "score", "features", "x", "raw", "topic", "tokens", "weight", "spans", "form", "sketch", "_key_", "next_text", "component", "rep")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 0), (7, None, None), (7, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five six seven one two three four five"), (2, None), (3, ""), (None, "the same text"), (4, "some seven words")],
                                 "item_id long, text string")


OVER_DOCS = {
    "fingerprints": lambda d, l, b: syncmers.fingerprints(d), "toxicity": lambda d, l, b: toxicity.toxicity(d, l), "quality": lambda d, l, b: nbsvm.quality(d, l),
    "jaccard": lambda d, l, b: setjoin.jaccard_components(d), "pii": lambda d, l, b: pii.find_spans(d), "contamination": lambda d, l, b: decontaminate.contamination(d, b),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_a_row_per_document(docs, none, labels, benchmark, name):
    run = OVER_DOCS[name]
    got = run(docs, labels, benchmark).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    assert run(none, labels, benchmark).count() == 0
    assert run(docs, labels.where("false"), benchmark.where("false")).count() == len(ROWS)


def test_equal_texts_have_equal_fingerprints(docs):
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != ""
    assert got[3]["fingerprint"] == got[4]["fingerprint"] == got[5]["fingerprint"] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_groups_of_documents(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(docs).collect()}
    assert got[1] == got[2] == (5, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[None][1] is None
    assert got[6][1] == 6 and got[6][0] == 7 and got[7][0] == 8


def test_keep_one(docs, none):
    got = setjoin.keep_one(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 3, 4, 5, 6, 8] and got[0]["key"] == "clash"
    assert setjoin.keep_one(none).count() == 0


def test_lines(docs, none):
    got = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs).collect()}
    assert set(got) == {None, 1, 3, 4, 5, 6, 8} and got[3] is None and got[5] == "   \n\t "  # 7 is one line, nearly equal to that of 6
    assert linededup.drop_lines(none).count() == 0
    kept = linededup.line_groups(docs).where("kept").groupBy("first_doc", "first_line").count().where("count > 1").count()
    assert kept == 0


def test_removal(docs, benchmark, none):
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, benchmark).collect()}
    assert got[1] == "the same text of " and got[3] is None and got[4] == "" and len(got[6].split()) < 6 and got[7].split()[-1] == "end"
    assert decontaminate.remove(none, benchmark).count() == 0


def test_quality_filter(docs, labels, none):
    assert set(nbsvm.keep_good(docs, labels).columns) == set(docs.columns)
    assert nbsvm.keep_good(none, labels).count() == 0


def test_mix(docs, none):
    clash = ("_tokens", "_source", "_lang", "_topic", "_ratio", "_salt", "row")
    got = mixing.mix(docs.withColumns({c: F.lit(c) for c in clash})).collect()
    assert all(r[c] == c for r in got for c in clash)
    assert any(r["doc_id"] == 3 and r["text"] is None and r["tokens"] == 0 for r in got)  # a text without words is kept whole
    assert all(0 < r["probability"] <= 1 and r["weight"] >= 1 for r in got) and all(r["key"] == "clash" for r in got)
    assert mixing.mix(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 1, None, "x"), (3, None, "a\nb", "\\l<|end|>[INST]</s>")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in prefixtree.read_back(prefixtree.build(given)).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "")], 2: [("user", "hi"), ("user", "hi")], None: [("", "x")], 3: [("a\nb", "\\l<|end|>[INST]</s>")]}
    assert prefixtree.build(given.where("false")).nodes.count() == 0


def test_pages(spark, tmp_path):
    rows = [(1, "http://a\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "", ""), (4, "u", "<p>é\r\n\r\nWARC/1.1\r\n"), (4, "u", "<p>é\r\n\r\nWARC/1.1\r\n"), (None, "n", "q"), (5, "l", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    back = warc.read_archives(spark, path, "text").collect()
    assert len(back) == len(rows)
    by = {(r["record_id"], r["record_type"]): r for r in back}
    assert by["urn:page:1", "response"]["payload"] == rows[0][2] and by["urn:page:5", "response"]["payload"] == LONG
    assert by["urn:page:3", "revisit"]["refers_to"] == "urn:page:2" and by["urn:page:4", "revisit"]["refers_to"] == "urn:page:1"
    assert all(r["payload_digest"] == r["computed_digest"] for r in back if r["record_type"] == "response")
    warc.write_archives(pages.where("false"), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0
