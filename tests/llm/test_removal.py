"""What taking benchmark passages out of texts costs."""

import numpy as np
import pandas as pd

from tidewell.llm import decontaminate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_text_is_searched_once(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"before {passage} after", 0), (2, passage, 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, n_chars long")
    out = decontaminate.remove(docs, spark.createDataFrame([("b", passage)], "item_id string, text string"))
    assert plan(out).count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, "before  after", 13), (3, None, None), (4, "", 0)]


def test_a_shard_keeps_numbers_and_no_words():
    phrases = decontaminate.Phrases([("b", "one two three")])
    (part, numbers, found), = decontaminate._shards(iter([pd.DataFrame({"text": ["x one two three", None]})]), phrases)
    assert [n.dtype for n in numbers] == [np.int32] * 2 and [n.size for n in numbers] == [4, 0]
    assert found == [({"b"}, [[1, 4]]), (set(), [])]
