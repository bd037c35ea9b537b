"""Fill-in-middle against a plain cut of the units, for several units, markers in texts, and long texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import infill

TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a\r\nb\rc\n\nd", "holds <P> inside\nx", "holds <M>\n", "ends with <\n<S\n<", "é中\n\U0001F600\n é x\n",
    "$1 \\1 {2}\n(a|b)+\n[x\n\\E\\Q\n", "\x00\x0b\x85 \nz", "line\n" * 50, "x " * 100, "l" * 300_000, "a b\n" * 100_000,
]
PLAIN = {infill.LINES: r"[^\n]*\n|[^\n]+", infill.WORDS: r"\s*\S+|\s+", infill.CHARACTERS: r"(?s:.)"}


def plain(doc_id, text, unit, rate, spm):
    text = text or ""
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall(PLAIN[unit], text, re.ASCII)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", (p, m, s)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", (p, m, s)


@pytest.mark.parametrize("unit, rate, spm", [(infill.LINES, 100, 50), (infill.WORDS, 100, 50), (infill.CHARACTERS, 100, 50), (infill.LINES, 40, 100), (infill.LINES, 0, 0)])
def test_against_a_plain_cut(spark, unit, rate, spm):
    rows = [(i * 31 + j, t) for j in range(6) for i, t in enumerate(TEXTS)] + [(None, "null id\nhere"), (5, "same id\n"), (5, "same id\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "output", "h0", "first", "lang")})
    made = infill.fill_in_middle(docs, unit, rate=rate, spm=spm).repartition(8)
    got = made.select("*", infill.parts(F.col("output"), F.col("form")).alias("p"), infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    want = {(d, t or ""): plain(d, t, unit, rate, spm) for d, t in rows}
    for r in got:
        n, form, output, cut = want[r["doc_id"], r["text"]]
        assert (r["n"], r["form"]) == (n, form) and r["output"] == output and r["back"] == r["text"]
        assert (None if r["p"] is None else tuple(r["p"])) == cut
    forms = {r["form"] for r in got}
    assert forms == ({"plain"} if rate == 0 else {"plain", "spm"} if spm == 100 else {"plain", "spm", "psm"})


def test_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
