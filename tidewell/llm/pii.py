"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the spans of four base rules (email, ip, card, phone) and looser ones: mail addresses written out with
"at" and "dot", phone numbers without a country code, identity numbers, and names after a title or a known given name. Labelers
vote on each candidate (1 for, -1 against, 0 abstains): the base rule, a format check, a gazetteer, words in
front, and the characters around. Expectation-maximisation over the counts of equal votes estimates how reliable each labeler is; the
posteriors then train a logistic span classifier over votes, kind and shape. Base spans always stay; a looser
candidate is added if the classifier gives it `ACCEPT` or more and no base span overlaps it.

The counts are aggregated before they reach the driver, and there are at most kinds * 3^labelers * shapes of them, whatever the
size of the corpus. Patterns are written so that long texts need no deep stack and no quadratic search: quantified groups are
possessive or bounded, and a match can begin only where a run begins.

Null text is the empty text, without spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tidewell.llm.common import bind, read, saved, sha256_hex, text_of
from tidewell.llm.registry import query

KINDS = ("email", "ip", "card", "phone", "id", "name")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GIVEN_NAMES = ("James", "Mary", "John", "Anna", "Robert", "Maria", "Michael", "Sarah", "David", "Laura", "Thomas", "Julia", "Peter",
               "Emma", "Daniel", "Sofia", "Paul", "Elena", "Hans", "Marie", "Pierre", "Juan", "Carlos", "Claire")
TOP_DOMAINS = "com|org|net|edu|gov|io|info|co|de|fr|es|uk|us|eu"
_AT, _DOT = r"[\[(]\x20?at\x20?[\])]", r"(?:\.|[\[(]\x20?dot\x20?[\])])"
_WRITTEN = rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?{_AT}\x20?[{_LABEL}]{{1,63}}+(?:\x20?{_DOT}\x20?[{_LABEL}]{{1,63}}+){{1,5}}+"
_LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
_IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NAME = rf"\b(?:(?:Mr|Mrs|Ms|Dr)\.?|{'|'.join(GIVEN_NAMES)})\x20[A-Z][a-z]{{1,30}}+\b"
LOOSE = f"{_WRITTEN}|{_IDENTITY}|{_LOCAL_PHONE}|{_NAME}"
CUES = {
    "email": "mail|contact|write|address|correo|courriel", "ip": r"\bip\b|host|server|address|client", "id": "ssn|social|identity|passport|id",
    "card": "card|visa|credit|account|karte|tarjeta|carte", "phone": "phone|call|tel|mobile|fax|number|contact", "name": "name|contact|by|signed|dear",
}
LABELERS, ACCEPT, EM_ROUNDS, FIT_STEPS, AROUND = 5, 0.6, 60, 400, 24
SPAN = "array<struct<start:int,end:int,t:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Matches of `pattern` from left to right: array<struct<start, end, t>>."""
    def fold(found: Column, between: Column) -> Column:
        steps = F.arrays_zip(found.alias("t"), F.slice(between, 1, F.size(found)).alias("gap"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + F.length(x["gap"])
            end = begin + F.length(x["t"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
                begin.alias("start"), end.alias("end"), x["t"].alias("t")))).alias("out"))
        return F.aggregate(steps, start, step, lambda state: state["out"])

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) == 0, F.array().cast(SPAN)).otherwise(fold(found, F.split(text, pattern, -1))))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; every second digit from the right counts double."""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        double = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, double).otherwise(n)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(10, 15)
    return F.lit(True)


def _checked(found: Column, kind: str, rank: int) -> Column:
    return F.transform(F.filter(found, lambda x: _valid(kind, x["t"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["t"].alias("t")))


def base_spans(text: Column) -> Column:
    """The spans of the base rules that pass their check: array<struct<start, rank, end, kind, t>> in order."""
    parts = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        mark = "@" if kind == "email" else "[0-9]"
        found = F.when(text.rlike(mark), spans(text, pattern)).otherwise(F.array().cast(SPAN))
        parts.append(_checked(found, kind, rank))
    return F.sort_array(F.concat(*parts))


def loose_spans(text: Column) -> Column:
    """Looser candidates, in the same form."""
    def named(x: Column) -> Column:
        kind = F.when(x["t"].rlike(_AT), "email").when(x["t"].rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "id").when(
            x["t"].rlike("^[(0-9]"), "phone").otherwise("name")
        return F.struct(x["start"].alias("start"), F.array_position(F.lit(list(KINDS)), kind).cast("int").alias("rank") - 1, x["end"].alias("end"),
                        kind.alias("kind"), x["t"].alias("t"))
    return F.transform(spans(text, LOOSE), lambda x: named(x).cast("struct<start:int,rank:int,end:int,kind:string,t:string>"))


def votes(text: Column, x: Column, base: bool) -> Column:
    """The labelers' votes on a candidate, then its shape: one string, a letter each."""
    t, kind = x["t"], x["kind"]
    front = F.lower(F.substring(text, F.greatest(x["start"] - AROUND + 1, F.lit(1)), F.least(x["start"], F.lit(AROUND))))
    before = F.substring(text, x["start"], F.lit(1))
    after = F.substring(text, x["end"] + 1, F.lit(1))
    n_digits = F.length(_digits(t))

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, "y").when(no, "n").otherwise("-")
    rule = F.lit("y") if base else F.lit("-")
    form = vote((kind.isin("card", "ip")) | ((kind == "phone") & n_digits.between(10, 15)) | ((kind == "id") & ~t.rlike("^(000|666|9)|-00-|-0000$"))
                | ((kind == "email") & t.rlike("[A-Za-z]{2,}$")), kind != "name")
    gazetteer = vote(((kind == "email") & t.rlike(rf"(?i)(?:{TOP_DOMAINS})$")) | ((kind == "name") & t.rlike(f"^(?:{'|'.join(GIVEN_NAMES)})\\b"))
                     | ((kind == "card") & t.rlike("^[3-6]")) | ((kind == "phone") & t.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|8[0-9]|9[0-9])")),
                     kind.isin("email"))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & front.rlike(words))
    context = vote(cue, front.rlike(r"version|token|hash|isbn|\bv$|="))
    edges = vote(~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]"), before.rlike("[A-Za-z0-9]") & after.rlike("[A-Za-z0-9]"))
    shape = F.concat(F.when(F.length(t) <= 12, "s").when(F.length(t) <= 20, "m").otherwise("l"), F.when(n_digits * 2 > F.length(t), "d").otherwise("w"))
    return F.concat(rule, form, gazetteer, context, edges, shape)


def reliabilities(counts: dict[str, float]) -> tuple[float, list[dict], list[dict]]:
    """(prior, votes given a true span, votes given a false one), by expectation-maximisation over vote strings."""
    prior = 0.6
    true = [{"y": 0.7, "-": 0.2, "n": 0.1} for _ in range(LABELERS)]
    false = [{"y": 0.2, "-": 0.3, "n": 0.5} for _ in range(LABELERS)]
    for _ in range(EM_ROUNDS):
        held = {v: posterior(v, prior, true, false) for v in counts}
        total, good = sum(counts.values()), sum(counts[v] * p for v, p in held.items())
        prior = min(max((good + 1) / (total + 2), 1e-3), 1 - 1e-3)
        for i in range(LABELERS):
            for side, weight, start in ((true, lambda v: held[v], (7, 2, 1)), (false, lambda v: 1 - held[v], (2, 3, 5))):
                sums = {s: a + sum(counts[v] * weight(v) for v in counts if v[i] == s) for s, a in zip("y-n", start)}
                whole = sum(sums.values())
                side[i] = {s: x / whole for s, x in sums.items()}
    return prior, true, false


def posterior(v: str, prior: float, true: list[dict], false: list[dict]) -> float:
    a = math.log(prior) + sum(math.log(true[i][v[i]]) for i in range(LABELERS))
    b = math.log(1 - prior) + sum(math.log(false[i][v[i]]) for i in range(LABELERS))
    return 1 / (1 + math.exp(min(max(b - a, -50), 50)))


def feature_names(v: str, kind: str) -> list[str]:
    return ["bias", f"kind={kind}", f"size={v[LABELERS]}", f"mostly={v[LABELERS + 1]}"] + [f"{i}={v[i]}" for i in range(LABELERS)]


def train(rows: list[Row]) -> dict[str, float]:
    """Weights of the span classifier, from counts of (kind, votes)."""
    by_votes: dict[str, float] = {}
    for r in rows:
        by_votes[r["v"]] = by_votes.get(r["v"], 0) + r["n"]
    model = reliabilities(by_votes)
    data = [(feature_names(r["v"], r["kind"]), posterior(r["v"], *model), math.log1p(r["n"])) for r in rows]
    weights: dict[str, float] = {}
    total = sum(n for *_, n in data) or 1.0
    for _ in range(FIT_STEPS):
        slope: dict[str, float] = {f: 0.002 * w for f, w in weights.items()}
        for names, target, n in data:
            p = 1 / (1 + math.exp(-min(max(sum(weights.get(f, 0.0) for f in names), -30), 30)))
            for f in names:
                slope[f] = slope.get(f, 0.0) + n * (p - target) / total
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - 1.5 * g
    return weights


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: array<struct<start, rank, end, kind, t>> in order, and `chance` of the added ones is >= ACCEPT."""
    def apart(x: Column, base: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    def judged(found: Column, base: bool) -> Column:
        return F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "t")],
                                                     votes(F.col("text"), x, base).alias("v")))
    texts = docs.select("doc_id", text_of().alias("text"))
    first = texts.select("*", base_spans(F.col("text")).alias("b"), loose_spans(F.col("text")).alias("l"))
    rows = first.select("doc_id", judged(F.col("b"), True).alias("b"), judged(F.filter("l", lambda x: apart(x, F.col("b"))), False).alias("l"))
    rows = saved(rows, "candidates")
    seen = rows.select(F.explode(F.concat("b", "l")).alias("x")).groupBy("x.kind", "x.v").agg(F.count("*").alias("n")).collect()
    weights = train(seen)
    accepted = [r["kind"] + r["v"] for r in seen
                if 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in feature_names(r["v"], r["kind"])))) >= ACCEPT]
    added = F.filter("l", lambda x: F.array_contains(F.lit(accepted or [""]), F.concat(x["kind"], x["v"])))
    return rows.select("doc_id", F.col("b").alias("base"), F.sort_array(F.concat(F.col("b"), added)).alias("spans"))


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


@query("op5_pii_weak_supervision")
def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE],
        sha256_hex(as_string(F.col("base"))).alias("base_sha256"), as_string(F.col("spans")).alias("spans"))
