"""Expected against actual: results, readiness, launch gate, recall."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.levels import round_half_even, severity_rank
from tidewell.functions.ordered import top_per_key

# Which suites make up which readiness category.
CATEGORY_SUITES = {
    "AI Detection": ("normal", "jokes", "sarcasm", "idioms"),
    "Context Understanding": ("ambiguous", "edge_contradictory", "edge_mixed"),
    "Safety Responses": ("distress", "academic", "isolation"),
    "Reliability": ("edge_typos_slang",),
}
SUITES = (
    "normal", "jokes", "sarcasm", "idioms", "distress", "academic", "isolation", "ambiguous",
    "edge_typos_slang", "edge_contradictory", "edge_mixed",
)
# Checklist categories the launch gate reads.
GATE_CATEGORIES = ("AI", "Product", "Safety", "Privacy", "Engineering", "User Experience")
# Fields a patch may change.
BUG_FIELDS = ("title", "description", "category", "severity", "repro", "expected", "actual",
              "attachment", "status", "assignee", "verified")
IMPROVEMENT_FIELDS = ("title", "category", "priority", "reason", "status")


def _rank(level: Column) -> Column:
    return severity_rank(F.lower(F.coalesce(level, F.lit(""))), unknown=-1)


def result_of(expected: Column, actual: Column, has_actual: Column) -> Column:
    """PASS, REVIEW or FAIL by the severity gap alone. No actual is REVIEW."""
    gap = F.abs(_rank(expected) - _rank(actual))
    return F.when(~has_actual, "REVIEW").when(gap >= 2, "FAIL").when(gap == 1, "REVIEW").otherwise("PASS")


def failure_kind(expected: Column, actual: Column, has_actual: Column, error: Column, result: Column) -> Column:
    return (F.when(result == "PASS", F.lit(None).cast("string"))
            .when(~has_actual | F.coalesce(error, F.lit(False)), "SYSTEM ERROR")
            .when(result == "REVIEW", "AMBIGUOUS")
            .when(_rank(actual) > _rank(expected), "FALSE POSITIVE")
            .when(_rank(actual) < _rank(expected), "FALSE NEGATIVE")
            .otherwise("AMBIGUOUS"))


def score_results(tests: DataFrame, actuals: DataFrame, key: str = "test_id") -> DataFrame:
    """Tests with their actual, result and failure kind. `actuals` holds one row per test at most."""
    joined = tests.join(actuals.withColumn("_has", F.lit(True)), key, "left")
    has = F.coalesce("_has", F.lit(False))
    scored = joined.withColumn("result", result_of(F.col("expected_severity"), F.col("actual_severity"), has))
    return scored.withColumn("failure_kind", failure_kind(
        F.col("expected_severity"), F.col("actual_severity"), has, F.col("error"), F.col("result"))).drop("_has")


def latest_results(runs: DataFrame, key: str = "test_id") -> DataFrame:
    """The most recent run of every test."""
    fields = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("run_at", "run_id")).alias("r")).select(key, "r.*")


def context_pairs(sides: DataFrame) -> DataFrame:
    """Both sides of every contrast pair in one row: (pair_id, side, severities) -> a_*, b_*."""
    scored = sides.withColumn("result", result_of(
        F.col("expected_severity"), F.col("actual_severity"), F.col("actual_severity").isNotNull()))
    row = F.struct("input", "expected_severity", "actual_severity", "result")
    side = scored.groupBy("pair_id").agg(
        F.max_by(row, F.when(F.col("side") == "a", F.col("run_at"))).alias("a"),
        F.max_by(row, F.when(F.col("side") == "b", F.col("run_at"))).alias("b"))
    words = lambda text: F.array_distinct(F.split(F.lower(F.trim(text)), r"[^\p{L}']+"))
    shared = F.array_remove(F.array_intersect(words(F.col("a.input")), words(F.col("b.input"))), "")
    return side.select(
        "pair_id", F.col("a.expected_severity").alias("a_expected"), F.col("b.expected_severity").alias("b_expected"),
        F.col("a.result").alias("a_result"), F.col("b.result").alias("b_result"),
        F.size(shared).alias("shared_words"),
        ((F.col("a.result") == "PASS") & (F.col("b.result") == "PASS")).alias("told_apart"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("result") == r).alias(name)
            for r, name in (("PASS", "passed"), ("FAIL", "failed"), ("REVIEW", "review"))]


def suite_runs(results: DataFrame, keep: int = 200) -> DataFrame:
    """Summary of every suite run, the last `keep` of them."""
    runs = results.groupBy("suite", "run_id", "tester", "version").agg(
        F.count("*").alias("count"), *_counts(), F.max("run_at").alias("run_at"))
    runs = runs.withColumn("accuracy", round_half_even(100 * F.col("passed") / F.col("count")))
    return runs.orderBy(F.desc("run_at"), F.desc("run_id"), F.desc("suite")).limit(keep)


def suite_cards(tests: DataFrame, suites: Sequence[str] = SUITES) -> DataFrame:
    """Counts and accuracy per suite; an untested suite has no accuracy."""
    spark = tests.sparkSession
    listed = spark.createDataFrame([(s,) for s in suites], "suite string")
    ran = tests.groupBy(F.col("category").alias("suite")).agg(
        F.count("*").alias("tests"), F.count("result").alias("run"), *_counts())
    return listed.join(ran, "suite", "left").select(
        "suite", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tests", "run", "passed", "failed", "review")],
        F.when(F.col("run") > 0, round_half_even(100 * F.col("passed") / F.col("run"))).alias("accuracy"))


def category_of(suite: Column, table: Mapping[str, Sequence[str]] = CATEGORY_SUITES) -> Column:
    named = F.lit(None).cast("string")
    for name, suites in table.items():
        named = F.when(suite.isin(list(suites)), name).otherwise(named)
    return named


def category_scores(tests: DataFrame) -> DataFrame:
    """Share of passed tests per category, categories without a run left out."""
    return tests.withColumn("name", category_of(F.col("category"))).where(
        F.col("name").isNotNull() & F.col("result").isNotNull()).groupBy("name").agg(
        round_half_even(100 * F.count_if(F.col("result") == "PASS") / F.count("*")).alias("score"))


def pass_rates(resource_tests: DataFrame, privacy_checks: DataFrame) -> DataFrame:
    """Pass share of resource tests and of tested privacy checks."""
    rate = round_half_even(100 * F.count_if(F.col("outcome") == "PASS") / F.count("*")).alias("score")
    outcomes = resource_tests.select(F.lit("Resources").alias("name"), F.col("result").alias("outcome")).unionByName(
        privacy_checks.where(F.col("status").isin("PASS", "FAIL")).select(
            F.lit("Privacy").alias("name"), F.col("status").alias("outcome")))
    return outcomes.groupBy("name").agg(rate)


def bug_counts(bugs: DataFrame) -> DataFrame:
    is_open = ~F.coalesce(F.col("status").isin("FIXED", "CLOSED"), F.lit(False))
    return bugs.agg(F.count_if(is_open).alias("open_bugs"),
                    F.count_if(is_open & (F.col("severity") == "CRITICAL")).alias("critical_bugs"))


def readiness_status(critical: Column, completed: Column, total: Column, unclear: Column, overall: Column) -> Column:
    return (F.when(critical > 0, "NOT READY").when(completed == 0, "NOT READY")
            .when(completed < total, "TESTING").when(unclear > 0, "NEEDS REVIEW")
            .when(overall >= 90, "READY FOR PILOT").otherwise("MVP READY"))


def readiness(tests: DataFrame, resource_tests: DataFrame, privacy_checks: DataFrame, bugs: DataFrame) -> DataFrame:
    """One row: overall score, test counts, bug counts and status."""
    scores = category_scores(tests).unionByName(pass_rates(resource_tests, privacy_checks))
    overall = scores.agg(F.coalesce(round_half_even(F.avg("score")), F.lit(0)).alias("overall"))
    open_bugs = bug_counts(bugs)
    counted = tests.agg(F.count("*").alias("total"), F.count("result").alias("completed"), *_counts())
    row = counted.select(
        "*", overall.scalar().alias("overall"), open_bugs.select("open_bugs").scalar().alias("open_bugs"),
        open_bugs.select("critical_bugs").scalar().alias("critical_bugs"))
    return row.withColumn("status", readiness_status(
        F.col("critical_bugs"), F.col("completed"), F.col("total"), F.col("failed") + F.col("review"), F.col("overall")))


def checklist_progress(checklist: DataFrame) -> DataFrame:
    return checklist.groupBy("category").agg(
        F.count("*").alias("items"), F.count_if("done").alias("done"),
        F.bool_and(F.coalesce("done", F.lit(False))).alias("complete"))


def launch_gate(checklist: DataFrame, bugs: DataFrame) -> DataFrame:
    """One row: each gate, the blockers and the launch status.

    "Context Testing" repeats the AI checklist.
    """
    done = F.coalesce("done", F.lit(False))

    def complete(category: str) -> Column:
        mine = F.col("category") == category
        return (F.count_if(mine) > 0) & (F.count_if(mine & ~done) == 0)

    names = {"AI": "ai_ok", "Product": "product_ok", "Safety": "safety_ok", "Privacy": "privacy_ok",
             "Engineering": "engineering_ok", "User Experience": "ux_ok"}
    row = checklist.agg(*[complete(c).alias(names[c]) for c in GATE_CATEGORIES])
    row = row.select("*", F.col("ai_ok").alias("context_ok"),
                     bug_counts(bugs).select("critical_bugs").scalar().alias("critical_bugs"))
    critical = F.col("critical_bugs")
    blockers = F.array_compact(F.array(
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" unresolved CRITICAL bug(s)"))),
        F.when(~F.col("safety_ok"), "Safety checklist incomplete"),
        F.when(~F.col("privacy_ok"), "Privacy checklist incomplete")))
    row = row.withColumn("blockers", blockers).withColumn("can_launch", F.size("blockers") == 0)
    everything = F.col("can_launch") & F.col("ai_ok") & F.col("product_ok") & F.col("ux_ok") & F.col("engineering_ok")
    return row.withColumn("status", F.when(everything, "READY FOR PILOT").when(F.col("can_launch"), "MVP READY")
                          .otherwise("NOT READY"))


def readiness_report(readiness_row: DataFrame, gate_row: DataFrame, product: str, version: str,
                     generated: Column) -> DataFrame:
    """The one-row text report."""
    text = lambda name: F.col(name).cast("string")
    gate = gate_row.select(F.struct("status", "blockers").alias("gate"))
    joined = readiness_row.withColumn("gate", gate.scalar())
    blocked = F.when(F.size("gate.blockers") > 0, F.concat(F.lit("Blockers: "), F.array_join("gate.blockers", "; "))) \
        .otherwise("No blockers.")
    lines = F.concat_ws(
        "\n",
        F.lit(f"{product} MVP Readiness Report — v{version}"),
        F.concat(F.lit("Generated "), F.date_format(generated, "yyyy-MM-dd HH:mm:ss")), F.lit(""),
        F.concat(F.lit("Overall readiness: "), text("overall"), F.lit("% — "), F.col("status")),
        F.concat(F.lit("Tests: "), text("completed"), F.lit("/"), text("total"), F.lit(" run · "), text("passed"),
                 F.lit(" pass · "), text("failed"), F.lit(" fail · "), text("review"), F.lit(" review")),
        F.concat(F.lit("Open bugs: "), text("open_bugs"), F.lit(" ("), text("critical_bugs"), F.lit(" critical)")),
        F.lit(""), F.concat(F.lit("Launch gate: "), F.col("gate.status")), blocked)
    return joined.select(lines.alias("report"))


def search_bugs(bugs: DataFrame, status: str = "ALL", severity: str = "ALL", text: str = "") -> DataFrame:
    kept = bugs
    if status != "ALL":
        kept = kept.where(F.col("status") == status)
    if severity != "ALL":
        kept = kept.where(F.col("severity") == severity)
    return kept.where(F.contains(F.lower("title"), F.lit(text.lower()))) if text else kept


def issue_state(patches: DataFrame, fields: Sequence[str] = BUG_FIELDS, key: str = "bug_id") -> DataFrame:
    """Current issue from its patch log: the last value of each allowed field, first FIXED time kept."""
    present = [f for f in fields if f in patches.columns]
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in present]
    return patches.groupBy(key).agg(
        *last, F.min("ts").alias("opened_at"), F.min(F.when(F.col("status") == "FIXED", F.col("ts"))).alias("fixed_at"))


def overview_lists(results: DataFrame, failures: int = 5, recent: int = 8) -> DataFrame:
    """First safety failures and most recent results, tagged by list."""
    fields = ["test_id", "result", "failure_kind", "run_at"]
    wrong = results.where((F.col("result") == "FAIL") & F.col("failure_kind").isin("FALSE POSITIVE", "FALSE NEGATIVE"))
    first = wrong.orderBy("test_id").limit(failures).select(F.lit("failures").alias("list"), *fields)
    newest = results.where(F.col("run_at").isNotNull()).orderBy(F.desc("run_at"), "test_id").limit(recent).select(
        F.lit("recent").alias("list"), *fields)
    return first.unionByName(newest)


def evaluate_cases(cases: DataFrame, scanned: DataFrame, key: str = "case_id") -> DataFrame:
    """Whether each case's level lies in its allowed range."""
    return cases.join(scanned.select(key, "level"), key).withColumn(
        "ok", F.col("level").between(F.col("min_level"), F.col("max_level")))


def corpus_recall(scanned: DataFrame, sample: int = 5) -> DataFrame:
    """Detected share per pack and the first few misses."""
    missed = scanned.where(F.col("level") == 0)
    few = top_per_key(missed, ["pack"], [F.col("text")], sample, spread=["text"]).groupBy("pack").agg(
        F.array_sort(F.collect_list("text")).alias("misses"))
    totals = scanned.groupBy("pack").agg(F.count("*").alias("total"), F.count_if(F.col("level") > 0).alias("detected"))
    return totals.join(few, "pack", "left").withColumn(
        "misses", F.coalesce("misses", F.array().cast("array<string>")))


def underrating(judged: DataFrame) -> DataFrame:
    """One row: high or crisis messages rated too low, fail-safed messages, and the verdict on the run."""
    low = F.col("expected").isin("high", "crisis") & (severity_rank("actual") < severity_rank("expected"))
    row = judged.agg(F.count("*").alias("messages"), F.count_if(low).alias("underrated"),
                     F.count_if(F.col("source") == "fail_safe").alias("fail_safed"))
    verdict = (F.when(F.col("underrated") > 0, "underrated")
               .when(F.col("fail_safed") == F.col("messages"), "inconclusive").otherwise("ok"))
    return row.withColumn("verdict", verdict)
