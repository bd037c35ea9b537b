"""Evaluation over tests and runs derived from `labels`, `events`, `lineitem` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.text import normalize_text
from tidewell.operators import evaluation as ops
from tidewell.operators.fusion import fail_safe, parse_verdicts
from tidewell.operators.scan import laugh_spans, scan_messages
from tidewell.plans.fusion_plans import _PARSED, _SAFE, verdicts
from tidewell.plans.inputs import SENTENCES, messages, table
from tidewell.plans.registry import query
from tidewell.plans.text_plans import SAID, SCANNED, matchers

_SUITE_LIST = "'" + "', '".join(ops.SUITES) + "'"
_LEVELS = "'none', 'low', 'moderate', 'high', 'crisis'"


def _pick(items, index, duck):
    return f"([{items}])[1 + {index}]" if duck else f"element_at(array({items}), CAST({index} AS INT) + 1)"


def _tests_sql(duck):
    return (f"SELECT c_custkey AS test_id, {_pick(_SUITE_LIST, 'c_custkey % 11', duck)} AS category, "
            f"CASE WHEN c_custkey % 37 = 0 THEN 'odd' ELSE {_pick(_LEVELS, 'c_nationkey % 5', duck)} END AS expected_severity FROM ")


def _runs_sql(duck):
    return (f"SELECT event_id AS run_id, (event_id * 7) % 1600 AS test_id, {_pick(_LEVELS, '(event_id * 3 + user_id) % 5', duck)} AS actual_severity, "
            "CASE WHEN event_id % 41 = 0 THEN true END AS error, ts AS run_at FROM ")


def tests(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("_eval_customer")
    return spark.sql(_tests_sql(False) + "_eval_customer")


def runs(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("_eval_events")
    return spark.sql(_runs_sql(False) + "_eval_events")


_RANK = "CASE {c} WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 WHEN 'crisis' THEN 4 ELSE -1 END"
_E, _A = _RANK.format(c="expected_severity"), _RANK.format(c="actual_severity")
_LATEST = f"""tests AS ({_tests_sql(True)} customer), runs AS ({_runs_sql(True)} events),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY run_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1)"""
_SCORED = _LATEST + f""", scored0 AS (SELECT t.*, l.actual_severity, l.error, l.run_at, CASE WHEN l.test_id IS NULL THEN 'REVIEW'
  WHEN abs({_E} - {_A}) >= 2 THEN 'FAIL' WHEN abs({_E} - {_A}) = 1 THEN 'REVIEW' ELSE 'PASS' END AS result, l.test_id IS NOT NULL AS has
  FROM tests t LEFT JOIN latest l USING (test_id)),
  scored AS (SELECT *, CASE WHEN result = 'PASS' THEN NULL WHEN NOT has OR coalesce(error, false) THEN 'SYSTEM ERROR' WHEN result = 'REVIEW' THEN 'AMBIGUOUS'
  WHEN {_A} > {_E} THEN 'FALSE POSITIVE' WHEN {_A} < {_E} THEN 'FALSE NEGATIVE' ELSE 'AMBIGUOUS' END AS failure_kind FROM scored0)"""


def scored(spark, sf):
    return ops.score_results(tests(spark, sf), ops.latest_results(runs(spark, sf)))


@query("latest_results", f"WITH {_LATEST} SELECT test_id, run_id, actual_severity, error FROM latest")
def latest_results(spark, sf):
    return ops.latest_results(runs(spark, sf)).select("test_id", "run_id", "actual_severity", "error")


@query("score_results", f"WITH {_SCORED} SELECT test_id, category, expected_severity, actual_severity, result FROM scored")
def score_results(spark, sf):
    return scored(spark, sf).select("test_id", "category", "expected_severity", "actual_severity", "result")


@query("failure_kinds", f"WITH {_SCORED} SELECT result, failure_kind, count(*) AS tests FROM scored GROUP BY ALL")
def failure_kinds(spark, sf):
    return scored(spark, sf).groupBy("result", "failure_kind").agg(F.count("*").alias("tests"))


def _sides_sql(duck):
    return (f"SELECT o_orderkey // 2 AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, o_orderpriority || ' ' || o_orderstatus AS input, "
            f"{_pick(_LEVELS, 'o_custkey % 5', duck)} AS expected_severity, CASE WHEN o_orderkey % 13 != 0 THEN {_pick(_LEVELS, 'o_orderkey % 5', duck)} END AS actual_severity, "
            "o_orderkey AS run_at FROM ").replace("o_orderkey // 2", "o_orderkey // 2" if duck else "o_orderkey div 2")


_SIDE = f"""CASE WHEN actual_severity IS NULL THEN 'REVIEW' WHEN abs({_E} - {_A}) >= 2 THEN 'FAIL' WHEN abs({_E} - {_A}) = 1 THEN 'REVIEW' ELSE 'PASS' END"""


@query("context_pairs", f"""WITH s AS ({_sides_sql(True)} orders), r AS (SELECT *, {_SIDE} AS result,
  list_filter(list_distinct(string_split_regex(lower(trim(input)), '[^\\p{{L}}'']+')), lambda w: w != '') AS words FROM s)
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, a.expected_severity AS a_expected, b.expected_severity AS b_expected, a.result AS a_result, b.result AS b_result,
  CASE WHEN a.words IS NOT NULL AND b.words IS NOT NULL THEN len(list_intersect(a.words, b.words)) END AS shared_words, a.result = 'PASS' AND b.result = 'PASS' AS told_apart
  FROM (SELECT * FROM r WHERE side = 'a') a FULL JOIN (SELECT * FROM r WHERE side = 'b') b ON a.pair_id = b.pair_id""")
def context_pairs(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_eval_orders")
    return ops.context_pairs(spark.sql(_sides_sql(False) + "_eval_orders"))


_RUNS = """SELECT concat('s', l_suppkey % 11) AS suite, l_orderkey AS run_id, concat('tester ', l_orderkey % 3) AS tester, '0.9' AS version,
  CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'FAIL' ELSE 'REVIEW' END AS result, l_orderkey AS run_at FROM """


@query("suite_runs", f"""WITH r AS ({_RUNS} lineitem) SELECT suite, run_id, tester, version, count(*) AS count, count_if(result = 'PASS') AS passed,
  count_if(result = 'FAIL') AS failed, count_if(result = 'REVIEW') AS review, max(run_at) AS run_at,
  CAST(round_even(100e0 * count_if(result = 'PASS') / count(*), 0) AS BIGINT) AS accuracy FROM r GROUP BY suite, run_id, tester, version
  ORDER BY run_at DESC, run_id DESC, suite DESC LIMIT 200""")
def suite_runs(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("_eval_lineitem")
    return ops.suite_runs(spark.sql(_RUNS + "_eval_lineitem"))


# Tests without a run have no result here.
_RUN_TESTS = _SCORED + ", run_tests AS (SELECT test_id, category, CASE WHEN has AND category != 'sarcasm' THEN result END AS result FROM scored)"


def run_tests(spark, sf):
    ran = F.col("run_id").isNotNull() & (F.col("category") != "sarcasm")
    return scored(spark, sf).select("test_id", "category", F.when(ran, F.col("result")).alias("result"))


@query("suite_cards", f"""WITH {_RUN_TESTS} SELECT category AS suite, count(*) AS tests, count(result) AS run, coalesce(count_if(result = 'PASS'), 0) AS passed,
  coalesce(count_if(result = 'FAIL'), 0) AS failed, coalesce(count_if(result = 'REVIEW'), 0) AS review,
  CASE WHEN count(result) > 0 THEN CAST(round_even(100e0 * count_if(result = 'PASS') / count(result), 0) AS BIGINT) END AS accuracy
  FROM run_tests GROUP BY category""")
def suite_cards(spark, sf):
    return ops.suite_cards(run_tests(spark, sf))


_NAMED = "CASE " + " ".join(
    f"WHEN category IN ({', '.join(repr(s) for s in suites)}) THEN '{name}'" for name, suites in ops.CATEGORY_SUITES.items()) + " END"
_SCORES = f"""scores AS (SELECT {_NAMED} AS name, CAST(round_even(100e0 * count_if(result = 'PASS') / count(*), 0) AS BIGINT) AS score
  FROM run_tests WHERE result IS NOT NULL AND {_NAMED} IS NOT NULL GROUP BY 1)"""


@query("category_scores", f"WITH {_RUN_TESTS}, {_SCORES} SELECT name, score FROM scores")
def category_scores(spark, sf):
    return ops.category_scores(run_tests(spark, sf))


def resource_tests(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'FAIL' ELSE 'REVIEW' END AS result")


def privacy_checks(spark, sf):
    return table(spark, sf, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'NOT TESTED' END AS status")


_RATES = """rates AS (SELECT 'Resources' AS name, CAST(round_even(100e0 * count_if(l_returnflag = 'A') / count(*), 0) AS BIGINT) AS score FROM lineitem
  UNION ALL SELECT 'Privacy', CAST(round_even(100e0 * count_if(o_orderstatus = 'F') / count(*), 0) AS BIGINT) FROM orders WHERE o_orderstatus IN ('F', 'O'))"""


@query("pass_rates", f"WITH {_RATES} SELECT * FROM rates")
def pass_rates(spark, sf):
    return ops.pass_rates(resource_tests(spark, sf), privacy_checks(spark, sf))


def bugs(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS bug_id", "c_name AS title",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'FIXED' WHEN c_nationkey % 3 = 1 THEN 'OPEN' ELSE 'CLOSED' END AS status",
        "CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 20000 THEN 'CRITICAL' WHEN c_acctbal > 5000 THEN 'HIGH' ELSE 'LOW' END AS severity")


_BUGS = """bugs AS (SELECT c_custkey AS bug_id, c_name AS title,
  CASE WHEN c_nationkey % 3 = 0 THEN 'FIXED' WHEN c_nationkey % 3 = 1 THEN 'OPEN' ELSE 'CLOSED' END AS status,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 20000 THEN 'CRITICAL' WHEN c_acctbal > 5000 THEN 'HIGH' ELSE 'LOW' END AS severity FROM customer)"""
_COUNTS = """counts AS (SELECT count_if(status NOT IN ('FIXED', 'CLOSED')) AS open_bugs,
  count_if(status NOT IN ('FIXED', 'CLOSED') AND severity = 'CRITICAL') AS critical_bugs FROM bugs)"""


@query("bug_counts", f"WITH {_BUGS}, {_COUNTS} SELECT * FROM counts")
def bug_counts(spark, sf):
    return ops.bug_counts(bugs(spark, sf))


_READY = f"""{_RUN_TESTS}, {_SCORES}, {_RATES}, {_BUGS}, {_COUNTS}, overall AS (SELECT coalesce(CAST(round_even(avg(score), 0) AS BIGINT), 0) AS overall
  FROM (SELECT * FROM scores UNION ALL SELECT * FROM rates)),
  n AS (SELECT count(*) AS total, count(result) AS completed, count_if(result = 'PASS') AS passed, count_if(result = 'FAIL') AS failed,
  count_if(result = 'REVIEW') AS review FROM run_tests),
  ready AS (SELECT n.*, o.overall, c.open_bugs, c.critical_bugs, CASE WHEN c.critical_bugs > 0 OR completed = 0 THEN 'NOT READY' WHEN completed < total THEN 'TESTING'
  WHEN failed + review > 0 THEN 'NEEDS REVIEW' WHEN o.overall >= 90 THEN 'READY FOR PILOT' ELSE 'MVP READY' END AS status FROM n, overall o, counts c)"""


def ready(spark, sf):
    return ops.readiness(run_tests(spark, sf), resource_tests(spark, sf), privacy_checks(spark, sf), bugs(spark, sf))


@query("readiness", f"WITH {_READY} SELECT total, completed, passed, failed, review, overall, open_bugs, critical_bugs FROM ready")
def readiness(spark, sf):
    return ready(spark, sf).drop("status")


@query("readiness_status", f"""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey % 7 = 0 OR l_partkey % 9 = 0 THEN 'NOT READY'
  WHEN l_partkey % 9 < 5 THEN 'TESTING' WHEN l_linenumber % 3 > 0 THEN 'NEEDS REVIEW' WHEN l_quantity * 2 >= 90 THEN 'READY FOR PILOT' ELSE 'MVP READY' END AS status FROM lineitem""")
def readiness_status(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), ops.readiness_status(
            F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0), F.col("l_partkey") % 9, F.lit(5),
            F.col("l_linenumber") % 3, F.col("l_quantity") * 2).alias("status"))


_CHECK = """SELECT CASE p_size % 7 WHEN 0 THEN 'Product' WHEN 1 THEN 'AI' WHEN 2 THEN 'Safety' WHEN 3 THEN 'Privacy' WHEN 4 THEN 'Engineering'
  WHEN 5 THEN 'User Experience' ELSE 'Pilot' END AS category, p_name AS item, CASE WHEN p_size % 7 = 2 THEN true ELSE p_partkey % 50 != 0 END AS done FROM """


def checklist(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("_eval_part")
    return spark.sql(_CHECK + "_eval_part")


_GATE = f"""checklist AS ({_CHECK} part), {_BUGS.replace('20000', '9000')}, {_COUNTS}, c AS (SELECT
  bool_and(done) FILTER (category = 'AI') AS ai_ok, bool_and(done) FILTER (category = 'Product') AS product_ok, bool_and(done) FILTER (category = 'Safety') AS safety_ok,
  bool_and(done) FILTER (category = 'Privacy') AS privacy_ok, bool_and(done) FILTER (category = 'Engineering') AS engineering_ok,
  bool_and(done) FILTER (category = 'User Experience') AS ux_ok FROM checklist),
  gate AS (SELECT c.*, ai_ok AS context_ok, critical_bugs, concat_ws('; ', CASE WHEN critical_bugs > 0 THEN critical_bugs || ' unresolved CRITICAL bug(s)' END,
  CASE WHEN NOT safety_ok THEN 'Safety checklist incomplete' END, CASE WHEN NOT privacy_ok THEN 'Privacy checklist incomplete' END) AS blockers FROM c, counts),
  final AS (SELECT *, blockers = '' AS can_launch, CASE WHEN blockers != '' THEN 'NOT READY' WHEN ai_ok AND product_ok AND ux_ok AND engineering_ok
  THEN 'READY FOR PILOT' ELSE 'MVP READY' END AS status FROM gate)"""


def strict_bugs(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_nationkey % 3 = 0 THEN 'FIXED' WHEN c_nationkey % 3 = 1 THEN 'OPEN' ELSE 'CLOSED' END AS status",
        "CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 'CRITICAL' WHEN c_acctbal > 5000 THEN 'HIGH' ELSE 'LOW' END AS severity")


@query("launch_gate", f"WITH {_GATE} SELECT * FROM final")
def launch_gate(spark, sf):
    return ops.launch_gate(checklist(spark, sf), strict_bugs(spark, sf)).withColumn("blockers", F.array_join("blockers", "; "))


@query("checklist_progress", f"WITH checklist AS ({_CHECK} part) SELECT category, count(*) AS items, count_if(done) AS done, bool_and(done) AS complete FROM checklist GROUP BY category")
def checklist_progress(spark, sf):
    return ops.checklist_progress(checklist(spark, sf))


@query("readiness_report", f"""WITH {_READY}, {_GATE.replace('bugs AS', 'bugs2 AS').replace('FROM bugs)', 'FROM bugs2)').replace('counts AS', 'counts2 AS').replace('FROM c, counts)', 'FROM c, counts2)')}
  SELECT 'Tidewell MVP Readiness Report — v0.9.4' || chr(10) || 'Generated 2024-01-31 00:00:00' || chr(10) || chr(10) || 'Overall readiness: ' || r.overall || '% — ' || r.status || chr(10) ||
  'Tests: ' || completed || '/' || total || ' run · ' || passed || ' pass · ' || failed || ' fail · ' || review || ' review' || chr(10) ||
  'Open bugs: ' || open_bugs || ' (' || r.critical_bugs || ' critical)' || chr(10) || chr(10) || 'Launch gate: ' || f.status || chr(10) ||
  CASE WHEN f.blockers != '' THEN 'Blockers: ' || f.blockers ELSE 'No blockers.' END AS report FROM ready r, final f""")
def readiness_report(spark, sf):
    gate = ops.launch_gate(checklist(spark, sf), strict_bugs(spark, sf))
    return ops.readiness_report(ready(spark, sf), gate, "Tidewell", "0.9.4", F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("search_bugs", f"WITH {_BUGS} SELECT bug_id, title FROM bugs WHERE status = 'OPEN' AND severity = 'HIGH' AND contains(lower(title), '#00000')")
def search_bugs(spark, sf):
    return ops.search_bugs(bugs(spark, sf), "OPEN", "HIGH", "#00000").select("bug_id", "title")


_PATCH = """SELECT o_custkey AS bug_id, o_orderkey AS seq, o_orderdate AS ts, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS severity,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'FIXED' WHEN 'O' THEN 'OPEN' ELSE 'VERIFYING' END END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('title ', o_orderkey) END AS title, 'x' AS secret FROM """


@query("issue_state", f"""WITH p AS ({_PATCH} orders) SELECT bug_id, arg_max(severity, seq) FILTER (severity IS NOT NULL) AS severity,
  arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(title, seq) FILTER (title IS NOT NULL) AS title,
  epoch_us(min(ts)) AS opened_at, epoch_us(min(ts) FILTER (status = 'FIXED')) AS fixed_at FROM p GROUP BY bug_id""")
def issue_state(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_eval_orders")
    return ops.issue_state(spark.sql(_PATCH + "_eval_orders")).withColumns({
        "opened_at": F.unix_micros("opened_at"), "fixed_at": F.unix_micros("fixed_at")})


@query("overview_lists", f"""WITH {_SCORED} SELECT * FROM (SELECT 'failures' AS list, test_id, result, failure_kind FROM scored
  WHERE result = 'FAIL' AND failure_kind IN ('FALSE POSITIVE', 'FALSE NEGATIVE') ORDER BY test_id LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'recent', test_id, result, failure_kind FROM scored WHERE run_at IS NOT NULL ORDER BY run_at DESC, test_id LIMIT 8)""")
def overview_lists(spark, sf):
    return ops.overview_lists(scored(spark, sf)).drop("run_at")


RANGES = (0, 0, 0, 0, 4, 1, 2, 2, 3, 0, 1, 3, 0, 0, 0, 2, 4, 4, 4, 4, 0, 1, 3, 3, 0)
_RANGES = ", ".join("('" + s.replace("'", "''") + f"', {r}, {str(SAID.get(s, ('',))[0] == 'fuzzy').lower()})" for s, r in zip(SENTENCES, RANGES))


@query("evaluate_cases", f"""WITH {SCANNED}, ranges(sentence, lvl, bare) AS (VALUES {_RANGES})
  SELECT msg_id AS case_id, CASE WHEN bare AND joking THEN 0 ELSE r.lvl END AS min_level, r.lvl AS max_level, level, true AS ok FROM scanned JOIN ranges r USING (sentence)""")
def evaluate_cases(spark, sf):
    """Every message against the range expected of the sentence it ends in; a bare word may be taken for a joke where the text laughs."""
    expected = F.create_map(*[x for s, r in zip(SENTENCES, RANGES) for x in (F.lit(s), F.lit(r))])
    sent = messages(spark, sf).withColumnRenamed("msg_id", "case_id")
    bare = F.col("sentence").isin([s for s, said in SAID.items() if said[0] == "fuzzy"])
    laughs = F.size(laugh_spans(normalize_text("text"))) > 0
    cases = sent.select("case_id", F.when(bare & laughs, 0).otherwise(expected[F.col("sentence")]).alias("min_level"), expected[F.col("sentence")].alias("max_level"))
    return ops.evaluate_cases(cases, scan_messages(sent.drop("sentence"), matchers(spark)))


@query("corpus_recall", f"""WITH {SCANNED} SELECT CAST(user_id % 7 AS VARCHAR) AS pack, count(*) AS total, count_if(level > 0) AS detected,
  array_to_string((list_sort(list(CAST(msg_id AS VARCHAR)) FILTER (level = 0)))[1:5], ',') AS misses FROM scanned GROUP BY ALL""")
def corpus_recall(spark, sf):
    """Packs of messages, scanned; a miss is named by its number."""
    found = scan_messages(messages(spark, sf).drop("sentence"), matchers(spark))
    packs = found.select((F.col("user_id") % 7).cast("string").alias("pack"), F.col("msg_id").cast("string").alias("text"), "level")
    return ops.corpus_recall(packs).withColumn("misses", F.array_join("misses", ","))


@query("underrating", f"""WITH {_PARSED}, {_SAFE}, e AS (SELECT s.*, CASE WHEN msg_id % 5 = 0 THEN 'crisis' WHEN msg_id % 5 < 3 THEN 'high' ELSE 'low' END AS expected FROM safe s),
  c AS (SELECT count(*) AS messages, count_if(expected IN ('high', 'crisis') AND {_RANK.format(c='risk_level')} < {_RANK.format(c='expected')}) AS underrated,
  count_if(source = 'fail_safe') AS fail_safed FROM e)
  SELECT *, CASE WHEN underrated > 0 THEN 'underrated' WHEN fail_safed = messages THEN 'inconclusive' ELSE 'ok' END AS verdict FROM c""")
def underrating(spark, sf):
    judged = fail_safe(parse_verdicts(verdicts(spark, sf))).select(
        "source", F.col("judgment.risk_level").alias("actual"),
        F.expr("CASE WHEN msg_id % 5 = 0 THEN 'crisis' WHEN msg_id % 5 < 3 THEN 'high' ELSE 'low' END").alias("expected"))
    return ops.underrating(judged)
