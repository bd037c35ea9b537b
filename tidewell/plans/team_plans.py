"""Hiring and team state over mutation logs derived from `orders`, `customer`, `supplier` and `nation`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import team as ops
from tidewell.plans.inputs import table
from tidewell.plans.registry import query


def _view(spark, sf, name):
    table(spark, sf, name).createOrReplaceTempView(f"_team_{name}")


def _log(spark, sf, sql):
    _view(spark, sf, "orders")
    return spark.sql(sql + "_team_orders")


# The first order of a customer applies, later ones move the stage; ties in time go by order key.
_APPLICANTS = """SELECT o_custkey AS applicant_id, CASE WHEN o_orderkey % 4 = 0 THEN 'apply' ELSE 'stage' END AS op, concat('n', o_custkey) AS name,
  concat('n', o_custkey, '@x.org') AS email, concat('role ', o_custkey % 9) AS role,
  CASE o_orderstatus WHEN 'F' THEN 'Interview' WHEN 'O' THEN 'Offer' ELSE 'Hired' END AS stage, o_orderdate AS ts, o_orderkey AS seq FROM """
_STAGES = f"""log AS ({_APPLICANTS} orders), a AS (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY ts, seq) AS rn FROM log WHERE op = 'apply'),
  st AS (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY ts DESC, seq DESC) AS rn FROM log WHERE op = 'stage'),
  stages AS (SELECT a.applicant_id, a.name, a.email, a.role, epoch_us(a.ts) AS applied_at, coalesce(s.stage, 'Applied') AS stage
  FROM a LEFT JOIN st s ON a.applicant_id = s.applicant_id AND s.rn = 1 WHERE a.rn = 1)"""


def stages(spark, sf):
    return ops.applicant_stages(_log(spark, sf, _APPLICANTS))


@query("applicant_stages", f"WITH {_STAGES} SELECT * FROM stages")
def applicant_stages(spark, sf):
    return stages(spark, sf).withColumn("applied_at", F.unix_micros("applied_at"))


def positions(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS position_id", "concat('role ', s_suppkey % 12 + 3) AS title", "concat('dept ', s_nationkey % 4) AS dept")


_POSITIONS = """positions AS (SELECT s_suppkey AS position_id, 'role ' || (s_suppkey % 12 + 3) AS title, 'dept ' || (s_nationkey % 4) AS dept FROM supplier)"""
_HIRED = f"""{_STAGES}, {_POSITIONS}, first AS (SELECT title, arg_min(dept, position_id) AS dept, min(position_id) AS position_id FROM positions GROUP BY title),
  hired AS (SELECT 'hired-' || s.applicant_id AS member_id, s.name, s.role, coalesce(f.dept, 'Engineering') AS dept, s.email AS contact, f.position_id AS filled_position
  FROM stages s LEFT JOIN first f ON s.role = f.title WHERE s.stage = 'Hired')"""


def hired(spark, sf):
    return ops.hire_members(stages(spark, sf).where("stage = 'Hired'"), positions(spark, sf))


@query("hire_members", f"WITH {_HIRED} SELECT * FROM hired")
def hire_members(spark, sf):
    return hired(spark, sf)


_POSITION_LOG = """SELECT o_custkey AS position_id, CASE WHEN o_orderkey % 5 = 0 THEN 'upsert' WHEN o_orderkey % 31 = 0 THEN 'fill' WHEN o_orderkey % 97 = 0 THEN 'delete'
  ELSE 'toggle' END AS op, CASE WHEN o_orderkey % 2 = 0 THEN concat('t', o_orderkey) END AS title, concat('d', o_orderkey % 6) AS dept, o_orderdate AS ts, o_orderkey AS seq FROM """


@query("position_state", f"""WITH log AS ({_POSITION_LOG} orders), f AS (SELECT position_id, max(ROW(ts, seq)) AS at FROM log WHERE op = 'fill' GROUP BY 1),
  g AS (SELECT l.position_id, arg_max(title, ROW(ts, seq)) FILTER (op = 'upsert' AND title IS NOT NULL) AS title, arg_max(dept, ROW(ts, seq)) FILTER (op = 'upsert') AS dept,
  coalesce(count(*) FILTER (op = 'toggle' AND (f.at IS NULL OR ROW(l.ts, l.seq) > f.at)), 0) % 2 = 1 AS odd, bool_or(f.at IS NOT NULL) AS was_filled,
  bool_or(op = 'delete') AS gone, bool_or(op = 'upsert') AS known FROM log l LEFT JOIN f USING (position_id) GROUP BY l.position_id)
  SELECT position_id, title, dept, CASE WHEN was_filled = odd THEN 'open' ELSE 'filled' END AS status FROM g WHERE NOT gone AND known""")
def position_state(spark, sf):
    return ops.position_state(_log(spark, sf, _POSITION_LOG))


_MEMBER_LOG = """SELECT o_custkey AS member_id, CASE WHEN o_orderkey % 61 = 0 THEN 'delete' ELSE 'save' END AS op, CASE WHEN o_orderkey % 3 = 0 THEN concat('m', o_orderkey) END AS name,
  CASE WHEN o_orderkey % 3 != 1 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'Founder & CEO' ELSE concat('role ', o_orderkey % 9) END END AS role,
  concat('dept ', o_orderkey % 6) AS dept, CASE WHEN o_orderkey % 2 = 0 THEN concat(' C', o_custkey % 700, '@X.org ') END AS contact, o_orderdate AS ts, o_orderkey AS seq FROM """
_ROSTER = f"""log AS ({_MEMBER_LOG} orders), roster AS (SELECT * EXCLUDE (gone, saved) FROM (SELECT member_id,
  arg_max(name, ROW(ts, seq)) FILTER (op = 'save' AND name IS NOT NULL) AS name, arg_max(role, ROW(ts, seq)) FILTER (op = 'save' AND role IS NOT NULL) AS role,
  arg_max(dept, ROW(ts, seq)) FILTER (op = 'save') AS dept, arg_max(contact, ROW(ts, seq)) FILTER (op = 'save' AND contact IS NOT NULL) AS contact,
  bool_or(op = 'delete') AS gone, bool_or(op = 'save') AS saved FROM log GROUP BY member_id) WHERE NOT gone AND saved)"""


def roster_rows(spark, sf):
    return ops.roster(_log(spark, sf, _MEMBER_LOG))


@query("roster", f"WITH {_ROSTER} SELECT * FROM roster")
def roster(spark, sf):
    return roster_rows(spark, sf)


@query("link_accounts", f"""WITH {_ROSTER}, first AS (SELECT lower(trim(contact)) AS email, min(member_id) AS member_id, arg_min(role, member_id) AS role FROM roster
  WHERE contact IS NOT NULL GROUP BY 1) SELECT c_custkey AS account_id, c_name AS name, 'c' || c_custkey || '@x.org' AS email, f.member_id,
  coalesce(starts_with(lower(f.role), 'founder'), false) AS is_founder FROM customer c LEFT JOIN first f ON f.email = 'c' || c_custkey || '@x.org'""")
def link_accounts(spark, sf):
    accounts = table(spark, sf, "customer").selectExpr("c_custkey AS account_id", "c_name AS name", "concat('c', c_custkey, '@x.org') AS email")
    return ops.link_accounts(accounts, roster_rows(spark, sf))


_TASK_LOG = """SELECT {member} AS member_id, {task} AS task_id, CASE WHEN l_linenumber % 7 = 1 THEN 'add' WHEN l_partkey % 53 = 0 THEN 'delete' ELSE 'toggle' END AS op FROM """.format(
    member="l_suppkey", task="l_orderkey % 500")


@query("task_state", f"""WITH log AS ({_TASK_LOG} lineitem), t AS (SELECT member_id, task_id, coalesce(count_if(op = 'toggle'), 0) % 2 = 1 AS done, bool_or(op = 'add') AS added,
  bool_or(op = 'delete') AS gone FROM log GROUP BY ALL) SELECT member_id, task_id, done FROM t WHERE added AND NOT gone
  AND member_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)""")
def task_state(spark, sf):
    _view(spark, sf, "lineitem")
    removed = table(spark, sf, "supplier").where("s_acctbal < 1000").selectExpr("s_suppkey AS member_id")
    return ops.task_state(spark.sql(_TASK_LOG + "_team_lineitem"), removed)


_KINDS = "'" + "', '".join(ops.NOTE_TEXT) + "'"


def _note_sql():
    cases = []
    for kind, template in ops.NOTE_TEXT.items():
        parts = [p.replace("'", "''") for p in template.split("%s")]
        text = f"'{parts[0]}'"
        for value, tail in zip(("coalesce(subject, '?')", "coalesce(detail, '?')"), parts[1:]):
            text += f" || {value} || '{tail}'"
        cases.append(f"WHEN '{kind}' THEN {text}")
    return "CASE kind " + " ".join(cases) + " END"


@query("notes_feed", f"""WITH m AS (SELECT o_orderkey AS seq, o_orderdate AS ts, ([{_KINDS}])[1 + o_orderkey % {len(ops.NOTE_TEXT)}] AS kind,
  CASE WHEN o_orderkey % 10 != 0 THEN 'n' || o_custkey END AS subject, o_orderpriority AS detail FROM orders)
  SELECT seq, epoch_us(ts) AS at, {_note_sql()} AS note, ts <= TIMESTAMP '1998-01-01' AS read FROM m""")
def notes_feed(spark, sf):
    mutations = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "o_orderdate AS ts", f"element_at(array({_KINDS}), CAST(o_orderkey % {len(ops.NOTE_TEXT)} AS INT) + 1) AS kind",
        "CASE WHEN o_orderkey % 10 != 0 THEN concat('n', o_custkey) END AS subject", "o_orderpriority AS detail")
    feed = ops.notes_feed(mutations, F.lit("1998-01-01").cast("timestamp"))
    return feed.select("seq", F.unix_micros("ts").alias("at"), "note", "read")


_PLAN_LOG = """SELECT concat('dept ', o_orderkey % 6) AS dept, CAST(o_custkey % 90 - 10 AS INT) AS target, o_orderdate AS ts, o_orderkey AS seq FROM """
_PLAN = f"plog AS ({_PLAN_LOG} orders), plan AS (SELECT dept, greatest(0, least(50, arg_max(target, ROW(ts, seq)))) AS target FROM plog GROUP BY dept)"


def plan(spark, sf):
    return ops.department_plan(_log(spark, sf, _PLAN_LOG))


@query("department_plan", f"WITH {_PLAN} SELECT * FROM plan")
def department_plan(spark, sf):
    return plan(spark, sf)


@query("headcount_gap", f"""WITH {_ROSTER}, {_PLAN}, n AS (SELECT dept, count(*) AS filled FROM roster GROUP BY dept)
  SELECT dept, target, coalesce(filled, 0) AS filled, greatest(target - coalesce(filled, 0), 0) AS open FROM plan LEFT JOIN n USING (dept)""")
def headcount_gap(spark, sf):
    return ops.headcount_gap(plan(spark, sf), roster_rows(spark, sf))
