"""Identity, access and abuse checks over requests and attempts derived from `orders`, `customer` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import identity as ops
from tidewell.plans.inputs import table
from tidewell.plans.registry import query


def accounts(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat('u', c_custkey) AS uid", "lower(concat(c_name, '@x.org')) AS email", "c_name AS name").where("uid NOT LIKE '%7'")


def issued(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "concat('t', o_orderkey) AS token", "concat('u', o_custkey) AS uid", "o_orderdate AS issued_at")


_ACCOUNTS = """accounts AS (SELECT 'u' || c_custkey AS uid, lower(c_name || '@x.org') AS email FROM customer WHERE 'u' || c_custkey NOT LIKE '%7')"""
_ACTIVE = """active AS (SELECT uid, token, issued_at FROM (SELECT 't' || o_orderkey AS token, 'u' || o_custkey AS uid, o_orderdate AS issued_at,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 't' || o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""
_PATHS = "['/api/me', '/api/state', '/api/hq/notes', '/chat', '/api/qa/run', '/api/export', '/api/monitor']"
_REQUESTS = f"""requests AS (SELECT event_id AS req_id, CASE WHEN event_id % 3 = 0 THEN 'u' || (user_id % 200) END AS session_uid,
  event_id % 10 = 1 AS is_local, CASE WHEN event_id % 2 = 0 THEN 't' || (event_id % 15000) END AS device_token,
  ({_PATHS})[1 + event_id % 7] AS path FROM events)"""
_RESOLVED = f"""{_ACCOUNTS}, {_ACTIVE}, {_REQUESTS}, owner AS (SELECT uid FROM accounts WHERE email = 'customer#000000005@x.org'),
  resolved AS (SELECT r.*, coalesce(a.uid, CASE WHEN r.is_local THEN (SELECT uid FROM owner) END, b.uid) AS resolved_uid
  FROM requests r LEFT JOIN accounts a ON r.session_uid = a.uid LEFT JOIN active t ON r.device_token = t.token
  LEFT JOIN accounts b ON t.uid = b.uid)"""


def requests(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS req_id", "CASE WHEN event_id % 3 = 0 THEN concat('u', user_id % 200) END AS session_uid",
        "event_id % 10 = 1 AS is_local", "CASE WHEN event_id % 2 = 0 THEN concat('t', event_id % 15000) END AS device_token",
        "element_at(array" + _PATHS.replace("[", "(").replace("]", ")") + ", CAST(event_id % 7 AS INT) + 1) AS path")


def resolved(spark, sf):
    owner = ops.infer_owner(accounts(spark, sf), "Customer#000000005@x.org ")
    return ops.resolve_user(requests(spark, sf), accounts(spark, sf), issued(spark, sf), owner)


@query("active_tokens", f"WITH {_ACTIVE} SELECT uid, token, epoch_us(issued_at) AS issued_at FROM active")
def active_tokens(spark, sf):
    return ops.active_tokens(issued(spark, sf)).withColumn("issued_at", F.unix_micros("issued_at"))


@query("infer_owner", f"WITH {_ACCOUNTS} SELECT max(CASE WHEN email = 'customer#000000005@x.org' THEN uid END) AS uid FROM accounts")
def infer_owner(spark, sf):
    return ops.infer_owner(accounts(spark, sf), "Customer#000000005@x.org ")


@query("resolve_user", f"WITH {_RESOLVED} SELECT req_id, resolved_uid FROM resolved")
def resolve_user(spark, sf):
    return resolved(spark, sf).select("req_id", "resolved_uid")


@query("access_denied", f"""WITH {_RESOLVED} SELECT req_id, path FROM resolved WHERE resolved_uid IS NULL AND starts_with(path, '/api/')
  AND NOT starts_with(path, '/api/hq') AND NOT starts_with(path, '/api/qa') AND path NOT IN ('/api/me', '/api/monitor')""")
def access_denied(spark, sf):
    return ops.access_denied(resolved(spark, sf)).select("req_id", "path")


_EMAIL = "CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 9 = 1 THEN 'nobody' ELSE ' User' || o_custkey || '@Mail.org ' END"
_NAME = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' N' || o_orderkey || ' ' END"


@query("valid_signups", f"""WITH s AS (SELECT o_orderkey AS seq, lower(trim({_EMAIL})) AS email, trim({_NAME}) AS name FROM orders
  WHERE 3 + o_orderkey % 8 >= 6), k AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) AS rn FROM s
  WHERE email != '' AND contains(email, '@'))
  SELECT seq, email, CASE WHEN name != '' THEN name ELSE split_part(email, '@', 1) END AS name FROM k WHERE rn = 1""")
def valid_signups(spark, sf):
    attempts = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", f"{_EMAIL} AS email", f"{_NAME} AS name", "3 + o_orderkey % 8 AS password_length")
    return ops.valid_signups(attempts)



@query("rate_flags", """WITH a AS (SELECT c_nationkey % 5 AS ip, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey // 2) AS ts FROM customer),
  g AS (SELECT ip, ts, count(*) AS attempts FROM a GROUP BY ALL),
  w AS (SELECT *, CAST(sum(attempts) OVER (PARTITION BY ip ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM g)
  SELECT ip, epoch_us(ts) AS at, attempts, in_window, in_window > 10 AS limited FROM w""")
def rate_flags(spark, sf):
    attempts = table(spark, sf, "customer").selectExpr(
        "c_nationkey % 5 AS ip", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, c_custkey div 2) AS ts")
    return ops.rate_flags(attempts).withColumn("at", F.unix_micros("ts")).drop("ts")


@query("reset_lockouts", """WITH g AS (SELECT o_custkey % 300 AS code_id, o_orderkey AS seq,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey // 12) AS ts, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((o_custkey % 300) // 3) AS issued_at,
  o_orderkey % 10 = 0 AS correct FROM orders),
  w AS (SELECT *, coalesce(sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER p, 0) AS wrong_before, coalesce(sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER p, 0) AS right_before
  FROM g WINDOW p AS (PARTITION BY code_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT code_id, seq, CAST(wrong_before AS BIGINT) AS wrong_before, CASE WHEN wrong_before >= 8 OR ts >= issued_at + INTERVAL 900 SECOND OR right_before > 0 THEN 'invalid'
  WHEN correct THEN 'accepted' ELSE 'wrong' END AS outcome FROM w""")
def reset_lockouts(spark, sf):
    guesses = table(spark, sf, "orders").selectExpr(
        "o_custkey % 300 AS code_id", "o_orderkey AS seq",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, o_orderkey div 12) AS ts",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, (o_custkey % 300) div 3) AS issued_at",
        "o_orderkey % 10 = 0 AS correct")
    return ops.reset_lockouts(guesses).select("code_id", "seq", "wrong_before", "outcome")
