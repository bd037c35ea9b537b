"""Verdict parsing and fusion over raw model outputs and scan results derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.levels import level_name, severity_rank
from tidewell.operators import fusion as ops
from tidewell.plans.inputs import AS_OF, HISTORY, SETTINGS, as_of, history, settings, table
from tidewell.plans.registry import query

_LEVELS = "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' WHEN 3 THEN 'high' ELSE 'crisis' END"
_JSON = ("'{\"risk_level\": \"' || " + _LEVELS + " || '\", \"categories\": [\"distress\", \"' || event_type || '\"], \"confidence\": ' || "
         "CAST(event_id % 19 AS VARCHAR(10)) || '.5, \"rationale\": \"seen\"}'")
_RAW = f"""CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'no object here' WHEN 3 THEN substr({_JSON}, 1, 40)
  WHEN 4 THEN '```json' || chr(10) || {_JSON} || chr(10) || '```' WHEN 5 THEN 'Sure: ' || {_JSON} || ' done'
  WHEN 6 THEN '{{"risk_level": "severe", "categories": []}}' WHEN 7 THEN '{{"risk_level": "low", "categories": "x", "confidence": "high"}}'
  WHEN 8 THEN '{{"risk_level": "high", "confidence": -1}}' ELSE {_JSON} END"""
_ERROR = "CASE WHEN event_id % 17 = 0 THEN 'timeout' END"


def verdicts(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id AS msg_id", f"{_RAW} AS raw", f"{_ERROR} AS error")


_PARSED = f"""verdicts AS (SELECT event_id AS msg_id, {_RAW} AS raw, {_ERROR} AS error FROM events),
  body AS (SELECT *, regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}') AS obj FROM verdicts),
  js AS (SELECT *, CASE WHEN obj != '' AND json_valid(obj) THEN CAST(obj AS JSON) END AS j FROM body),
  parsed AS (SELECT msg_id, error, CASE WHEN json_extract_string(j, '$.risk_level') IN ('none', 'low', 'moderate', 'high', 'crisis')
    THEN json_extract_string(j, '$.risk_level') END AS risk_level,
    CASE WHEN json_type(j, '$.categories') = 'ARRAY' THEN array_to_string(CAST(json_extract(j, '$.categories') AS VARCHAR[]), ',')
    ELSE 'none' END AS categories,
    greatest(0e0, least(1e0, CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
    THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) ELSE 0e0 END)) AS confidence,
    coalesce(json_extract_string(j, '$.rationale'), '') AS rationale FROM js)"""


@query("parse_verdicts", f"""WITH {_PARSED} SELECT msg_id, risk_level, CASE WHEN risk_level IS NOT NULL THEN categories END AS categories,
  CASE WHEN risk_level IS NOT NULL THEN confidence END AS confidence, CASE WHEN risk_level IS NOT NULL THEN rationale END AS rationale
  FROM parsed""")
def parse_verdicts(spark, sf):
    return ops.parse_verdicts(verdicts(spark, sf)).select(
        "msg_id", "judgment.risk_level", F.when(F.col("judgment").isNotNull(), F.array_join("judgment.categories", ",")).alias("categories"),
        "judgment.confidence", "judgment.rationale")


_SAFE = """safe AS (SELECT msg_id, CASE WHEN risk_level IS NULL OR error IS NOT NULL THEN 'fail_safe' ELSE 'model' END AS source,
  CASE WHEN risk_level IS NULL OR error IS NOT NULL THEN 'high' ELSE risk_level END AS risk_level,
  CASE WHEN risk_level IS NULL OR error IS NOT NULL THEN 'distress' ELSE categories END AS categories,
  CASE WHEN risk_level IS NULL OR error IS NOT NULL THEN 0e0 ELSE confidence END AS confidence FROM parsed)"""


@query("fail_safe", f"WITH {_PARSED}, {_SAFE} SELECT * FROM safe")
def fail_safe(spark, sf):
    return ops.fail_safe(ops.parse_verdicts(verdicts(spark, sf))).select(
        "msg_id", "source", "judgment.risk_level", F.array_join("judgment.categories", ",").alias("categories"), "judgment.confidence")


_COACH = """CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"guidance": "listen"}' WHEN 2 THEN '{"reply": " hi ", "danger": "maybe"}'
  WHEN 3 THEN 'ok {"reply": "hello ' || event_id || '", "guidance": "stay", "danger": "escalate", "escalation_reason": "risk"}'
  WHEN 4 THEN '{"reply": "cut' ELSE '{"reply": "there", "danger": "none"}' END"""


def _said(part):
    return "'" + ops.COACH_FALLBACK[part].replace("'", "''") + "'"


@query("parse_coach", f"""WITH r AS (SELECT event_id AS msg_id, {_COACH} AS raw FROM events),
  b AS (SELECT *, regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}') AS obj FROM r),
  j AS (SELECT *, CASE WHEN obj != '' AND json_valid(obj) THEN CAST(obj AS JSON) END AS j FROM b)
  SELECT msg_id, CASE WHEN json_extract_string(j, '$.reply') IS NULL THEN {_said('reply')}
    ELSE trim(json_extract_string(j, '$.reply')) END AS reply,
  CASE WHEN json_extract_string(j, '$.reply') IS NULL THEN {_said('guidance')}
    ELSE trim(coalesce(json_extract_string(j, '$.guidance'), '')) END AS guidance,
  CASE WHEN json_extract_string(j, '$.reply') IS NOT NULL AND json_extract_string(j, '$.danger') IN ('none', 'watch', 'escalate')
    THEN json_extract_string(j, '$.danger') ELSE 'watch' END AS danger,
  CASE WHEN json_extract_string(j, '$.reply') IS NULL THEN '' ELSE trim(coalesce(json_extract_string(j, '$.escalation_reason'), '')) END AS escalation_reason
  FROM j""")
def parse_coach(spark, sf):
    replies = table(spark, sf, "events").selectExpr("event_id AS msg_id", f"{_COACH} AS raw")
    return ops.parse_coach(replies).select("msg_id", "coach.*")


_ODD = "CASE WHEN event_id % 6 = 5 THEN 'strange' ELSE " + _LEVELS + " END"


def _odd(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "user_id", "event_type", f"{_ODD} AS level")


@query("decide_response", f"""SELECT event_id, CASE level WHEN 'crisis' THEN 'crisis' WHEN 'moderate' THEN 'moderate' WHEN 'low' THEN 'low' WHEN 'none' THEN 'none' ELSE 'high' END AS risk_level,
  CASE level WHEN 'crisis' THEN 'show_crisis_resources' WHEN 'moderate' THEN 'gentle_nudge' WHEN 'low' THEN 'supportive_nudge' WHEN 'none' THEN 'none'
  ELSE 'show_crisis_resources_with_support_prompt' END AS action, level NOT IN ('none', 'low', 'moderate') AS route_to_human,
  level != 'crisis' AS dismissible, CASE WHEN level IN ('none', 'low', 'moderate') THEN 0 ELSE 3 END AS resources
  FROM (SELECT event_id, {_ODD} AS level FROM events)""")
def decide_response(spark, sf):
    return ops.decide_response(_odd(spark, sf), "level").select(
        "event_id", "response.risk_level", "response.action", "response.route_to_human", "response.dismissible",
        F.size("response.resources").alias("resources"))


_RANK = "CASE level WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 WHEN 'crisis' THEN 4 ELSE {other} END"


@query("severity_rank", f"""SELECT event_id, {_RANK.format(other=0)} AS rank, {_RANK.format(other=-1)} AS strict_rank
  FROM (SELECT event_id, {_ODD} AS level FROM events)""")
def rank(spark, sf):
    return _odd(spark, sf).select("event_id", severity_rank("level").alias("rank"), severity_rank("level", -1).alias("strict_rank"))


# Scan results: level 0-4, tier 3 for some of the fours, threats among the threes, no category for some.
_SCAN = """SELECT event_id AS msg_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE user_id END AS user_id, ts,
  CAST((event_id * 7) % 5 AS INT) AS level, (event_id * 7) % 5 = 4 AS tier3,
  (event_id * 7) % 5 > 0 AS matched, (event_id * 7) % 5 = 3 AND event_id % 2 = 0 AS received_threat,
  CASE (event_id * 7) % 5 WHEN 4 THEN 'crisis' WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'received_threat' END
  WHEN 2 THEN 'major_stress' WHEN 1 THEN CASE WHEN event_id % 4 != 0 THEN 'everyday_stress' END END AS category FROM events"""


def scanned(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("_scan_events")
    rows = spark.sql(_SCAN.replace("FROM events", "FROM _scan_events"))
    return rows.withColumn("categories", F.array_compact(F.array("category"))).drop("category")


_FUSED = f"""{SETTINGS}, {_PARSED}, {_SAFE}, scans AS ({_SCAN}),
  s0 AS (SELECT c.*, coalesce(p.t_keyword, true) AS kon, coalesce(p.t_semantic, true) AS son, coalesce(p.popup_policy, 'balanced') AS policy
    FROM scans c LEFT JOIN settings p ON c.user_id = p.user_id),
  s1 AS (SELECT *, CASE WHEN kon THEN level ELSE 0 END AS k, kon AND tier3 AS k3, kon AND matched AS km, kon AND received_threat AS kt,
    CASE WHEN kon THEN category END AS kcat FROM s0),
  s2 AS (SELECT s1.*, f.source AS vsource, f.risk_level AS vlevel, f.categories AS vcats, f.confidence AS vconf,
    CASE WHEN k3 THEN 'crisis_phrase' WHEN policy = 'everything' AND k > 0 THEN 'everything' ELSE 'model' END AS route
    FROM s1 LEFT JOIN safe f ON s1.msg_id = f.msg_id),
  s3 AS (SELECT *, son AND vsource = 'fail_safe' AS failed, CASE WHEN son THEN {_RANK.format(other=0).replace('level', 'vlevel')} ELSE 0 END AS m FROM s2),
  s4 AS (SELECT *, CASE WHEN NOT son THEN k WHEN failed THEN greatest(k, m) ELSE m END AS chosen FROM s3),
  s5 AS (SELECT *, CASE WHEN son AND NOT failed AND m > 0 THEN greatest(chosen, k) ELSE chosen END AS floored FROM s4),
  s6 AS (SELECT *, CASE WHEN kt AND NOT son THEN 3 WHEN kt AND floored > 0 THEN greatest(floored, 3) ELSE floored END AS threatened FROM s5),
  s7 AS (SELECT *, CASE route WHEN 'crisis_phrase' THEN 4 WHEN 'everything' THEN k ELSE threatened END AS r FROM s6),
  fused AS (SELECT *, (['none', 'low', 'moderate', 'high', 'crisis'])[1 + r] AS risk_level,
    CASE WHEN route = 'everything' THEN CASE WHEN k >= 3 THEN 'urgent' ELSE 'gentle' END WHEN r >= 3 THEN 'urgent'
      WHEN r = 2 OR (policy = 'everything' AND r = 1) THEN 'gentle' ELSE 'none' END AS surface,
    CASE WHEN route != 'model' OR NOT son OR failed THEN 1 WHEN km AND k >= r THEN 1 ELSE 2 END AS event_layer,
    CASE WHEN kcat IS NOT NULL THEN kcat WHEN route = 'crisis_phrase' THEN 'crisis' WHEN route = 'everything' THEN 'unknown'
      WHEN son AND vcats != '' THEN split_part(vcats, ',', 1) ELSE 'signal' END AS event_category,
    user_id IS NOT NULL AND r > 0 AS recorded FROM s7)"""


def fused(spark, sf):
    return ops.fuse_verdicts(scanned(spark, sf), verdicts(spark, sf), settings(spark, sf))


@query("fuse_fast_paths", f"WITH {_FUSED} SELECT route, count(*) AS messages, count_if(risk_level = 'crisis') AS crises FROM fused GROUP BY route")
def fuse_fast_paths(spark, sf):
    return fused(spark, sf).groupBy("route").agg(
        F.count("*").alias("messages"), F.count_if(F.col("risk_level") == "crisis").alias("crises"))


_GRID = """g AS (SELECT event_id, CAST(event_id % 5 AS INT) AS k, CAST((event_id * 3) % 5 AS INT) AS m, event_id % 4 != 0 AS son,
  event_id % 7 = 0 AS failed, event_id % 3 = 0 AS threat FROM events)"""


def _grid(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "CAST(event_id % 5 AS INT) AS k", "CAST((event_id * 3) % 5 AS INT) AS m", "event_id % 4 != 0 AS son",
        "event_id % 7 = 0 AS failed", "event_id % 3 = 0 AS threat")


@query("keyword_floor", f"WITH {_GRID} SELECT event_id, CASE WHEN son AND NOT failed AND m > 0 THEN greatest(m, k) ELSE m END AS rank FROM g")
def keyword_floor(spark, sf):
    return _grid(spark, sf).select("event_id", ops.keyword_floor(
        F.col("m"), F.col("k"), F.col("m"), F.col("son"), F.col("failed")).alias("rank"))


@query("threat_floor", f"WITH {_GRID} SELECT event_id, CASE WHEN threat AND NOT son THEN 3 WHEN threat AND m > 0 THEN greatest(m, 3) ELSE m END AS rank FROM g")
def threat_floor(spark, sf):
    return _grid(spark, sf).select("event_id", ops.threat_floor(F.col("m"), F.col("threat"), F.col("son")).alias("rank"))


@query("level_choice", f"""WITH {_GRID}, c AS (SELECT *, CASE WHEN NOT son THEN k WHEN failed THEN greatest(k, m) ELSE m END AS c0 FROM g),
  f AS (SELECT *, CASE WHEN son AND NOT failed AND m > 0 THEN greatest(c0, k) ELSE c0 END AS c1 FROM c)
  SELECT event_id, (['none', 'low', 'moderate', 'high', 'crisis'])[1 + CASE WHEN threat AND NOT son THEN 3
  WHEN threat AND c1 > 0 THEN greatest(c1, 3) ELSE c1 END] AS level FROM f""")
def level_choice(spark, sf):
    return _grid(spark, sf).select("event_id", level_name(ops.final_rank(
        *[F.col(c) for c in ("k", "m", "son", "failed", "threat")])).alias("level"))


@query("surface", f"""SELECT event_id, CASE WHEN level IN ('crisis', 'high') THEN 'urgent' WHEN level = 'moderate' OR
  (event_type = 'view' AND level = 'low') THEN 'gentle' ELSE 'none' END AS surface FROM (SELECT event_id, event_type, {_ODD} AS level FROM events)""")
def surface(spark, sf):
    policy = F.when(F.col("event_type") == "view", "everything").otherwise("balanced")
    return _odd(spark, sf).select("event_id", ops.surface(F.col("level"), policy).alias("surface"))


@query("attribute_event", f"""WITH {_FUSED} SELECT user_id, msg_id AS seq, event_layer AS layer, risk_level AS level,
  event_category AS category FROM fused WHERE recorded""")
def attribute_event(spark, sf):
    return ops.attribute_event(fused(spark, sf)).drop("ts")


@query("fuse_verdicts", f"""WITH {_FUSED} SELECT msg_id, route, risk_level, surface, event_layer, event_category, recorded,
  CASE route WHEN 'crisis_phrase' THEN 1e0 WHEN 'everything' THEN 0.9e0 ELSE CASE WHEN son THEN vconf ELSE 0e0 END END AS confidence,
  CASE risk_level WHEN 'crisis' THEN 'show_crisis_resources' WHEN 'high' THEN 'show_crisis_resources_with_support_prompt'
  WHEN 'moderate' THEN 'gentle_nudge' WHEN 'low' THEN 'supportive_nudge' ELSE 'none' END AS action FROM fused""")
def fuse_verdicts(spark, sf):
    return fused(spark, sf).select("msg_id", "route", "risk_level", "surface", "event_layer", "event_category", "recorded",
                                   "confidence", "response.action")


@query("context_label", f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ', other' ELSE CASE level WHEN 'none' THEN 'no concern'
  WHEN 'moderate' THEN 'moderate concern' WHEN 'high' THEN 'high concern' ELSE level END END AS context
  FROM (SELECT event_id, event_type, {_ODD} AS level FROM events)""")
def context_label(spark, sf):
    cats = F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return _odd(spark, sf).select("event_id", ops.context_label(cats, F.col("level")).alias("context"))


_SENDS = "sends AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0)"
_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"


# Ten users share all events, so that a day holds crises enough; the last note of some lies within the day.
@query("escalation_candidates", f"""WITH {HISTORY}, {SETTINGS}, {_SENDS}, dense AS (SELECT * REPLACE (user_id % 10 + 1 AS user_id) FROM history),
  sent AS (SELECT user_id % 10 + 1 AS user_id FROM sends WHERE user_id % 10 < 3 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)
  SELECT h.user_id, count(*) AS crises, any_value(regexp_extract(s.contact, '{_EMAIL}')) AS address FROM dense h JOIN settings s USING (user_id)
  WHERE h.level = 'crisis' AND h.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND h.ts <= TIMESTAMP '{AS_OF}'
  AND regexp_extract(s.contact, '{_EMAIL}') != '' AND h.user_id NOT IN (SELECT user_id FROM sent) GROUP BY h.user_id HAVING count(*) >= 3""")
def escalation_candidates(spark, sf):
    dense = F.col("user_id") % 10 + 1
    sends = table(spark, sf, "events").where("event_type = 'purchase' AND event_id % 2 = 0 AND user_id % 10 < 3").select(dense.alias("user_id"), "ts")
    return ops.escalation_candidates(history(spark, sf).withColumn("user_id", dense), settings(spark, sf), sends, as_of())


_CONTACT = "CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 5 = 1 THEN NULL ELSE c_name || ' <a.b+' || c_custkey || '@x-' || c_nationkey || '.school.edu> or z@y.org' END"


@query("extract_email", f"SELECT c_custkey, regexp_extract(coalesce({_CONTACT}, ''), '{_EMAIL}') AS address FROM customer")
def extract_email(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{_CONTACT} AS contact").select(
        "c_custkey", ops.extract_email(F.col("contact")).alias("address"))


@query("escalation_events", """SELECT user_id, epoch_us(ts) AS at, CASE WHEN event_id % 7 = 0 THEN 1 WHEN value > 50 THEN 4 ELSE 2 END AS layer,
  CASE WHEN value > 50 THEN 'crisis' ELSE 'moderate' END AS level,
  CASE WHEN event_id % 7 = 0 THEN 'auto_escalation' WHEN value > 50 THEN 'escalation_sent' ELSE 'escalation_prepared' END AS category FROM events
  WHERE event_id % 7 <> 0 OR value > 50""")
def escalation_events(spark, sf):
    outcomes = table(spark, sf, "events").selectExpr("user_id", "ts", "value > 50 AS sent", "event_id % 7 = 0 AS automatic")
    return ops.escalation_events(outcomes).withColumn("at", F.unix_micros("ts")).drop("ts")
