"""Event history, gate, settings and retention over histories derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import history as ops, identity, reports as rep
from tidewell.plans.inputs import (
    AS_OF, CHAT, DAILY, HISTORY, SETTINGS, as_of, chat, daily, history, settings, table, users,
)
from tidewell.plans.registry import query

_T = f"TIMESTAMP '{AS_OF}'"
_RANK = "CASE level WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 WHEN 'crisis' THEN 4 ELSE 0 END"
_STREAK = f"""streaks AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS streak FROM history
  WHERE ts >= {_T} - INTERVAL 7 DAY AND ts <= {_T} AND {_RANK} >= 1 GROUP BY user_id)"""
GATE = f"""{_STREAK}, recent AS (SELECT user_id, bool_or(level = 'crisis') AS crisis, bool_or(layer IN (1, 2)) AS content,
  count(DISTINCT CASE WHEN layer IN (1, 2, 3) THEN layer END) = 3 AS all_three,
  array_to_string(list_sort(list(DISTINCT layer)), ',') AS layers
  FROM history WHERE ts >= {_T} - INTERVAL 4 DAY AND ts <= {_T} GROUP BY user_id),
  gate0 AS (SELECT s.user_id, coalesce(k.streak, 0) AS streak, coalesce(r.layers, '') AS layers,
  coalesce(r.crisis, false) OR (coalesce(r.all_three, false) AND coalesce(k.streak, 0) >= 4 AND s.t_trend) AS urgent,
  coalesce(r.content, false) OR coalesce(k.streak, 0) >= 2 AS soft
  FROM settings s LEFT JOIN streaks k USING (user_id) LEFT JOIN recent r USING (user_id)),
  gate AS (SELECT user_id, streak, layers, urgent, soft AND NOT urgent AS gentle FROM gate0)"""


@query("to_events", f"""WITH {HISTORY} SELECT user_id, seq, epoch_us(date_trunc('second', ts)) AS at, layer, level, category
  FROM history""")
def to_events(spark, sf):
    wide = history(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "props"), "seq")
    return ops.to_events(wide).withColumn("at", F.unix_micros("ts")).drop("ts")


# Five users share the history, so that the limit of 500 cuts.
@query("retain_last", f"""WITH {HISTORY} SELECT user_id, seq, level FROM (SELECT * REPLACE (user_id % 5 AS user_id),
  row_number() OVER (PARTITION BY user_id % 5 ORDER BY seq DESC) AS rn FROM history) WHERE rn <= 500""")
def retain_last(spark, sf):
    shared = history(spark, sf).withColumn("user_id", F.col("user_id") % 5)
    return ops.retain_last(shared, 500, ["user_id"], ["seq"]).select("user_id", "seq", "level")


@query("erase", f"""WITH {HISTORY}, gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0)
  SELECT user_id, count(*) AS events FROM history WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id""")
def erase(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS user_id")
    kept = identity.erase({"events": history(spark, sf)}, gone)["events"]
    return kept.groupBy("user_id").agg(F.count("*").alias("events"))


@query("reset_history", f"""WITH {HISTORY}, {SETTINGS}, gone AS (SELECT c_custkey AS user_id FROM customer
  WHERE c_mktsegment = 'BUILDING'), kept AS (SELECT user_id, count(*) AS events FROM history
  WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id)
  SELECT s.user_id, s.contact, coalesce(k.events, 0) AS events FROM settings s LEFT JOIN kept k USING (user_id)""")
def reset_history(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS user_id")
    left = identity.reset_history({"events": history(spark, sf), "settings": settings(spark, sf)}, gone)
    counted = left["events"].groupBy("user_id").agg(F.count("*").alias("events"))
    return left["settings"].join(counted, "user_id", "left").select(
        "user_id", "contact", F.coalesce("events", F.lit(0)).alias("events"))


@query("trend_streak", f"WITH {HISTORY}, {_STREAK} SELECT user_id, streak FROM streaks")
def trend_streak(spark, sf):
    return ops.trend_streak(history(spark, sf), as_of())


@query("trend_gate", f"WITH {HISTORY}, {SETTINGS}, {GATE} SELECT user_id, streak, layers, urgent, gentle FROM gate")
def trend_gate(spark, sf):
    gate = ops.trend_gate(history(spark, sf), settings(spark, sf), as_of())
    return gate.withColumn("layers", F.array_join(F.col("layers").cast("array<string>"), ","))


@query("crisis_24h", f"""WITH {HISTORY} SELECT user_id, count(*) AS crises FROM history
  WHERE level = 'crisis' AND ts >= {_T} - INTERVAL 24 HOUR AND ts <= {_T} GROUP BY user_id""")
def crisis_24h(spark, sf):
    return ops.crisis_24h(history(spark, sf), as_of())


@query("recent_send", f"""SELECT user_id, epoch_us(max(ts)) AS last_sent, max(ts) >= {_T} - INTERVAL 24 HOUR AS recent
  FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def recent_send(spark, sf):
    sends = table(spark, sf, "events").where("event_type = 'purchase'")
    return ops.recent_send(sends, as_of()).withColumn("last_sent", F.unix_micros("last_sent"))


@query("moments", f"""WITH {HISTORY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS pos
  FROM history WHERE level != 'none') SELECT user_id, pos, strftime(ts, '%b %d') AS date,
  ltrim(strftime(ts, '%I:%M %p'), '0') AS time, level,
  CASE WHEN replace(category, '_', ' ') IN ('', 'none') THEN 'general concern' ELSE replace(category, '_', ' ') END AS category,
  CASE layer WHEN 1 THEN 'Keyword' WHEN 2 THEN 'Semantic' WHEN 3 THEN 'Behavioral' WHEN 4 THEN 'Trend gate' ELSE 'Signal' END
  AS source FROM ranked WHERE pos <= 50""")
def moments(spark, sf):
    return ops.moments(history(spark, sf))


@query("status_counters", f"""WITH {HISTORY}, {DAILY}, {_STREAK}, e AS (SELECT user_id, count(*) AS events,
  epoch_us(arg_max(ts, seq)) AS last_event FROM history GROUP BY user_id),
  d AS (SELECT user_id, count(DISTINCT day) AS days_tracked, strftime(max(day), '%Y-%m-%d') AS last_day FROM daily GROUP BY user_id)
  SELECT user_id, events, days_tracked, last_day, last_event, coalesce(streak, 0) AS streak
  FROM e JOIN d USING (user_id) LEFT JOIN streaks USING (user_id)""")
def status_counters(spark, sf):
    return ops.status(history(spark, sf), daily(spark, sf), as_of()).withColumns({
        "last_day": F.date_format("last_day", "yyyy-MM-dd"), "last_event": F.unix_micros("last_event")})


def patches(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS seq", "CASE WHEN event_type = 'view' THEN concat('n', event_id) END AS name",
        "CASE WHEN event_type = 'click' THEN concat('x', event_id, '@mail.org') END AS contact",
        "CASE WHEN event_type = 'signup' THEN true END AS onboarded",
        "CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END AS track_app_usage",
        "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'everything' ELSE 'loud' END END AS popup_policy",
        "CASE WHEN event_id % 5 = 0 THEN map('semantic', event_id % 2 = 0) WHEN event_id % 5 = 1 THEN map('trend', event_id % 3 = 0) "
        "WHEN event_id % 5 = 2 THEN map('own_' || event_id % 2, event_id % 7 = 0) END AS toggles")


@query("merge_settings", """WITH p AS (SELECT user_id, event_id AS seq,
  CASE WHEN event_type = 'view' THEN 'n' || event_id END AS name,
  CASE WHEN event_type = 'click' THEN 'x' || event_id || '@mail.org' END AS contact,
  CASE WHEN event_type = 'signup' THEN true END AS onboarded,
  CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END AS track,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'everything' ELSE 'loud' END END AS policy,
  CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 END AS semantic, CASE WHEN event_id % 5 = 1 THEN event_id % 3 = 0 END AS trend,
  CASE WHEN event_id % 5 = 2 AND event_id % 2 = 1 THEN event_id % 7 = 0 END AS own_1
  FROM events)
  SELECT user_id, coalesce(arg_max(name, seq) FILTER (name IS NOT NULL), '') AS name,
  coalesce(arg_max(contact, seq) FILTER (contact IS NOT NULL), 'School Counselor <counselor@school.edu>') AS contact,
  coalesce(arg_max(onboarded, seq) FILTER (onboarded IS NOT NULL), false) AS onboarded,
  coalesce(arg_max(track, seq) FILTER (track IS NOT NULL), false) AS track_app_usage,
  CASE WHEN arg_max(policy, seq) FILTER (policy IS NOT NULL) = 'everything' THEN 'everything' ELSE 'balanced' END AS popup_policy,
  coalesce(arg_max(semantic, seq) FILTER (semantic IS NOT NULL), true) AS semantic,
  coalesce(arg_max(trend, seq) FILTER (trend IS NOT NULL), true) AS trend,
  arg_max(own_1, seq) FILTER (own_1 IS NOT NULL) AS own_1 FROM p GROUP BY user_id""")
def merge_settings(spark, sf):
    return ops.merge_settings(patches(spark, sf)).select(
        "user_id", "name", "contact", "onboarded", "track_app_usage", "popup_policy",
        F.col("toggles")["semantic"].alias("semantic"), F.col("toggles")["trend"].alias("trend"), F.try_element_at("toggles", F.lit("own_1")).alias("own_1"))


@query("user_state", f"""WITH {HISTORY}, {SETTINGS}, {GATE}, {DAILY}, {CHAT}, talk AS (SELECT * REPLACE (user_id % 2 + 1 AS user_id) FROM chat),
  today AS (SELECT * FROM daily WHERE day = DATE '2024-01-30'),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM talk) WHERE rn <= 200),
  turns AS (SELECT user_id, count(*) AS chat_turns, md5(string_agg(role || ': ' || content, chr(10) ORDER BY seq)) AS chat FROM kept GROUP BY user_id)
  SELECT s.user_id, s.contact, g.urgent, g.gentle, coalesce(t.chat_turns, 0) AS chat_turns, t.chat,
  CASE WHEN d.user_id IS NULL THEN 'no_data' WHEN coalesce(d.active_minutes, 0) < 20 THEN 'learning' ELSE 'live' END AS state
  FROM settings s LEFT JOIN gate g USING (user_id) LEFT JOIN today d USING (user_id) LEFT JOIN turns t USING (user_id)""")
def user_state(spark, sf):
    board = rep.dashboard(daily(spark, sf), users(spark, sf), F.lit("2024-01-30 23:59:59").cast("timestamp"))
    gate = ops.trend_gate(history(spark, sf), settings(spark, sf), as_of())
    # Two users hold all turns, so that the limit of 200 cuts
    state = ops.user_state(settings(spark, sf), board, gate, chat(spark, sf).withColumn("user_id", F.col("user_id") % 2 + 1))
    said = F.md5(F.array_join(F.transform("chat", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"))
    return state.select("user_id", "contact", "urgent", "gentle", "chat_turns", F.when(F.col("chat").isNotNull(), said).alias("chat"), "state")


