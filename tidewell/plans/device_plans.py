"""Device streams in batch form over `events`; a device is a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import devices as ops
from tidewell.operators.scan import scan_messages
from tidewell.plans.inputs import MESSAGES, messages, table
from tidewell.plans.registry import query
from tidewell.plans.text_plans import SCANNED, matchers

_US = "epoch_us(ts)"


def _view(spark, sf, sql):
    table(spark, sf, "events").createOrReplaceTempView("_dev_events")
    return spark.sql(sql + "_dev_events")


# --- snapshots -------------------------------------------------------------------------------

_OWN = "CASE WHEN doc_id % 9 = 0 THEN 'Tidewell Coping Chat ' || text WHEN doc_id % 9 = 1 THEN substr(text, 1, 6) ELSE text END"


@query("clean_snapshots", rf"""WITH s AS (SELECT doc_id, substr(regexp_replace(regexp_replace({_OWN}, '^[\s\x{{0b}}\x{{85}}\p{{Z}}]+', ''), '[\s\x{{0b}}\x{{85}}\p{{Z}}]+$', ''), 1, 4000) AS text FROM documents)
  SELECT doc_id, md5(text) AS digest FROM s WHERE length(text) >= 8 AND NOT (contains(text, 'Tidewell') AND (contains(text, 'Coping Chat') OR contains(text, 'Moments')))""")
def clean_snapshots(spark, sf):
    shots = table(spark, sf, "documents").selectExpr("doc_id", f"{_OWN} AS text")
    return ops.clean_snapshots(shots, "Tidewell").select("doc_id", F.md5("text").alias("digest"))


_SHOTS = "SELECT user_id AS device_id, event_id AS seq, ts, {text} AS text FROM "
_REPEATED = _SHOTS.format(text="CASE WHEN value < 40 THEN 'typing slowly' ELSE concat('message ', event_type) END")


@query("drop_repeats", f"""WITH s AS ({_REPEATED} events), p AS (SELECT *, lag(text) OVER (PARTITION BY device_id ORDER BY ts, seq) AS prev FROM s)
  SELECT device_id, seq, text FROM p WHERE prev IS NULL OR text != prev""")
def drop_repeats(spark, sf):
    return ops.drop_repeats(_view(spark, sf, _REPEATED), ["seq"]).select("device_id", "seq", "text")


_POLLS = _SHOTS.format(text="CASE WHEN event_id % 19 = 0 THEN 'short' WHEN value < 60 THEN '  still the same text ' ELSE concat('message ', event_type) END")


@query("settle", f"""WITH s AS (SELECT *, CASE WHEN length(trim(text)) >= 8 THEN trim(text) ELSE '' END AS t FROM ({_POLLS} events)),
  c AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t != lag(t) OVER w THEN {_US} END AS started FROM s WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
  g AS (SELECT *, max(started) OVER (PARTITION BY device_id ORDER BY ts, seq) AS since FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY device_id, since ORDER BY ts, seq) AS rn FROM g WHERE t != '' AND {_US} - since >= 1100000),
  f AS (SELECT *, lag(t) OVER (PARTITION BY device_id ORDER BY ts, seq) AS last FROM r WHERE rn = 1)
  SELECT device_id, seq, t AS text FROM f WHERE last IS NULL OR t != last""")
def settle(spark, sf):
    return ops.settle(_view(spark, sf, _POLLS), ["seq"]).select("device_id", "seq", "text")


# --- alerts ----------------------------------------------------------------------------------

# Alerts arrive seconds apart: the event id sets the second, so that quiet times matter.
_ALERTS = """SELECT event_id % 7 AS device_id, event_id AS seq, timestamp_micros(1704067200000000 + event_id * 700000) AS ts, event_id % 11 = 0 AS tier3,
  CAST(CASE WHEN event_id % 11 = 0 THEN 4 ELSE user_id % 4 END AS INT) AS level,
  CASE WHEN value > 60 THEN 'urgent' WHEN value > 15 THEN 'gentle' ELSE 'none' END AS surface, concat('phrase ', user_id % 3) AS phrase FROM """


def alerts(spark, sf):
    return _view(spark, sf, _ALERTS)


# The alerts of a device one after the other, each judged by the state the ones before left.
_LINED_UP = f"a AS (SELECT *, {_US} AS us, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS n FROM ({_ALERTS.replace("timestamp_micros", "make_timestamp")} events) WHERE {{able}})"


@query("throttle_alerts", f"""WITH RECURSIVE {_LINED_UP.format(able="tier3 OR surface IN ('urgent', 'gentle')")},
  j AS (SELECT device_id, seq, surface, tier3, n, true AS shown, us + 4000000 AS quiet_until, CASE WHEN tier3 OR surface = 'urgent' THEN us + 30000000 ELSE -1 END AS urgent_until FROM a WHERE n = 1
    UNION ALL SELECT k.device_id, k.seq, k.surface, k.tier3, k.n, k.shown, CASE WHEN k.shown THEN k.us + 4000000 ELSE k.quiet_until END,
      CASE WHEN k.shown AND k.urgent THEN k.us + 30000000 ELSE k.urgent_until END
    FROM (SELECT a.*, a.tier3 OR a.surface = 'urgent' AS urgent, j.quiet_until, j.urgent_until,
      CASE WHEN a.tier3 OR a.surface = 'urgent' THEN a.us >= j.urgent_until ELSE a.us >= j.quiet_until END AS shown
      FROM j JOIN a ON a.device_id = j.device_id AND a.n = j.n + 1) k)
  SELECT device_id, seq, surface, tier3 FROM j WHERE shown""")
def throttle_alerts(spark, sf):
    return ops.throttle_alerts(alerts(spark, sf)).select("device_id", "seq", "surface", "tier3")


@query("throttle_screen", f"""WITH RECURSIVE {_LINED_UP.format(able="level >= 1 AND (tier3 OR surface <> 'none')")},
  j AS (SELECT device_id, seq, phrase, tier3, n, true AS shown, us AS last_at, phrase AS last_phrase FROM a WHERE n = 1
    UNION ALL SELECT k.device_id, k.seq, k.phrase, k.tier3, k.n, k.shown, CASE WHEN k.shown THEN k.us ELSE k.last_at END, CASE WHEN k.shown THEN k.phrase ELSE k.last_phrase END
    FROM (SELECT a.*, j.last_at, j.last_phrase, (a.phrase <> j.last_phrase OR a.us >= j.last_at + 40000000) AND (a.tier3 OR a.us >= j.last_at + 15000000) AS shown
      FROM j JOIN a ON a.device_id = j.device_id AND a.n = j.n + 1) k)
  SELECT device_id, seq, phrase, tier3 FROM j WHERE shown""")
def throttle_screen(spark, sf):
    return ops.throttle_screen(alerts(spark, sf)).select("device_id", "seq", "phrase", "tier3")


@query("display_phrase", f"""WITH {MESSAGES} SELECT msg_id, CASE WHEN msg_id % 3 = 0 THEN '' WHEN msg_id % 2 = 0 THEN split_part(text, ' ', 2)
  ELSE split_part(text, ' ', 1) END AS phrase FROM messages""")
def display_phrase(spark, sf):
    words = F.split("text", " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    hit = lambda i, tier: F.struct(word(i).alias("phrase"), F.lit("c").alias("category"), F.lit(tier).alias("tier"))
    hits = F.when(F.col("msg_id") % 3 == 0, F.array().cast("array<struct<phrase:string,category:string,tier:string>>")).otherwise(
        F.array(hit(0, "1"), hit(1, "3")))
    return messages(spark, sf).select("msg_id", ops.display_phrase(hits, F.col("msg_id") % 2 == 0).alias("phrase"))


_SNOOZES = "SELECT user_id AS device_id, ts AS start, ts + INTERVAL '{n}' HOUR AS until FROM {t} WHERE event_type = 'purchase' AND event_id % 4 = 0"


@query("apply_snooze", f"""WITH z AS ({_SNOOZES.format(n=2, t='events')}), a AS (SELECT user_id AS device_id, event_id AS seq, ts FROM events)
  SELECT device_id, seq FROM a WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.device_id = a.device_id AND a.ts >= z.start AND a.ts < z.until)""")
def apply_snooze(spark, sf):
    rows = _view(spark, sf, "SELECT user_id AS device_id, event_id AS seq, ts FROM ")
    snoozes = spark.sql(_SNOOZES.format(n=2, t="_dev_events"))
    return ops.apply_snooze(rows, snoozes).select("device_id", "seq")


_GATE_POLLS = """SELECT user_id AS device_id, user_id % 2 AS session_id, event_id AS seq, ts, event_type = 'error' AS urgent, event_type IN ('signup', 'error', 'click') AS gentle FROM """


@query("gate_edges", f"""WITH p AS ({_GATE_POLLS} events), w AS (SELECT *, lag(urgent) OVER o AS pu, lag(gentle) OVER o AS pg FROM p
  WINDOW o AS (PARTITION BY device_id, session_id ORDER BY ts, seq)), e AS (SELECT *, CASE WHEN pu IS NULL THEN NULL WHEN urgent AND NOT pu THEN 'urgent'
  WHEN gentle AND NOT pg THEN 'gentle' END AS alert FROM w) SELECT device_id, seq, alert FROM e WHERE alert IS NOT NULL""")
def gate_edges(spark, sf):
    return ops.gate_edges(_view(spark, sf, _GATE_POLLS), ["seq"]).select("device_id", "seq", "alert")


# --- rhythm ----------------------------------------------------------------------------------

_RHYTHM = """SELECT user_id AS device_id, event_id AS seq, ts, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'switch' ELSE 'key' END AS kind,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 51 WHEN event_id % 3 = 1 THEN 117 ELSE 12 END ELSE 30 END AS key_code FROM """


def rhythm(spark, sf):
    return _view(spark, sf, _RHYTHM)


_PANES = f"""r AS ({_RHYTHM} events), w AS (SELECT device_id, kind, key_code, unnest(range({_US} // 45000000 + 1, {_US} // 45000000 + 21)) AS report FROM r),
  s AS (SELECT device_id, report, count(*) FILTER (kind = 'switch') AS switches, count(*) FILTER (kind = 'key') AS keys,
  count(*) FILTER (kind = 'key' AND key_code IN (51, 117)) AS backs FROM w GROUP BY ALL),
  first AS (SELECT device_id, min({_US}) AS t0 FROM r GROUP BY 1),
  rates AS (SELECT s.*, report * 45000000 AS report_at, greatest(least(900e0, (report * 45000000 - t0) / 1e6) / 3600e0, 0.01e0) AS h FROM s JOIN first USING (device_id))"""


@query("rolling_rates", f"""WITH {_PANES} SELECT device_id, report_at, switches, round(least(120e0, switches / h), 6) AS tab_switches,
  round(least(120e0, switches / h) * 0.7e0, 6) AS interruptions FROM rates""")
def rolling_rates(spark, sf):
    return ops.rolling_rates(rhythm(spark, sf)).select(
        "device_id", F.unix_micros("report_at").alias("report_at"), "switches",
        F.round("tab_switches", 6).alias("tab_switches"), F.round("interruptions", 6).alias("interruptions"))


@query("backspace_rate", f"""WITH {_PANES} SELECT device_id, report_at, round(CASE WHEN keys > 0 THEN backs / keys ELSE 0e0 END, 6) AS backspace_rate FROM rates""")
def backspace_rate(spark, sf):
    return ops.rolling_rates(rhythm(spark, sf)).select(
        "device_id", F.unix_micros("report_at").alias("report_at"), F.round("backspace_rate", 6).alias("backspace_rate"))


_GAPS = f"""ev AS (SELECT device_id, seq, kind, {_US} AS us, min({_US}) OVER (PARTITION BY device_id) AS started FROM ({_RHYTHM} events)),
  sw AS (SELECT * FROM ev WHERE kind = 'switch'),
  gp AS (SELECT *, us - coalesce(lag(us) OVER (PARTITION BY device_id ORDER BY us, seq), started) AS gap FROM sw),
  gaps AS (SELECT device_id, (us // 45000000 + 1) * 45000000 AS report_at, coalesce(max(gap / 60e6), 0e0) AS g FROM gp GROUP BY ALL)"""


@query("longest_gap", f"WITH {_GAPS} SELECT device_id, report_at, round(g, 3) AS avg_session_min FROM gaps")
def longest_gap(spark, sf):
    return ops.longest_gap(rhythm(spark, sf)).select(
        "device_id", F.unix_micros("report_at").alias("report_at"), F.round("avg_session_min", 3).alias("avg_session_min"))


@query("report_signals", f"""WITH {_PANES}, {_GAPS} SELECT r.device_id, r.report_at, round(least(120e0, switches / h), 6) AS tab_switches,
  round(CASE WHEN switches = 0 THEN 50e0 ELSE coalesce(g, 0e0) END, 3) AS avg_session_min FROM rates r LEFT JOIN gaps g USING (device_id, report_at)""")
def report_signals(spark, sf):
    return ops.report_signals(rhythm(spark, sf)).select(
        "device_id", F.unix_micros("report_at").alias("report_at"), F.round("tab_switches", 6).alias("tab_switches"),
        F.round("avg_session_min", 3).alias("avg_session_min"))


_TICKS = "SELECT user_id AS device_id, event_id AS seq, ts FROM "


@query("late_minutes", f"""WITH t AS ({_TICKS} events), d AS (SELECT *, coalesce({_US} - lag({_US}) OVER (PARTITION BY device_id ORDER BY ts, seq), 0) AS dt FROM t)
  SELECT device_id, seq, round(sum(CASE WHEN hour(ts) < 5 THEN dt ELSE 0 END) OVER w / 60e6, 3) AS late_night_min, round(sum(dt) OVER w / 60e6, 3) AS active_minutes
  FROM d WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)""")
def late_minutes(spark, sf):
    return ops.late_minutes(_view(spark, sf, _TICKS)).select(
        "device_id", "seq", F.round("late_night_min", 3).alias("late_night_min"), F.round("active_minutes", 3).alias("active_minutes"))


_APPS = "SELECT user_id AS device_id, event_id AS seq, ts, event_type AS app FROM "


@query("app_spans", f"""WITH a AS (SELECT device_id, seq, app, {_US} AS s, lead({_US}) OVER (PARTITION BY device_id ORDER BY ts, seq) AS e FROM ({_APPS} events)),
  k AS (SELECT *, unnest(range(s // 3600000000, (e - 1) // 3600000000 + 1)) AS tick FROM a WHERE e > s)
  SELECT device_id, (tick + 1) * 3600000000 AS report_at, app, round(sum(least(e, (tick + 1) * 3600000000) - greatest(s, tick * 3600000000)) / 1e6, 6) AS seconds FROM k GROUP BY ALL""")
def app_spans(spark, sf):
    return ops.app_spans(_view(spark, sf, _APPS), tick_seconds=3600).select(
        "device_id", F.unix_micros("report_at").alias("report_at"), "app", F.round("seconds", 6).alias("seconds"))


_WEB = """SELECT user_id AS device_id, event_id AS seq, ts, event_type != 'view' AS visible, event_type = 'error' AS blur,
  CASE WHEN event_type = 'click' THEN 5 ELSE 0 END AS keys, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS backspaces FROM """


@query("web_rhythm", f"""WITH t AS ({_WEB} events), d AS (SELECT *, coalesce({_US} - lag({_US}) OVER w, 0) AS dt, coalesce(sum(CAST(blur AS INT)) OVER (PARTITION BY device_id ORDER BY ts, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM t WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
  s AS (SELECT device_id, stretch, sum(CASE WHEN visible THEN dt ELSE 0 END) AS vis, sum(CASE WHEN visible AND hour(ts) < 5 THEN dt ELSE 0 END) AS late,
  sum(CAST(blur AS INT)) AS blurs, sum(keys) AS keys, sum(backspaces) AS backs FROM d GROUP BY ALL),
  g AS (SELECT device_id, sum(vis) AS vis, sum(late) AS late, sum(blurs) AS blurs, max(vis) AS longest, sum(keys) AS keys, sum(backs) AS backs FROM s GROUP BY device_id),
  h AS (SELECT *, least(120e0, blurs / greatest(vis / 3600e6, 0.08e0)) AS tab FROM g)
  SELECT device_id, round(tab, 6) AS tab_switches, round(CASE WHEN blurs = 0 THEN 50e0 ELSE longest / 60e6 END, 6) AS avg_session_min,
  round(CASE WHEN keys > 0 THEN backs / keys ELSE 0e0 END, 6) AS backspace_rate, round(late / 60e6, 6) AS late_night_min FROM h""")
def web_rhythm(spark, sf):
    signals = ops.web_rhythm(_view(spark, sf, _WEB))
    return signals.select("device_id", *[F.round(c, 6).alias(c) for c in (
        "tab_switches", "avg_session_min", "backspace_rate", "late_night_min")])


_CHECKS = "SELECT user_id AS device_id, event_id AS seq, ts, event_type IN ('error', 'signup') OR value > 120 AS strained FROM "


@query("strain_counter", f"""WITH c AS ({_CHECKS} events), s AS (SELECT *, sum(CASE WHEN strained THEN 1 ELSE -1 END) OVER (PARTITION BY device_id ORDER BY ts, seq) AS total FROM c)
  SELECT device_id, seq, CAST(total - least(0, min(total) OVER (PARTITION BY device_id ORDER BY ts, seq)) AS BIGINT) AS streak FROM s""")
def strain_counter(spark, sf):
    return ops.strain_counter(_view(spark, sf, _CHECKS)).select("device_id", "seq", "streak")


@query("web_gate", """WITH g AS (SELECT event_id, event_id % 13 = 0 AS tier3, event_id % 3 = 0 AS matched, CASE event_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate'
  WHEN 2 THEN 'high' WHEN 3 THEN 'none' WHEN 4 THEN 'crisis' END AS risk, event_id % 8 AS streak FROM events)
  SELECT event_id, CASE WHEN tier3 OR risk IN ('high', 'crisis') THEN 'crisis' WHEN ((matched OR risk IN ('low', 'moderate')) AND streak >= 4)
  OR (matched AND risk IN ('low', 'moderate')) THEN 'regular' END AS gate FROM g""")
def web_gate(spark, sf):
    key = F.col("event_id")
    risk = F.expr("CASE event_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' WHEN 3 THEN 'none' WHEN 4 THEN 'crisis' END")
    return table(spark, sf, "events").select("event_id", ops.web_gate(key % 13 == 0, key % 3 == 0, risk, key % 8).alias("gate"))


# With no verdict at hand a user of the semantic layer is failed safe to high, unless it is a crisis; the others get what the keywords say.
@query("monitor", f"""WITH {SCANNED}, e AS (SELECT *, user_id % 2 = 0 AS semantic FROM scanned)
  SELECT user_id, msg_id AS seq, 1 AS layer, CASE WHEN level = 4 THEN 'crisis' WHEN semantic THEN 'high' ELSE (['none', 'low', 'moderate', 'high'])[level + 1] END AS level,
  CASE WHEN len(list_filter(hits, lambda h: h[2] <> 'fuzzy')) > 0 THEN hits[1][2] WHEN semantic THEN 'distress' ELSE 'signal' END AS category, {_US} AS at
  FROM e WHERE semantic OR level > 0""")
def monitor(spark, sf):
    """Messages scanned, fused with no model verdict at hand, and reduced to history rows."""
    from tidewell.operators.fusion import attribute_event, fuse_verdicts
    from tidewell.operators.history import to_events
    sent = messages(spark, sf)
    prefs = sent.select("user_id").distinct().selectExpr(
        "user_id", "map('keyword', true, 'semantic', user_id % 2 = 0) AS toggles", "'balanced' AS popup_policy")
    none = sent.selectExpr("msg_id", "CAST(NULL AS STRING) AS raw", "CAST(NULL AS STRING) AS error")
    fused = fuse_verdicts(scan_messages(sent, matchers(spark)).drop("text", "sentence"), none, prefs)
    return to_events(attribute_event(fused)).withColumn("at", F.unix_micros("ts")).drop("ts")
