"""Behavioural scoring over rhythm reports derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import behavior
from tidewell.plans.inputs import (
    APP_ROWS, DAILY, REPORTS, SETTINGS, app_rows, daily, reports, scored_sql, settings,
)
from tidewell.plans.registry import query

_SCORED = "WITH " + REPORTS + "," + scored_sql("reports")


@query("fill_baseline", f"""{_SCORED} SELECT seq, s_tabs AS s_tab_switches, s_late AS s_late_night_min,
  s_session AS s_avg_session_min, s_intr AS s_interruptions, s_back AS s_backspace_rate FROM scored""")
def fill_baseline(spark, sf):
    return behavior.fill_baseline(reports(spark, sf)).select("seq", *[f"s_{k}" for k in behavior.BASELINE])


@query("deviation", f"""{_SCORED} SELECT seq, round(d_late, 9) AS late, round(d_tabs, 9) AS tabs, round(d_intr, 9) AS intr,
  round(d_back, 9) AS back, round(d_frag, 9) AS frag FROM scored""")
def deviation(spark, sf):
    return behavior.deviations(reports(spark, sf)).select(
        "seq", *[F.round(f"d_{p}", 9).alias(p) for p in ("late", "tabs", "intr", "back", "frag")])


@query("confidence", f"{_SCORED} SELECT seq, round(conf, 9) AS conf FROM scored")
def confidence(spark, sf):
    return reports(spark, sf).select("seq", F.round(behavior.confidence(F.col("active_minutes")), 9).alias("conf"))


@query("marathon", f"{_SCORED} SELECT seq, round(marathon, 9) AS marathon FROM scored")
def marathon(spark, sf):
    return behavior.deviations(reports(spark, sf)).select("seq", F.round("marathon", 9).alias("marathon"))


@query("burnout", f"{_SCORED} SELECT seq, burnout_risk FROM scored")
def burnout(spark, sf):
    return behavior.score_behavior(reports(spark, sf)).select("seq", "burnout_risk")


@query("focus", f"{_SCORED} SELECT seq, focus_score FROM scored")
def focus(spark, sf):
    return behavior.score_behavior(reports(spark, sf)).select("seq", "focus_score")


@query("battery", f"{_SCORED} SELECT seq, mental_battery FROM scored")
def battery(spark, sf):
    return behavior.score_behavior(reports(spark, sf)).select("seq", "mental_battery")


@query("strain_status", f"{_SCORED} SELECT seq, status FROM scored")
def strain_status(spark, sf):
    return behavior.score_behavior(reports(spark, sf)).select("seq", "status")


@query("deltas", f"""{_SCORED}, d AS (
  SELECT seq, 0 AS pos, 'Tab switching' AS label, (s_tabs - 25e0) / 25e0 * 100e0 AS p FROM scored
  UNION ALL SELECT seq, 1, 'Late-night activity', (s_late - 15e0) / 15e0 * 100e0 FROM scored
  UNION ALL SELECT seq, 2, 'Interruptions', (s_intr - 10e0) / 10e0 * 100e0 FROM scored
  UNION ALL SELECT seq, 3, 'Avg session length', (s_session - 50e0) / 50e0 * 100e0 FROM scored
  UNION ALL SELECT seq, 4, 'Correction typing', (s_back - 0.1e0) / 0.1e0 * 100e0 FROM scored)
  SELECT seq, pos, label, CAST(round_even(p, 0) AS BIGINT) AS pct,
  CASE WHEN round_even(p, 0) > 5 THEN 'up' WHEN round_even(p, 0) < -5 THEN 'down' ELSE 'flat' END AS direction FROM d""")
def deltas(spark, sf):
    return behavior.deltas(reports(spark, sf), ["seq"])


@query("suggestions", f"{_SCORED} SELECT seq, tips FROM scored")
def suggestions(spark, sf):
    return behavior.score_behavior(reports(spark, sf)).select(
        "seq", F.array_join("suggestions", " | ").alias("tips"))


@query("score_behavior", f"{_SCORED} SELECT user_id, seq, mental_battery, focus_score, burnout_risk, status, tips FROM scored")
def score_behavior(spark, sf):
    return behavior.score_behavior(reports(spark, sf)).select(
        "user_id", "seq", "mental_battery", "focus_score", "burnout_risk", "status",
        F.array_join("suggestions", " | ").alias("tips"))


@query("daily_metrics", f"""WITH {DAILY} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, mental_battery, focus_score,
  burnout_risk, status, tips FROM daily""")
def daily_metrics(spark, sf):
    return daily(spark, sf).select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "mental_battery", "focus_score", "burnout_risk",
        "status", F.array_join("suggestions", " | ").alias("tips"))


@query("strain_events", f"""{_SCORED} SELECT user_id, seq, epoch_us(ts) AS at, 3 AS layer, 'moderate' AS level,
  'behavioral_strain' AS category FROM scored WHERE burnout_risk > 55""")
def strain_events(spark, sf):
    return behavior.strain_events(reports(spark, sf)).select(
        "user_id", "seq", F.unix_micros("ts").alias("at"), "layer", "level", "category")


@query("merge_app_usage", f"""WITH {APP_ROWS}, {SETTINGS} SELECT a.user_id, strftime(day, '%Y-%m-%d') AS day,
  substr(trim(app), 1, 80) AS app, CAST(sum(seconds) AS DOUBLE) AS seconds FROM app_rows a
  JOIN settings s ON a.user_id = s.user_id AND s.track_app_usage
  WHERE seconds > 0 AND trim(app) != '' GROUP BY ALL""")
def merge_app_usage(spark, sf):
    return behavior.merge_app_usage(app_rows(spark, sf), settings(spark, sf)).select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "app", F.col("seconds").cast("double").alias("seconds"))
