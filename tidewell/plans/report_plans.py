"""Dashboard, weekly findings and monthly recap over user-days derived from `events`."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewell.operators import reports as ops
from tidewell.plans.inputs import (
    APP_USAGE, CHAT, DAILY, HISTORY, SETTINGS, USERS, app_rows, chat, daily, history, settings,
    users,
)
from tidewell.plans.registry import query



def _now():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


_DAY = "DATE '2024-01-30'"
_YEAR, _MONTH = 2024, 1
_WEEK = f"week AS (SELECT * FROM daily WHERE day > {_DAY} - 7 AND day <= {_DAY})"


def _day(column="day"):
    return F.date_format(column, "yyyy-MM-dd")


@query("dashboard", f"""WITH {DAILY}, {USERS}, today AS (SELECT * FROM daily WHERE day = {_DAY}),
  before AS (SELECT user_id, arg_max(mental_battery, day) AS prior FROM daily WHERE day < {_DAY} GROUP BY user_id),
  j AS (SELECT u.user_id AS uid, t.*, b.prior, CASE WHEN t.user_id IS NULL THEN 'no_data'
    WHEN coalesce(t.active_minutes, 0) < 20 THEN 'learning' ELSE 'live' END AS state,
    CAST(round_even(coalesce(t.active_minutes, 0e0), 0) AS BIGINT) AS act
    FROM users u LEFT JOIN today t ON u.user_id = t.user_id LEFT JOIN before b ON u.user_id = b.user_id)
  SELECT uid AS user_id, state, CASE WHEN state = 'live' THEN mental_battery ELSE 100 END AS mental_battery,
  CASE WHEN state = 'live' THEN focus_score ELSE 100 END AS focus_score,
  CASE WHEN state = 'live' THEN CAST(round_even(coalesce(tab_switches, 0e0), 0) AS BIGINT) ELSE 25 END AS tab_switches,
  act AS active_minutes, CAST(round_even(coalesce(late_night_min, 0e0), 0) AS BIGINT) AS late_night_min,
  CASE WHEN state = 'live' THEN CAST(round_even(coalesce(backspace_rate, 0e0) * 100e0, 0) AS BIGINT) ELSE 10 END AS corrections,
  CASE WHEN state = 'live' THEN CASE WHEN mental_battery >= 67 THEN 'Charged' WHEN mental_battery >= 40 THEN 'Holding' ELSE 'Low' END
    ELSE 'Charged' END AS status,
  CASE WHEN state = 'live' THEN coalesce(mental_battery - prior, 0) ELSE 0 END AS delta,
  CASE WHEN state = 'live' THEN burnout_risk ELSE 0 END AS burnout_risk,
  CASE state WHEN 'live' THEN tips WHEN 'learning' THEN 'Still learning your rhythm — about ' || act ||
    ' of 20 minutes of activity measured today. Your reading settles once there''s enough.'
    ELSE 'Your baseline is set — the app will learn your rhythm as you go.' END AS tips FROM j""")
def dashboard(spark, sf):
    board = ops.dashboard(daily(spark, sf), users(spark, sf), _now())
    return board.withColumn("tips", F.array_join("suggestions", " | ")).drop("suggestions")


@query("battery_delta", f"""WITH {DAILY} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, mental_battery,
  coalesce(mental_battery - lag(mental_battery) OVER (PARTITION BY user_id ORDER BY day), 0) AS delta FROM daily""")
def battery_delta(spark, sf):
    return ops.battery_delta(daily(spark, sf)).withColumn("day", _day())


@query("battery_label", f"""WITH {DAILY} SELECT CASE WHEN mental_battery >= 67 THEN 'Charged' WHEN mental_battery >= 40
  THEN 'Holding' ELSE 'Low' END AS label, count(*) AS days FROM daily GROUP BY 1""")
def battery_label(spark, sf):
    return daily(spark, sf).groupBy(ops.battery_label(F.col("mental_battery")).alias("label")).agg(
        F.count("*").alias("days"))


@query("weekly_trend", f"""WITH {DAILY}, {USERS}, {_WEEK}, spine AS (SELECT user_id,
  CAST(unnest(generate_series({_DAY} - 6, {_DAY}, INTERVAL 1 DAY)) AS DATE) AS day FROM users)
  SELECT s.user_id, strftime(s.day, '%Y-%m-%d') AS day, w.focus_score AS focus,
  CASE WHEN w.user_id IS NOT NULL THEN CAST(round_even(coalesce(w.tab_switches, 0e0), 0) AS BIGINT) END AS tabs
  FROM spine s LEFT JOIN week w ON s.user_id = w.user_id AND s.day = w.day""")
def weekly_trend(spark, sf):
    return ops.weekly_trend(daily(spark, sf), users(spark, sf), _now()).withColumn("day", _day())


@query("weekly_arrays", f"""WITH {DAILY}, {USERS}, {_WEEK}, spine AS (SELECT user_id,
  CAST(unnest(generate_series({_DAY} - 6, {_DAY}, INTERVAL 1 DAY)) AS DATE) AS day FROM users)
  SELECT s.user_id, string_agg(coalesce(CAST(w.focus_score AS VARCHAR), '-'), ',' ORDER BY s.day) AS trend,
  string_agg(coalesce(CAST(CAST(round_even(CASE WHEN w.user_id IS NOT NULL THEN coalesce(w.tab_switches, 0e0) END, 0) AS BIGINT)
  AS VARCHAR), '-'), ',' ORDER BY s.day) AS bars
  FROM spine s LEFT JOIN week w ON s.user_id = w.user_id AND s.day = w.day GROUP BY s.user_id HAVING count(w.user_id) > 0
  UNION ALL SELECT user_id, '', '' FROM users WHERE user_id NOT IN (SELECT user_id FROM week)""")
def weekly_arrays(spark, sf):
    side = ops.weekly_arrays(ops.weekly_trend(daily(spark, sf), users(spark, sf), _now()))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "-").alias(c)
    return side.select("user_id", joined("trend"), joined("bars"))


_CHANGE = """CASE WHEN count(*) >= 2 THEN CAST(round_even(CAST(arg_max(focus_score, day) - arg_min(focus_score, day) AS DOUBLE)
  / greatest(arg_min(focus_score, day), 1) * 100e0, 0) AS BIGINT) ELSE 0 END"""


@query("week_change", f"""WITH {DAILY}, {USERS}, {_WEEK}, c AS (SELECT user_id, {_CHANGE} AS change FROM week GROUP BY user_id)
  SELECT user_id, coalesce(change, 0) AS week_change FROM users LEFT JOIN c USING (user_id)""")
def week_change(spark, sf):
    return ops.week_change(daily(spark, sf), users(spark, sf), _now())


_WORST = "worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mental_battery, day) AS rk FROM week) WHERE rk = 1)"
_TIPS = """array_to_string(list_transform(string_split(tips, ' | ')[1:3],
  lambda s: substr(string_split(s, ' — ')[1], 1, 40) || '=' || s), ' / ')"""


@query("worst_day_tips", f"WITH {DAILY}, {_WEEK}, {_WORST} SELECT user_id, {_TIPS} AS tips FROM worst")
def worst_day_tips(spark, sf):
    return ops.worst_day_tips(daily(spark, sf), _now()).select("user_id", _tips().alias("tips"))


def _tips():
    return F.array_join(F.transform("tips", lambda t: F.concat(t["title"], F.lit("="), t["body"])), " / ")


@query("weekly_findings", f"""WITH {DAILY}, {USERS}, {_WEEK}, {_WORST}, a AS (SELECT user_id,
  CAST(round_even(avg(mental_battery), 0) AS BIGINT) AS avg_battery, CAST(round_even(avg(focus_score), 0) AS BIGINT) AS avg_focus,
  count_if(coalesce(late_night_min, 0) > 45) AS late_nights, {_CHANGE} AS change FROM week GROUP BY user_id),
  t AS (SELECT user_id, {_TIPS} AS tips FROM worst)
  SELECT u.user_id, avg_battery, avg_focus, late_nights, coalesce('Your focus ' || CASE WHEN change >= 0 THEN 'climbed' ELSE 'dipped' END
  || ' ' || abs(change) || ' percent across the week. Your battery averaged ' || avg_battery || '%, and you logged ' || late_nights
  || ' late night' || CASE WHEN late_nights != 1 THEN 's' ELSE '' END || '. The app keeps watching the rhythm, not the words.', '')
  AS narrative, t.tips, avg_battery IS NULL AS empty
  FROM users u LEFT JOIN a USING (user_id) LEFT JOIN t USING (user_id)""")
def weekly_findings(spark, sf):
    return ops.weekly_findings(daily(spark, sf), users(spark, sf), _now()).withColumn(
        "tips", F.when(F.col("tips").isNotNull(), _tips()))


@query("month_days", f"""WITH {USERS} SELECT user_id, strftime(unnest(generate_series(DATE '2024-01-01', {_DAY}, INTERVAL 1 DAY)),
  '%Y-%m-%d') AS day FROM users""")
def month_days(spark, sf):
    return ops.month_days(users(spark, sf), _YEAR, _MONTH, _now()).withColumn("day", _day())


_IN = f"BETWEEN DATE '2024-01-01' AND {_DAY}"
_METRICS = f"""metrics AS (SELECT user_id, count(*) AS days_tracked, CAST(round_even(avg(mental_battery), 0) AS BIGINT) AS avg_battery,
  CAST(round_even(avg(focus_score), 0) AS BIGINT) AS avg_focus FROM daily WHERE day {_IN} GROUP BY user_id)"""
_EVENTS = f"""monthly AS (SELECT user_id, count(*) AS moments_count, count_if(level = 'crisis') AS crisis_count
  FROM history WHERE CAST(ts AS DATE) {_IN} GROUP BY user_id)"""
_CALM = f"""marked AS (SELECT user_id, day, max(tracked) AS tracked, max(flagged) AS flagged FROM (
  SELECT user_id, day, 1 AS tracked, 0 AS flagged FROM daily WHERE day {_IN}
  UNION ALL SELECT user_id, CAST(ts AS DATE), 0, 1 FROM history WHERE level IN ('moderate', 'high', 'crisis') AND CAST(ts AS DATE) {_IN})
  GROUP BY user_id, day), runs AS (SELECT *, sum(flagged) OVER (PARTITION BY user_id ORDER BY day) AS run FROM marked),
  calm AS (SELECT user_id, max(n) AS calm_streak_days FROM (SELECT user_id, run, count_if(tracked = 1 AND flagged = 0) AS n
  FROM runs GROUP BY user_id, run) GROUP BY user_id)"""
_CHATS = f"""archived AS (SELECT user_id, role, max(ts) OVER (PARTITION BY thread_id) AS thread_ts FROM chat WHERE thread_id % 2 = 0),
  talk AS (SELECT user_id, count(*) AS chat_message_count FROM (
  SELECT user_id FROM chat WHERE thread_id % 2 = 1 AND role = 'user' AND CAST(ts AS DATE) {_IN}
  UNION ALL SELECT user_id FROM archived WHERE role = 'user' AND CAST(thread_ts AS DATE) {_IN}) GROUP BY user_id)"""
_LABEL = """(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END) || CASE WHEN {h} < 12 OR {h} = 24 THEN ' AM' ELSE ' PM' END"""
_HOURS = f"""hours AS (SELECT user_id, h, count, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, first) AS pos FROM (
  SELECT user_id, hour(ts) AS h, count(*) AS count, min(seq) AS first FROM history WHERE CAST(ts AS DATE) {_IN} GROUP BY ALL)),
  top_hours AS (SELECT user_id, pos, {_LABEL.format(h='h')} || ' – ' || {_LABEL.format(h='(h + 1)')} AS label, count FROM hours WHERE pos <= 3)"""
_APPS = f"""apps AS (SELECT user_id, app, seconds, row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, first, app) AS pos FROM (
  SELECT user_id, app, sum(seconds) AS seconds, min(row(day, first_seq)) AS first FROM app_usage WHERE day {_IN} GROUP BY ALL)),
  top_apps AS (SELECT user_id, pos, app, CAST(round_even(CAST(seconds AS DOUBLE) / 60e0, 0) AS BIGINT) AS minutes FROM apps WHERE pos <= 3)"""


@query("month_metrics", f"WITH {DAILY}, {_METRICS} SELECT user_id, days_tracked, avg_battery, avg_focus FROM metrics")
def month_metrics(spark, sf):
    return ops.month_metrics(daily(spark, sf), _YEAR, _MONTH, _now())


@query("month_events", f"WITH {HISTORY}, {_EVENTS} SELECT user_id, moments_count, crisis_count FROM monthly")
def month_events(spark, sf):
    return ops.month_events(history(spark, sf), _YEAR, _MONTH, _now())


@query("calm_streak", f"WITH {DAILY}, {HISTORY}, {_CALM} SELECT user_id, calm_streak_days FROM calm")
def calm_streak(spark, sf):
    return ops.calm_streak(daily(spark, sf), history(spark, sf), _YEAR, _MONTH, _now())


def _archived(spark, sf):
    """Even threads stand for the archive; a thread is archived at its last turn."""
    turns = chat(spark, sf).where("thread_id % 2 = 0")
    return turns.select("user_id", "role", F.max("ts").over(Window.partitionBy("thread_id")).alias("thread_ts"))


@query("month_chat", f"WITH {CHAT}, {_CHATS} SELECT user_id, chat_message_count FROM talk")
def month_chat(spark, sf):
    active = chat(spark, sf).where("thread_id % 2 = 1")
    return ops.month_chat(active, _archived(spark, sf), _YEAR, _MONTH, _now())


@query("top_hours", f"WITH {HISTORY}, {_HOURS} SELECT user_id, pos, label, count FROM top_hours")
def top_hours(spark, sf):
    return ops.top_hours(history(spark, sf), _YEAR, _MONTH, _now())


def usage(spark, sf):
    from tidewell.operators.behavior import merge_app_usage
    return merge_app_usage(app_rows(spark, sf), settings(spark, sf))


@query("top_apps", f"WITH {APP_USAGE}, {_APPS} SELECT user_id, pos, app, minutes FROM top_apps")
def top_apps(spark, sf):
    return ops.top_apps(usage(spark, sf), settings(spark, sf), _YEAR, _MONTH, _now())


@query("monthly_wrap", f"""WITH {DAILY}, {HISTORY}, {SETTINGS}, {CHAT}, {APP_USAGE}, {_METRICS}, {_EVENTS}, {_CALM}, {_CHATS}, {_HOURS}, {_APPS},
  h AS (SELECT user_id, string_agg(label || '=' || count, ', ' ORDER BY pos) AS hours FROM top_hours GROUP BY user_id),
  a AS (SELECT user_id, string_agg(app || '=' || minutes, ', ' ORDER BY pos) AS apps FROM top_apps GROUP BY user_id)
  SELECT s.user_id, 2024 AS year, 1 AS month, coalesce(days_tracked, 0) AS days_tracked, 30 AS days_in_range,
  coalesce(days_tracked, 0) = 0 AND coalesce(moments_count, 0) = 0 AND coalesce(chat_message_count, 0) = 0 AND apps IS NULL AS empty,
  avg_battery, avg_focus, coalesce(moments_count, 0) AS moments_count, coalesce(crisis_count, 0) AS crisis_count,
  coalesce(calm_streak_days, 0) AS calm_streak_days, coalesce(chat_message_count, 0) AS chat_message_count,
  coalesce(hours, '') AS hours, coalesce(apps, '') AS apps, track_app_usage AS app_tracking_on
  FROM settings s LEFT JOIN metrics USING (user_id) LEFT JOIN monthly USING (user_id) LEFT JOIN calm USING (user_id)
  LEFT JOIN talk USING (user_id) LEFT JOIN h USING (user_id) LEFT JOIN a USING (user_id)""")
def monthly_wrap(spark, sf):
    wrap = ops.monthly_wrap(
        users(spark, sf), daily(spark, sf), history(spark, sf), chat(spark, sf).where("thread_id % 2 = 1"),
        _archived(spark, sf), usage(spark, sf), settings(spark, sf), _YEAR, _MONTH, _now())
    pairs = lambda c, key, value: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(
        x[key], F.lit("="), x[value].cast("string"))), ", "), F.lit(""))
    return wrap.withColumns({"hours": pairs("top_hours", "label", "count"),
                             "apps": pairs("top_apps", "app", "minutes")}).drop("top_hours", "top_apps")


@query("retain_days", f"""WITH {DAILY} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, focus_score FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM daily) WHERE k <= 14""")
def retain_days(spark, sf):
    return ops.retain_days(daily(spark, sf)).select("user_id", _day().alias("day"), "focus_score")
