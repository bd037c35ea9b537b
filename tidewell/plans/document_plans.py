"""User documents made of the supplied tables, taken apart again, and one user's export."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators.behavior import SIGNALS, merge_app_usage
from tidewell.plans.inputs import APP_USAGE, DAILY, HISTORY, SETTINGS, app_rows, daily, history, settings
from tidewell.plans.registry import query
from tidewell.sources import documents as docs


def _day(column="day"):
    return F.date_format(column, "yyyy-MM-dd")


def user_docs(spark, sf):
    """A document per user: settings, days, events and app usage as the files hold them; what a user lacks is left out."""
    events = history(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "layer", "level", "category"))).alias("e")).select(
        "user_id", F.transform("e", lambda e: F.struct(e["ts"].alias("ts"), e["layer"].alias("layer"), e["level"].alias("level"), e["category"].alias("category"))).alias("events"))
    metrics = ("mental_battery", "focus_score", "burnout_risk", "status", "suggestions")
    tracked = F.struct(F.struct(*SIGNALS).alias("signals"), F.struct(*metrics).alias("metrics"))
    days = daily(spark, sf).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(_day(), tracked))).alias("days"))
    apps = merge_app_usage(app_rows(spark, sf), settings(spark, sf)).groupBy("user_id", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("app", F.col("seconds").cast("double")))).alias("apps"))
    usage = apps.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(_day(), "apps"))).alias("app_usage"))
    own = settings(spark, sf).select("user_id", F.struct("name", "contact", "toggles", "track_app_usage", "popup_policy", F.lit(None).cast("boolean").alias("onboarded")).alias("settings"))
    empty = spark.createDataFrame([], docs.DOCUMENT_SCHEMA).schema
    joined = own.join(days, "user_id", "left").join(events, "user_id", "left").join(usage, "user_id", "left")
    return docs.with_defaults(joined.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty if f.name not in joined.columns}))


@query("explode_docs", f"""WITH {DAILY}, {HISTORY}, {SETTINGS}, {APP_USAGE}
  SELECT 'settings' AS part, user_id, name AS key, popup_policy || ' ' || t_trend AS value FROM settings
  UNION ALL SELECT 'daily', user_id, strftime(day, '%Y-%m-%d'), mental_battery || ' ' || status FROM daily
  UNION ALL SELECT 'events', user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS VARCHAR), layer || ' ' || level || ' ' || epoch_us(ts) FROM history
  UNION ALL SELECT 'app_usage', user_id, strftime(day, '%Y-%m-%d') || ' ' || app, CAST(CAST(round(seconds) AS BIGINT) AS VARCHAR) FROM app_usage""")
def explode_docs(spark, sf):
    tables = docs.explode_docs(user_docs(spark, sf))
    parts = (
        tables.settings.select(F.lit("settings").alias("part"), "user_id", F.col("name").alias("key"), F.concat_ws(" ", "popup_policy", F.col("toggles")["trend"].cast("string")).alias("value")),
        tables.daily.select(F.lit("daily"), "user_id", _day(), F.concat_ws(" ", F.col("mental_battery").cast("string"), "status")),
        tables.events.select(F.lit("events"), "user_id", F.col("seq").cast("string"), F.concat_ws(" ", F.col("layer").cast("string"), "level", F.unix_micros("ts").cast("string"))),
        tables.app_usage.select(F.lit("app_usage"), "user_id", F.concat_ws(" ", _day(), "app"), F.round("seconds").cast("long").cast("string")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_EXPORTED = 7


@query("export_user", f"""WITH {HISTORY}, {APP_USAGE.replace('user_id % 2 = 0', 'true')}
  SELECT 'events' AS section, CAST(to_json({{'user_id': user_id, 'seq': seq, 'layer': layer, 'level': level, 'category': category}}) AS VARCHAR) AS line FROM history WHERE user_id = {_EXPORTED}
  UNION ALL SELECT 'app_usage', CAST(to_json({{'user_id': user_id, 'day': strftime(day, '%Y-%m-%d'), 'app': app}}) AS VARCHAR) FROM app_usage WHERE user_id = {_EXPORTED}""")
def export_user(spark, sf):
    everyone = settings(spark, sf).withColumn("track_app_usage", F.lit(True))
    usage = merge_app_usage(app_rows(spark, sf), everyone).select("user_id", _day().alias("day"), "app")
    return docs.export_user({"events": history(spark, sf).drop("ts"), "app_usage": usage}, _EXPORTED)
