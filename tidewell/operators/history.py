"""Event history: retention, streak, gate, timeline, counters, settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.levels import severity_rank
from tidewell.functions.ordered import top_per_key

EVENT_COLUMNS = ("user_id", "seq", "ts", "layer", "level", "category")
# Names of the detection layers.
LAYER_LABELS = {1: "Keyword", 2: "Semantic", 3: "Behavioral", 4: "Trend gate"}
TOGGLES = ("keyword", "semantic", "behavioral", "trend")
# How much history is kept.
KEPT = {"events": 500, "chat": 200, "threads": 50, "runs": 200, "simulator": 100}


def to_events(df: DataFrame) -> DataFrame:
    """The message-free history columns and nothing else, at whole seconds."""
    return df.select(*EVENT_COLUMNS).withColumn("ts", F.date_trunc("second", "ts"))


def retain_last(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last `n` rows of each key."""
    return top_per_key(df, by, [F.col(c).desc() for c in order], n, spread=order)


def _seen(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    return events.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= as_of))


def trend_streak(events: DataFrame, as_of: Column) -> DataFrame:
    """Distinct days of the last seven that carry a flagged event."""
    return _seen(events, as_of, 7).where(severity_rank("level") >= 1).groupBy("user_id").agg(
        F.count_distinct(F.to_date("ts")).alias("streak"))


def gate_days(events: DataFrame, as_of: Column) -> DataFrame:
    """Per user and day of the last seven: flagged or not, and layers and crises of the last four days."""
    recent = F.col("ts") >= as_of - F.expr("INTERVAL 4 DAYS")
    rank = severity_rank("level")
    return _seen(events, as_of, 7).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max((rank >= 1).cast("int")).alias("flagged"),
        F.max((recent & (rank >= 4)).cast("int")).alias("crisis"),
        F.bit_or(F.when(recent, F.call_function("shiftleft", F.lit(1), F.col("layer"))).otherwise(0)).alias("layer_bits"))


def gate_from_days(days: DataFrame, settings: DataFrame) -> DataFrame:
    """The gate per user from its day rows. Users without events are neither gentle nor urgent."""
    return gate_from_facts(days.groupBy("user_id").agg(
        F.sum("flagged").alias("streak"), F.max("crisis").alias("crisis"), F.bit_or("layer_bits").alias("bits")), settings)


def gate_from_facts(per_user: DataFrame, settings: DataFrame, how: str = "full_outer", also: Sequence[str] = ()) -> DataFrame:
    """The gate from streak, crisis (0/1) and layer bits per user, and the users' toggles. `also` names columns to carry."""
    prefs = settings.select("user_id", F.col("toggles")["trend"].alias("trend"))
    known = per_user.join(prefs, "user_id", how).select(
        "user_id", *also, F.coalesce("trend", F.lit(True)).alias("gate_ok"), F.coalesce("streak", F.lit(0)).alias("streak"),
        (F.coalesce("crisis", F.lit(0)) > 0).alias("crisis"), F.coalesce("bits", F.lit(0)).alias("bits"))
    layers = F.filter(F.array(*[F.lit(n) for n in (1, 2, 3, 4)]),
                      lambda n: F.getbit(F.col("bits"), n) == 1)
    all_three = F.col("bits").bitwiseAND(0b1110) == 0b1110
    content = F.col("bits").bitwiseAND(0b0110) != 0
    urgent = F.col("crisis") | (all_three & (F.col("streak") >= 4) & F.col("gate_ok"))
    return known.select("user_id", *also, "streak", layers.alias("layers"), urgent.alias("urgent"),
                        ((content | (F.col("streak") >= 2)) & ~urgent).alias("gentle"))


def trend_gate(events: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """gentle, urgent, streak and layers per user at `as_of`."""
    return gate_from_days(gate_days(events, as_of), settings)


def crisis_24h(events: DataFrame, as_of: Column) -> DataFrame:
    return _seen(events, as_of, 1).where(F.col("level") == "crisis").groupBy("user_id").agg(
        F.count("*").alias("crises"))


def recent_send(sends: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Last automatic note per user, and whether it is within the window."""
    return sends.groupBy("user_id").agg(F.max("ts").alias("last_sent")).withColumn(
        "recent", F.col("last_sent") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def moments(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest flagged events per user, formatted for a timeline."""
    flagged = events.where(F.coalesce("level", F.lit("none")) != "none")
    newest = top_per_key(flagged, ["user_id"], [F.col("seq").desc()], limit, spread=["seq"], rank="pos")
    category = F.replace(F.coalesce("category", F.lit("")), F.lit("_"), F.lit(" "))
    source = F.lit("Signal")
    for layer, label in LAYER_LABELS.items():
        source = F.when(F.col("layer") == layer, label).otherwise(source)
    return newest.select(
        "user_id", "pos", F.date_format("ts", "MMM dd").alias("date"), F.date_format("ts", "h:mm a").alias("time"),
        "level", F.when(category.isin("", "none"), "general concern").otherwise(category).alias("category"),
        source.alias("source"))


def status(events: DataFrame, daily: DataFrame, as_of: Column) -> DataFrame:
    """Counters per user: events, tracked days, last day, last event, streak."""
    counted = events.groupBy("user_id").agg(
        F.count("*").alias("events"), F.max_by("ts", "seq").alias("last_event"))
    tracked = daily.groupBy("user_id").agg(F.count_distinct("day").alias("days_tracked"), F.max("day").alias("last_day"))
    return (
        counted.join(tracked, "user_id", "full_outer").join(trend_streak(events, as_of), "user_id", "left")
        .select("user_id", F.coalesce("events", F.lit(0)).alias("events"),
                F.coalesce("days_tracked", F.lit(0)).alias("days_tracked"), "last_day", "last_event",
                F.coalesce("streak", F.lit(0)).alias("streak"))
    )


def merge_settings(patches: DataFrame, toggles: Sequence[str] = TOGGLES,
                   default_contact: str = "School Counselor <counselor@school.edu>") -> DataFrame:
    """Current settings per user: the last given value of every key, defaults for the rest; unknown toggles stay."""
    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))

    merged = patches.groupBy("user_id").agg(
        *[last(F.col(c)).alias(c) for c in ("name", "contact", "onboarded", "track_app_usage", "popup_policy")])
    given = patches.select("user_id", "seq", F.explode("toggles").alias("key", "value")).where("value IS NOT NULL")
    named = given.groupBy("user_id", "key").agg(F.max_by("value", "seq").alias("value")).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_given"))
    known = F.create_map(*[x for t in toggles for x in (F.lit(t), F.lit(True))])
    own = F.coalesce("_given", F.create_map().cast("map<string,boolean>"))
    rest = F.map_filter(known, lambda k, _: ~F.map_contains_key(own, k))
    return merged.join(named, "user_id", "left").select(
        "user_id", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("contact", F.lit(default_contact)).alias("contact"),
        F.coalesce("onboarded", F.lit(False)).alias("onboarded"), F.map_concat(rest, own).alias("toggles"),
        F.coalesce("track_app_usage", F.lit(False)).alias("track_app_usage"),
        F.when(F.col("popup_policy") == "everything", "everything").otherwise("balanced").alias("popup_policy"))


def user_state(settings: DataFrame, dashboard: DataFrame, gate: DataFrame, chat_turns: DataFrame) -> DataFrame:
    """Everything an app needs to open, one row per user; `chat` holds the retained turns (at most 200) in order."""
    newest = top_per_key(chat_turns, ["user_id"], [F.col("seq").desc()], KEPT["chat"], spread=["seq"])
    turn = F.struct("seq", "ts", "role", "content")
    turns = newest.groupBy("user_id").agg(
        F.count("*").alias("chat_turns"), F.max("ts").alias("last_chat"), F.array_sort(F.collect_list(turn)).alias("chat"))
    return (settings.join(dashboard, "user_id", "left").join(gate, "user_id", "left").join(turns, "user_id", "left")
            .withColumn("chat_turns", F.coalesce("chat_turns", F.lit(0))))
