"""Dashboard, weekly findings and the monthly recap.

`daily` holds one row per user and day: the six signals and the scored metrics. Raw events are
reduced to user-days before any per-user window, so a window never sees more than a user's days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.levels import round_half_even, severity_rank
from tidewell.functions.ordered import top_per_key
from tidewell.operators.behavior import BASELINE

MIN_ACTIVE_MINUTES = 20
# The reading shown when there is no trustworthy one. Nothing deviates at the baseline.
AT_BASELINE = {"mental_battery": 100, "focus_score": 100, "burnout_risk": 0}


def _whole(name: str) -> Column:
    return round_half_even(F.coalesce(F.col(name), F.lit(0.0)))


def battery_label(battery: Column) -> Column:
    return F.when(battery >= 67, "Charged").when(battery >= 40, "Holding").otherwise("Low")


def battery_delta(daily: DataFrame) -> DataFrame:
    """Battery against the previous tracked day, which need not be yesterday; 0 on the first."""
    by_day = Window.partitionBy("user_id").orderBy("day")
    before = F.lag("mental_battery").over(by_day)
    return daily.select("user_id", "day", "mental_battery",
                        F.coalesce(F.col("mental_battery") - before, F.lit(0)).alias("delta"))


def dashboard(daily: DataFrame, users: DataFrame, as_of: Column, product: str = "the app") -> DataFrame:
    """One row per user: `no_data`, `learning` (too little activity yet) or `live`."""
    today = F.to_date(as_of)
    cols = ["tab_switches", "late_night_min", "backspace_rate", "active_minutes",
            "mental_battery", "focus_score", "burnout_risk", "suggestions"]
    row = F.struct(*cols)
    per_user = daily.where(F.col("day") <= today).groupBy("user_id").agg(
        F.max_by(row, F.when(F.col("day") == today, F.col("day"))).alias("now"),
        F.max_by("mental_battery", F.when(F.col("day") < today, F.col("day"))).alias("before"))
    joined = users.select("user_id").join(per_user, "user_id", "left").select("user_id", "before", "now.*", (
        F.when(F.col("now").isNull(), "no_data")
        .when(F.coalesce("now.active_minutes", F.lit(0.0)) < MIN_ACTIVE_MINUTES, "learning")
        .otherwise("live")).alias("state"))
    live = F.col("state") == "live"
    active = _whole("active_minutes")

    def shown(name: str, held: int) -> Column:
        return F.when(live, F.col(name)).otherwise(held)

    learning = F.concat(
        F.lit("Still learning your rhythm — about "), active.cast("string"),
        F.lit(f" of {MIN_ACTIVE_MINUTES} minutes of activity measured today. "
              "Your reading settles once there's enough."))
    first = f"Your baseline is set — {product} will learn your rhythm as you go."
    return joined.select(
        "user_id", "state",
        shown("mental_battery", AT_BASELINE["mental_battery"]).alias("mental_battery"),
        shown("focus_score", AT_BASELINE["focus_score"]).alias("focus_score"),
        F.when(live, _whole("tab_switches")).otherwise(round(BASELINE["tab_switches"])).alias("tab_switches"),
        active.alias("active_minutes"), _whole("late_night_min").alias("late_night_min"),
        F.when(live, round_half_even(F.coalesce("backspace_rate", F.lit(0.0)) * 100))
        .otherwise(round(BASELINE["backspace_rate"] * 100)).alias("corrections"),
        F.when(live, battery_label(F.col("mental_battery"))).otherwise("Charged").alias("status"),
        F.when(live, F.coalesce(F.col("mental_battery") - F.col("before"), F.lit(0))).otherwise(0).alias("delta"),
        shown("burnout_risk", AT_BASELINE["burnout_risk"]).alias("burnout_risk"),
        F.when(live, F.col("suggestions")).when(F.col("state") == "learning", F.array(learning))
        .otherwise(F.array(F.lit(first))).alias("suggestions"))


def week_days(users: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    today = F.to_date(as_of)
    return users.select("user_id", F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))


def _last_week(daily: DataFrame, as_of: Column) -> DataFrame:
    today = F.to_date(as_of)
    return daily.where((F.col("day") > F.date_sub(today, 7)) & (F.col("day") <= today))


def weekly_trend(daily: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Focus and tab bars of the last seven days, gaps as null; long form, one row per user and day."""
    week = _last_week(daily, as_of).select("user_id", "day", F.col("focus_score").alias("focus"),
                                           _whole("tab_switches").alias("tabs"))
    return week_days(users, as_of).join(week, ["user_id", "day"], "left")


def weekly_arrays(trend: DataFrame) -> DataFrame:
    """The seven days of each user side by side; no days at all, and `empty`, where none was tracked."""
    ordered = F.array_sort(F.collect_list(F.struct("day", "focus", "tabs")))
    days = trend.groupBy("user_id").agg(ordered.alias("_days"), (F.count("focus") == 0).alias("empty"))

    def shown(name: str) -> Column:
        return F.when(F.col("empty"), F.array().cast("array<bigint>")).otherwise(F.col(f"_days.{name}"))
    return days.select("user_id", shown("focus").alias("trend"), shown("tabs").alias("bars"), "empty")


def _change(first: Column, last: Column, present: Column) -> Column:
    return F.when(present >= 2, round_half_even((last - first) / F.greatest(first, F.lit(1)) * 100)).otherwise(0)


def week_change(daily: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Percent change of focus between the first and last tracked day of the week; 0 with fewer than two."""
    known = _last_week(daily, as_of).groupBy("user_id").agg(
        _change(F.min_by("focus_score", "day"), F.max_by("focus_score", "day"), F.count("*")).alias("week_change"))
    return users.select("user_id").join(known, "user_id", "left").withColumn("week_change", F.coalesce("week_change", F.lit(0)))


def tip_titles(suggestions: Column) -> Column:
    """First three suggestions as (title, body): the title ends at the dash, at 40 characters at most."""
    return F.transform(F.slice(suggestions, 1, 3), lambda s: F.struct(
        F.substring(F.substring_index(s, " — ", 1), 1, 40).alias("title"), s.alias("body")))


def worst_day_tips(daily: DataFrame, as_of: Column) -> DataFrame:
    """Suggestions of the lowest-battery day of the week; the earliest wins ties."""
    return _last_week(daily, as_of).groupBy("user_id").agg(
        tip_titles(F.min_by("suggestions", F.struct("mental_battery", "day"))).alias("tips"))


def weekly_findings(daily: DataFrame, users: DataFrame, as_of: Column, product: str = "The app",
                    late_minutes: float = 45.0) -> DataFrame:
    """Averages, late nights and a narrative per user; users without a tracked day are `empty`."""
    summed = _last_week(daily, as_of).groupBy("user_id").agg(
        round_half_even(F.avg("mental_battery")).alias("avg_battery"),
        round_half_even(F.avg("focus_score")).alias("avg_focus"),
        F.count_if(F.coalesce("late_night_min", F.lit(0.0)) > late_minutes).alias("late_nights"),
        _change(F.min_by("focus_score", "day"), F.max_by("focus_score", "day"), F.count("*")).alias("_change"),
        tip_titles(F.min_by("suggestions", F.struct("mental_battery", "day"))).alias("tips"))
    joined = users.select("user_id").join(summed, "user_id", "left")
    late = F.col("late_nights")
    narrative = F.concat(
        F.lit("Your focus "), F.when(F.col("_change") >= 0, "climbed").otherwise("dipped"), F.lit(" "),
        F.abs("_change").cast("string"), F.lit(" percent across the week. Your battery averaged "),
        F.col("avg_battery").cast("string"), F.lit("%, and you logged "), late.cast("string"),
        F.lit(" late night"), F.when(late != 1, "s").otherwise(""),
        F.lit(f". {product} keeps watching the rhythm, not the words."))
    return joined.select(
        "user_id", "avg_battery", "avg_focus", "late_nights", F.coalesce(narrative, F.lit("")).alias("narrative"),
        "tips", F.col("avg_battery").isNull().alias("empty"))


def month_bounds(year: int, month: int, as_of: Column) -> tuple[Column, Column]:
    """First day of the month and its last day, or `as_of` if that comes first."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return first, F.least(F.last_day(first), F.to_date(as_of))


def month_days(users: DataFrame, year: int, month: int, as_of: Column) -> DataFrame:
    """Users x days of the month so far. Empty for a month that has not begun."""
    first, last = month_bounds(year, month, as_of)
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return users.select("user_id", F.explode(days).alias("day"))


def _in_month(df: DataFrame, day: Column, year: int, month: int, as_of: Column) -> DataFrame:
    first, last = month_bounds(year, month, as_of)
    return df.where((day >= first) & (day <= last))


def month_metrics(daily: DataFrame, year: int, month: int, as_of: Column) -> DataFrame:
    return _in_month(daily, F.col("day"), year, month, as_of).groupBy("user_id").agg(
        F.count("*").alias("days_tracked"), round_half_even(F.avg("mental_battery")).alias("avg_battery"),
        round_half_even(F.avg("focus_score")).alias("avg_focus"))


def month_events(events: DataFrame, year: int, month: int, as_of: Column) -> DataFrame:
    return _in_month(events, F.to_date("ts"), year, month, as_of).groupBy("user_id").agg(
        F.count("*").alias("moments_count"), F.count_if(F.col("level") == "crisis").alias("crisis_count"))


def calm_streak(daily: DataFrame, events: DataFrame, year: int, month: int, as_of: Column) -> DataFrame:
    """Longest run of tracked days without a moderate event; untracked days neither count nor reset."""
    tracked = _in_month(daily, F.col("day"), year, month, as_of).select(
        "user_id", "day", F.lit(1).alias("tracked"), F.lit(0).alias("flagged"))
    flagged = _in_month(events.where(severity_rank("level") >= 2), F.to_date("ts"), year, month, as_of).select(
        "user_id", F.to_date("ts").alias("day"), F.lit(0).alias("tracked"), F.lit(1).alias("flagged"))
    days = tracked.unionByName(flagged).groupBy("user_id", "day").agg(
        F.max("tracked").alias("tracked"), F.max("flagged").alias("flagged"))
    so_far = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    runs = days.withColumn("_run", F.sum("flagged").over(so_far)).groupBy("user_id", "_run").agg(
        F.count_if((F.col("tracked") == 1) & (F.col("flagged") == 0)).alias("calm"))
    return runs.groupBy("user_id").agg(F.max("calm").alias("calm_streak_days"))


def month_chat(chat: DataFrame, archived: DataFrame, year: int, month: int, as_of: Column) -> DataFrame:
    """User messages: active ones sent in the month, and all of the threads archived in it.

    `archived` holds one row per message: (user_id, thread_ts, role).
    """
    active = _in_month(chat, F.to_date("ts"), year, month, as_of).where(F.col("role") == "user").select("user_id")
    stored = _in_month(archived, F.to_date("thread_ts"), year, month, as_of).where(
        F.col("role") == "user").select("user_id")
    return active.unionAll(stored).groupBy("user_id").agg(F.count("*").alias("chat_message_count"))


def hour_label(hour: Column) -> Column:
    def clock(h: Column) -> Column:
        twelve = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
        return F.concat(twelve, F.when((h < 12) | (h == 24), " AM").otherwise(" PM"))

    return F.concat(clock(hour), F.lit(" – "), clock(hour + 1))


def top_hours(events: DataFrame, year: int, month: int, as_of: Column, n: int = 3) -> DataFrame:
    """Busiest hours of the day per user; ties go to the hour seen first."""
    counted = _in_month(events, F.to_date("ts"), year, month, as_of).groupBy(
        "user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("count"), F.min("seq").alias("_first"))
    by_count = Window.partitionBy("user_id").orderBy(F.desc("count"), "_first")
    return counted.withColumn("pos", F.row_number().over(by_count)).where(F.col("pos") <= n).select(
        "user_id", "pos", hour_label(F.col("hour")).alias("label"), "count")


def _top_apps(usage: DataFrame, year: int, month: int, as_of: Column, n: int = 3) -> DataFrame:
    seen = F.struct("day", "first_seq") if "first_seq" in usage.columns else F.struct("day")
    totals = _in_month(usage, F.col("day"), year, month, as_of).groupBy("user_id", "app").agg(
        F.sum("seconds").alias("seconds"), F.min(seen).alias("_first"))
    top = top_per_key(totals, ["user_id"], [F.desc("seconds"), F.col("_first"), F.col("app")], n, spread=["app"], rank="pos")
    return top.select("user_id", "pos", "app", round_half_even(F.col("seconds") / 60).alias("minutes"))


def top_apps(usage: DataFrame, settings: DataFrame, year: int, month: int, as_of: Column, n: int = 3) -> DataFrame:
    """Most used apps of opted-in users in minutes; ties go to the app used first."""
    opted_in = settings.where("track_app_usage").select("user_id")
    return _top_apps(usage.join(opted_in, "user_id", "left_semi"), year, month, as_of, n)


def month_facts(daily: DataFrame, events: DataFrame, year: int, month: int, as_of: Column, n: int = 3) -> DataFrame:
    """Metrics, events, calm streak and busiest hours of the month in one row per user; one pass over each input.

    Events become one row per user, day and hour, these and the tracked days one row per user and day, and a user's at most 31 of those one row.
    """
    day = F.to_date("ts")
    hourly = _in_month(events, day, year, month, as_of).groupBy("user_id", day.alias("day"), F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("level") == "crisis").alias("crises"),
        F.max((severity_rank("level") >= 2).cast("int")).alias("flagged"), F.min("seq").alias("first"))
    tracked = _in_month(daily, F.col("day"), year, month, as_of).select(
        "user_id", "day", F.lit(1).alias("tracked"), F.col("mental_battery").alias("battery"), F.col("focus_score").alias("focus"))
    heard = hourly.select("user_id", "day", "n", "crises", "flagged", F.struct("hour", "n", "first").alias("slot"))
    days = heard.unionByName(tracked, allowMissingColumns=True).groupBy("user_id", "day").agg(
        F.sum("tracked").alias("tracked"), F.sum("battery").alias("battery"), F.sum("focus").alias("focus"),
        F.max("flagged").alias("flagged"), F.sum("n").alias("n"), F.sum("crises").alias("crises"), F.collect_list("slot").alias("slots"))
    per_user = days.groupBy("user_id").agg(
        F.coalesce(F.sum("tracked"), F.lit(0)).alias("days_tracked"),
        round_half_even(F.sum("battery") / F.sum("tracked")).alias("avg_battery"), round_half_even(F.sum("focus") / F.sum("tracked")).alias("avg_focus"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("moments_count"), F.coalesce(F.sum("crises"), F.lit(0)).alias("crisis_count"),
        F.array_sort(F.collect_list(F.struct("day", (F.coalesce("flagged", F.lit(0)) == 1).alias("flagged"), F.coalesce("tracked", F.lit(0)).alias("tracked")))).alias("_days"),
        F.flatten(F.collect_list("slots")).alias("_slots"))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def live(state: Column, d: Column) -> Column:
        run = F.when(d["flagged"], F.lit(0).cast("long")).otherwise(state["run"] + d["tracked"])
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    def total(hour: Column) -> Column:
        own = F.filter("_slots", lambda s: s["hour"] == hour)
        count = F.aggregate(own, F.lit(0).cast("long"), lambda n, s: n + s["n"])
        return F.struct((-count).alias("less"), F.array_min(F.transform(own, lambda s: s["first"])).alias("first"), hour.alias("hour"))

    hours = F.array_sort(F.transform(F.array_distinct(F.transform("_slots", lambda s: s["hour"])), total))
    top = F.transform(F.slice(hours, 1, n), lambda h, i: F.struct(
        (i + 1).alias("pos"), hour_label(h["hour"]).alias("label"), (-h["less"]).alias("count")))
    return per_user.select(
        "user_id", "days_tracked", "avg_battery", "avg_focus", "moments_count", "crisis_count",
        F.aggregate("_days", start, live, lambda state: state["best"]).alias("calm_streak_days"), F.when(F.size("_slots") > 0, top).alias("top_hours"))


def monthly_wrap(users: DataFrame, daily: DataFrame, events: DataFrame, chat: DataFrame, archived: DataFrame,
                 usage: DataFrame, settings: DataFrame, year: int, month: int, as_of: Column) -> DataFrame:
    """The month in one row per user. Every part is one row per user before it is joined, and every input is read once."""
    tracking = settings.select("user_id", F.col("track_app_usage").alias("app_tracking_on"))
    apps = _top_apps(usage, year, month, as_of).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "app", "minutes"))).alias("top_apps"))
    joined = users.select("user_id")
    for part in (month_facts(daily, events, year, month, as_of), month_chat(chat, archived, year, month, as_of), apps, tracking):
        joined = joined.join(part, "user_id", "left")
    first, last = month_bounds(year, month, as_of)
    counts = ["days_tracked", "moments_count", "crisis_count", "calm_streak_days", "chat_message_count"]
    filled = joined.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "top_apps": F.when(F.col("app_tracking_on"), F.col("top_apps"))})
    nothing = ((F.col("days_tracked") == 0) & (F.col("moments_count") == 0) & (F.col("chat_message_count") == 0)
               & F.col("top_apps").isNull())
    return filled.select(
        "user_id", F.lit(year).alias("year"), F.lit(month).alias("month"), "days_tracked",
        F.greatest(F.datediff(last, first) + 1, F.lit(0)).alias("days_in_range"), nothing.alias("empty"),
        "avg_battery", "avg_focus", "moments_count", "crisis_count", "calm_streak_days", "chat_message_count",
        "top_hours", "top_apps", F.coalesce("app_tracking_on", F.lit(False)).alias("app_tracking_on"))


def retain_days(daily: DataFrame, days: int = 14) -> DataFrame:
    """The last `days` tracked days of each user."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("day"))
    return daily.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= days).drop("_n")
