"""Rhythm signals against a baseline -> battery, focus, burnout, suggestions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.levels import clamp, round_half_even

# The baseline signals.
BASELINE = {
    "tab_switches": 25.0, "late_night_min": 15.0, "avg_session_min": 50.0,
    "interruptions": 10.0, "backspace_rate": 0.10,
}
# Labels and order of the delta rows.
DELTA_LABELS = {
    "tab_switches": "Tab switching", "late_night_min": "Late-night activity",
    "interruptions": "Interruptions", "avg_session_min": "Avg session length",
    "backspace_rate": "Correction typing",
}
# Suggestions, in the order in which they are given.
TIPS = {
    "marathon": "You've been locked in for hours without a break — stand up and stretch for five.",
    "late": "Wind down earlier — your late-night activity is well above your usual.",
    "tabs": "Reduce multitasking — try a single-tab focus session.",
    "interruptions": "Batch your notifications and protect one uninterrupted focus block.",
    "corrections": "Lots of corrections lately — a short break can reset your focus.",
    "fragmented": "Your sessions are fragmented — try one 25-minute focused block.",
    "steady": "You're tracking close to your healthy baseline. Keep it steady.",
}
STRAIN_THRESHOLD = 55


def fill_baseline(signals: DataFrame, baseline: Mapping[str, float] = BASELINE) -> DataFrame:
    """Absent signals take their baseline value, as `s_<signal>`."""
    return signals.withColumns({f"s_{k}": F.coalesce(F.col(k), F.lit(v)) for k, v in baseline.items()})


def excess(value: Column, base: float) -> Column:
    return F.greatest(F.lit(0.0), (value - base) / base) if base > 0 else F.lit(0.0)


def shortfall(value: Column, base: float) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(base) - value) / base) if base > 0 else F.lit(0.0)


def confidence(active: Column) -> Column:
    """Trust in the rates: 1 when active time is absent, else growing to 1 over 45 minutes."""
    return F.when(active.isNull(), 1.0).otherwise(F.least(F.lit(1.0), active / 45.0))


def marathon(session: Column, active: Column) -> Column:
    """Penalty for hours without a break."""
    glued = F.when(session > 120, F.least(F.lit(15.0), (session - 120) / 120 * 15.0)).otherwise(0.0)
    total = F.when(active > 240, F.least(F.lit(12.0), (active - 240) / 240 * 12.0)).otherwise(0.0)
    return glued + total


def burnout(late: Column, tabs: Column, intr: Column, back: Column, frag: Column, hours: Column) -> Column:
    capped = (F.least(F.lit(25.0), late * 25.0) + F.least(F.lit(25.0), tabs * 20.0)
              + F.least(F.lit(15.0), intr * 18.0) + F.least(F.lit(15.0), back * 18.0)
              + F.least(F.lit(20.0), frag * 25.0) + hours)
    return round_half_even(clamp(capped, 0.0, 100.0))


def focus(tabs: Column, intr: Column, frag: Column) -> Column:
    return round_half_even(clamp(
        F.lit(100.0) - F.least(F.lit(35.0), tabs * 28.0) - F.least(F.lit(30.0), intr * 30.0)
        - F.least(F.lit(25.0), frag * 30.0), 0.0, 100.0))


def battery(burned: Column, late: Column) -> Column:
    return round_half_even(clamp(
        F.lit(100.0) - burned * F.lit(0.9) - F.least(F.lit(10.0), late * 10.0), 0.0, 100.0))


def status(burned: Column) -> Column:
    return (F.when(burned < 25, "Healthy").when(burned < 50, "Slightly elevated")
            .when(burned < 75, "Elevated").otherwise("High strain"))


def suggestions(late: Column, tabs: Column, intr: Column, back: Column, frag: Column, hours: Column) -> Column:
    tips = F.array_compact(F.array(
        F.when(hours > 0, TIPS["marathon"]), F.when(late > 0.5, TIPS["late"]),
        F.when(tabs > 0.5, TIPS["tabs"]), F.when(intr > 0.5, TIPS["interruptions"]),
        F.when(back > 0.5, TIPS["corrections"]), F.when(frag > 0.4, TIPS["fragmented"])))
    return F.when(F.size(tips) > 0, tips).otherwise(F.array(F.lit(TIPS["steady"])))


def deviations(signals: DataFrame, baseline: Mapping[str, float] = BASELINE) -> DataFrame:
    """Adds conf, d_late, d_tabs, d_intr, d_back, d_frag and marathon."""
    filled = fill_baseline(signals, baseline)
    conf = confidence(F.col("active_minutes"))
    filled = filled.withColumn("conf", conf)
    weighted = {
        f"d_{short}": excess(F.col(f"s_{name}"), baseline[name]) * F.col("conf")
        for short, name in (("late", "late_night_min"), ("tabs", "tab_switches"),
                            ("intr", "interruptions"), ("back", "backspace_rate"))}
    weighted["d_frag"] = shortfall(F.col("s_avg_session_min"), baseline["avg_session_min"]) * F.col("conf")
    weighted["marathon"] = marathon(F.col("s_avg_session_min"), F.coalesce("active_minutes", F.lit(0.0)))
    return filled.withColumns(weighted)


def score_behavior(signals: DataFrame, baseline: Mapping[str, float] = BASELINE) -> DataFrame:
    """Adds mental_battery, focus_score, burnout_risk, status and suggestions. One projection."""
    parts = [F.col(f"d_{p}") for p in ("late", "tabs", "intr", "back", "frag")]
    late, tabs, intr, back, frag = parts
    hours = F.col("marathon")
    scored = deviations(signals, baseline).withColumns({
        "burnout_risk": burnout(late, tabs, intr, back, frag, hours), "focus_score": focus(tabs, intr, frag)})
    scored = scored.withColumns({
        "mental_battery": battery(F.col("burnout_risk"), late), "status": status(F.col("burnout_risk")),
        "suggestions": suggestions(late, tabs, intr, back, frag, hours)})
    scratch = [c for c in scored.columns if c.startswith(("s_", "d_")) or c in ("conf", "marathon")]
    return scored.drop(*[c for c in scratch if c not in signals.columns])


def deltas(signals: DataFrame, keys: list[str], baseline: Mapping[str, float] = BASELINE) -> DataFrame:
    """Percent change per signal, one row each, with its direction."""
    filled = fill_baseline(signals, baseline)
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"),
                 round_half_even((F.col(f"s_{k}") - baseline[k]) / baseline[k] * 100).alias("pct"))
        for i, (k, label) in enumerate(DELTA_LABELS.items()) if baseline[k] > 0])
    return filled.select(*keys, F.explode(rows).alias("d")).select(
        *keys, "d.pos", "d.label", "d.pct",
        F.when(F.col("d.pct") > 5, "up").when(F.col("d.pct") < -5, "down").otherwise("flat").alias("direction"))


SIGNALS = (*BASELINE, "active_minutes")


def daily_metrics(reports: DataFrame, baseline: Mapping[str, float] = BASELINE) -> DataFrame:
    """The last report of each user-day, scored. Reports are reduced before they are scored."""
    latest = reports.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max_by(F.struct(*SIGNALS), F.struct("ts", "seq")).alias("signals"))
    return score_behavior(latest.select("user_id", "day", "signals.*"), baseline)


def strain_events(reports: DataFrame, baseline: Mapping[str, float] = BASELINE) -> DataFrame:
    """A history row for every report whose burnout risk is above the strain threshold."""
    return score_behavior(reports, baseline).where(F.col("burnout_risk") > STRAIN_THRESHOLD).select(
        "user_id", "seq", "ts", F.lit(3).alias("layer"), F.lit("moderate").alias("level"),
        F.lit("behavioral_strain").alias("category"))


def merge_app_usage(usage: DataFrame, settings: DataFrame) -> DataFrame:
    """Seconds per opted-in user, day and app, and when in the day (`seq`, if given) the app came first. Sums first, so the opt-in join sees few rows."""
    app = F.substring(F.trim("app"), 1, 80)
    first = [F.min("seq").alias("first_seq")] if "seq" in usage.columns else []
    summed = usage.where(F.col("seconds") > 0).withColumn("app", app).where(F.col("app") != "").groupBy(
        "user_id", "day", "app").agg(F.sum("seconds").alias("seconds"), *first)
    opted_in = settings.where("track_app_usage").select("user_id").distinct()
    return summed.join(opted_in, "user_id", "left_semi")
