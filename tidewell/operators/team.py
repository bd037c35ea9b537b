"""Hiring and team state, folded from mutation logs.

All folds are aggregates with `max_by`, which combine before the shuffle; a member or applicant
with a very long log costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.sizing import lookup_join

MEMBER_FIELDS = ("name", "role", "dept", "contact")
POSITION_FIELDS = ("title", "dept")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct("ts", "seq")))


def applicant_stages(log: DataFrame) -> DataFrame:
    """Applicants at their current stage. `op` is `apply` or `stage`."""
    applied = F.when(F.col("op") == "apply", F.struct("ts", "seq"))
    folded = log.groupBy("applicant_id").agg(
        F.min_by(F.struct("name", "email", "role", "ts"), applied).alias("a"),
        F.max_by("stage", F.when(F.col("op") == "stage", F.struct("ts", "seq"))).alias("stage"))
    return folded.where(F.col("a").isNotNull()).select(
        "applicant_id", "a.name", "a.email", "a.role", F.col("a.ts").alias("applied_at"),
        F.coalesce("stage", F.lit("Applied")).alias("stage"))


def hire_members(hires: DataFrame, positions: DataFrame, default_dept: str = "Engineering") -> DataFrame:
    """Roster rows of hired applicants; the first position of that title gives the department."""
    first = positions.groupBy(F.col("title").alias("role")).agg(
        F.min_by(F.struct("dept", "position_id"), "position_id").alias("p"))
    return lookup_join(hires, first, ["role"], ["applicant_id"]).select(
        F.concat(F.lit("hired-"), F.col("applicant_id").cast("string")).alias("member_id"), "name", "role",
        F.coalesce("p.dept", F.lit(default_dept)).alias("dept"), F.col("email").alias("contact"),
        F.col("p.position_id").alias("filled_position"))


def position_state(log: DataFrame) -> DataFrame:
    """Open and filled positions. `op` is `upsert`, `toggle`, `fill` or `delete`.

    Toggles flip the status; a fill sets it, and only later toggles count after one.
    """
    at = F.struct("ts", "seq")
    fills = log.where(F.col("op") == "fill").groupBy("position_id").agg(F.max(at).alias("_filled_at"))
    marked = lookup_join(log, fills, ["position_id"], ["seq"])
    counts = (F.col("op") == "toggle") & (F.col("_filled_at").isNull() | (at > F.col("_filled_at")))
    folded = marked.groupBy("position_id").agg(
        *[_last(F.when(F.col("op") == "upsert", F.col(f))).alias(f) for f in POSITION_FIELDS],
        F.count_if(counts).alias("_flips"), F.bool_or(F.col("_filled_at").isNotNull()).alias("_was_filled"),
        F.count_if(F.col("op") == "delete").alias("_deleted"), F.count_if(F.col("op") == "upsert").alias("_known"))
    odd = F.col("_flips") % 2 == 1
    return folded.where((F.col("_deleted") == 0) & (F.col("_known") > 0)).select(
        "position_id", *POSITION_FIELDS,
        F.when(F.col("_was_filled") == odd, "open").otherwise("filled").alias("status"))


def roster(log: DataFrame, fields: Sequence[str] = MEMBER_FIELDS) -> DataFrame:
    """Current members: last value of each field; removed members stay out."""
    folded = log.groupBy("member_id").agg(
        *[_last(F.when(F.col("op") == "save", F.col(f))).alias(f) for f in fields],
        F.count_if(F.col("op") == "delete").alias("_deleted"), F.count_if(F.col("op") == "save").alias("_saved"))
    return folded.where((F.col("_deleted") == 0) & (F.col("_saved") > 0)).select("member_id", *fields)


def link_accounts(accounts: DataFrame, members: DataFrame) -> DataFrame:
    """Accounts with the first member of the same address, and whether that member is a founder."""
    address = F.lower(F.trim(F.coalesce("contact", F.lit(""))))
    first = members.withColumn("_email", address).where(F.col("_email") != "").groupBy("_email").agg(
        F.min_by(F.struct("member_id", "role"), "member_id").alias("m"))
    return lookup_join(accounts.withColumn("_email", F.lower(F.trim("email"))), first, ["_email"], ["account_id"]).select(
        "account_id", "name", "email", F.col("m.member_id").alias("member_id"),
        F.coalesce(F.startswith(F.lower("m.role"), F.lit("founder")), F.lit(False)).alias("is_founder"))


def task_state(log: DataFrame, removed_members: DataFrame) -> DataFrame:
    """Open and done tasks: `op` is `add`, `toggle` or `delete`; removing a member removes their tasks."""
    folded = log.groupBy("member_id", "task_id").agg(
        F.count_if(F.col("op") == "toggle").alias("_flips"), F.count_if(F.col("op") == "add").alias("_added"),
        F.count_if(F.col("op") == "delete").alias("_deleted"))
    kept = folded.where((F.col("_added") > 0) & (F.col("_deleted") == 0)).select(
        "member_id", "task_id", (F.col("_flips") % 2 == 1).alias("done"))
    return kept.join(removed_members.select("member_id").distinct(), "member_id", "left_anti")


# The wording of the feed, one template per mutation.
NOTE_TEXT = {
    "apply": "New applicant: %s → %s", "stage": "%s moved to “%s”",
    "hire": "🎉 %s hired as %s — welcome to the team!", "position_open": "New position opened: %s",
    "position_reopened": "Position reopened: %s", "position_filled": "Position filled: %s",
    "member_update": "%s's profile updated", "member_join": "%s joined as %s",
    "member_remove": "%s removed from the team directory", "task": "Task assigned to %s: %s",
    "claim": "%s claimed their teammate account", "signup": "%s signed up for HQ (%s)",
}


def notes_feed(mutations: DataFrame, read_at: Column) -> DataFrame:
    """One note per mutation `(kind, subject, detail, ts, seq)`, newest first, read up to `read_at`."""
    text = F.lit(None).cast("string")
    for kind, template in NOTE_TEXT.items():
        parts = template.split("%s")
        pieces = [F.lit(parts[0])]
        for value, tail in zip(("subject", "detail"), parts[1:]):
            pieces += [F.coalesce(F.col(value), F.lit("?")), F.lit(tail)]
        text = F.when(F.col("kind") == kind, F.concat(*pieces)).otherwise(text)
    return mutations.select("seq", "ts", text.alias("note"), (F.col("ts") <= read_at).alias("read")).where(
        F.col("note").isNotNull()).orderBy(F.desc("ts"), F.desc("seq"))


def department_plan(log: DataFrame, most: int = 50) -> DataFrame:
    """Last target per department, clamped to 0..most."""
    return log.groupBy("dept").agg(
        F.greatest(F.lit(0), F.least(F.lit(most), F.max_by("target", F.struct("ts", "seq")))).alias("target"))


def headcount_gap(plan: DataFrame, members: DataFrame) -> DataFrame:
    """Filled and open slots per planned department."""
    filled = members.groupBy("dept").agg(F.count("*").alias("filled"))
    return plan.join(filled, "dept", "left").select(
        "dept", "target", F.coalesce("filled", F.lit(0)).alias("filled"),
        F.greatest(F.col("target") - F.coalesce("filled", F.lit(0)), F.lit(0)).alias("open"))
