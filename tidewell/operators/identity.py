"""Who a request belongs to, who may see what, and abuse checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.ordered import with_running
from tidewell.functions.sizing import lookup_anti, lookup_join

# Endpoints open to everyone.
PUBLIC_PATHS = (
    "/", "/app", "/chat", "/detection", "/today", "/download/agent",
    "/api/me", "/api/signup", "/api/login", "/api/logout",
    "/api/password/forgot", "/api/password/reset",
    "/api/scan", "/classify", "/api/behavioral", "/api/monitor", "/api/helper",
)
SHARED_PREFIXES = ("/api/hq", "/api/qa")


def infer_owner(users: DataFrame, email: str = "") -> DataFrame:
    """One row: the account of the configured address, else the only account, else null."""
    wanted = email.strip().lower()
    by_email = F.max(F.when(F.col("email") == wanted, F.col("uid"))) if wanted else F.lit(None).cast("string")
    return users.agg(by_email.alias("_named"), F.count("*").alias("_n"), F.min("uid").alias("_only")).select(
        F.coalesce("_named", F.when(F.col("_n") == 1, F.col("_only"))).alias("uid"))


def active_tokens(tokens: DataFrame) -> DataFrame:
    """The newest device token of each user; issuing one voids the earlier ones."""
    return tokens.groupBy("uid").agg(
        F.max_by("token", F.struct("issued_at", "token")).alias("token"), F.max("issued_at").alias("issued_at"))


def resolve_user(requests: DataFrame, users: DataFrame, tokens: DataFrame, owner: DataFrame | None = None,
                 request: str = "req_id") -> DataFrame:
    """Adds `resolved_uid`: valid session, else owner of a local request, else device token, else null."""
    known = users.select(F.col("uid").alias("session_uid"), F.lit(True).alias("_valid"))
    paired = active_tokens(tokens).join(users.select("uid"), "uid", "left_semi").select(
        F.col("token").alias("device_token"), F.col("uid").alias("_paired"))
    joined = lookup_join(requests, known, ["session_uid"], [request])
    joined = lookup_join(joined, paired, ["device_token"], [request])
    local_owner = owner.scalar() if owner is not None else F.lit(None).cast("string")
    resolved = F.coalesce(
        F.when(F.col("_valid"), F.col("session_uid")),
        F.when(F.col("is_local"), local_owner),
        F.col("_paired"))
    return joined.withColumn("resolved_uid", resolved).drop("_valid", "_paired")


def valid_signups(attempts: DataFrame, seq: str = "seq") -> DataFrame:
    """Accepted sign-ups: usable address and password, first attempt per address wins."""
    address = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    usable = attempts.withColumn("email", address).where(
        (F.col("email") != "") & F.contains("email", F.lit("@")) & (F.col("password_length") >= 6))
    given = F.trim(F.coalesce("name", F.lit("")))
    return usable.groupBy("email").agg(
        F.min(seq).alias(seq), F.min_by(given, seq).alias("_name")).select(
        seq, "email", F.when(F.col("_name") != "", F.col("_name")).otherwise(
            F.substring_index("email", "@", 1)).alias("name"))


def rate_flags(attempts: DataFrame, window_seconds: int = 60, allowed: int = 10) -> DataFrame:
    """Attempts per address and instant with the count of the trailing window, flagged above `allowed`.

    Blocked attempts count too. An address is split into window-wide time slices; each slice sees
    the one before it as context, so no address is ever gathered whole.
    """
    width = window_seconds * 1_000_000
    micros = F.unix_micros("ts")
    counted = attempts.groupBy("ip", "ts").agg(F.count("*").alias("attempts"))
    own = F.floor(micros / F.lit(width)).cast("long")
    sliced = counted.select("*", micros.alias("_at"), own.alias("_own"),
                            F.explode(F.array(own, own + 1)).alias("_slice"))
    trailing = Window.partitionBy("ip", "_slice").orderBy("_at").rangeBetween(-(width - 1), 0)
    return (
        sliced.withColumn("in_window", F.sum("attempts").over(trailing)).where(F.col("_slice") == F.col("_own"))
        .select("ip", "ts", "attempts", "in_window", (F.col("in_window") > allowed).alias("limited"))
    )


def reset_lockouts(guesses: DataFrame, key: str = "code_id", tie: Sequence[str] = ("seq",), most_wrong: int = 8,
                   lifetime_seconds: int = 900) -> DataFrame:
    """Outcome of each reset-code guess: invalid once locked, expired or used; else wrong or accepted."""
    marked = guesses.withColumns({
        "_wrong": F.when(F.col("correct"), 0).otherwise(1), "_right": F.when(F.col("correct"), 1).otherwise(0)})
    running = with_running(marked, [key], "ts", tie, sums={"_wrongs": "_wrong", "_rights": "_right"})
    wrong_before = F.col("_wrongs") - F.col("_wrong")
    right_before = F.col("_rights") - F.col("_right")
    expired = F.unix_micros("ts") >= F.unix_micros("issued_at") + lifetime_seconds * 1_000_000
    outcome = (F.when((wrong_before >= most_wrong) | expired | (right_before > 0), "invalid")
               .when(F.col("correct"), "accepted").otherwise("wrong"))
    return running.withColumns({"wrong_before": wrong_before, "outcome": outcome}).drop(
        "_wrong", "_right", "_wrongs", "_rights")


def access_denied(requests: DataFrame, path: str = "path", uid: str = "resolved_uid",
                  public: Sequence[str] = PUBLIC_PATHS) -> DataFrame:
    """Requests of nobody in particular for somebody's personal data."""
    shared = F.lit(False)
    for prefix in SHARED_PREFIXES:
        shared = shared | F.startswith(F.col(path), F.lit(prefix))
    return requests.where(
        F.col(uid).isNull() & F.startswith(F.col(path), F.lit("/api/")) & ~shared & ~F.col(path).isin(list(public)))


def erase(tables: dict[str, DataFrame], erased: DataFrame, key: str = "user_id") -> dict[str, DataFrame]:
    """Every table without the erased users."""
    return {name: lookup_anti(df, erased, [key]) for name, df in tables.items()}


def reset_history(tables: dict[str, DataFrame], users: DataFrame, key: str = "user_id",
                  forgotten: Sequence[str] = ("daily", "events")) -> dict[str, DataFrame]:
    """Forgets learned days and events of the given users; settings and chat stay."""
    return {name: lookup_anti(df, users, [key]) if name in forgotten else df for name, df in tables.items()}
