"""Stand-ins: the supplied tables shaped as the operators' inputs, in Spark and in SQL.

Each `x(spark, sf)` has a SQL twin `X` that defines the same rows as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.operators.behavior import TIPS

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema
                           if f.dataType.simpleString() == "timestamp_ntz"})


# --- history ---------------------------------------------------------------------------------

_LEVEL = """CASE WHEN event_type = 'error' AND value > 20 THEN 'crisis' WHEN event_type = 'error' THEN 'high'
  WHEN event_type = 'signup' THEN 'moderate' WHEN event_type = 'view' THEN 'none' ELSE 'low' END"""
_CATEGORY = """CASE WHEN event_type = 'error' THEN 'crisis' WHEN event_type = 'signup' THEN 'major_stress'
  WHEN event_type = 'view' THEN 'none' ELSE 'everyday_stress' END"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS seq", "ts", "CAST(1 + event_id % 3 AS INT) AS layer",
        f"{_LEVEL} AS level", f"{_CATEGORY} AS category")


HISTORY = f"""history AS (SELECT user_id, event_id AS seq, ts, CAST(1 + event_id % 3 AS INT) AS layer,
  {_LEVEL} AS level, {_CATEGORY} AS category FROM events)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id").distinct()


USERS = "users AS (SELECT DISTINCT user_id FROM events)"


# --- settings ----------------------------------------------------------------------------------

def settings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user; every user id appears in `events`."""
    return users(spark, sf).selectExpr(
        "user_id", "concat('user ', user_id) AS name",
        "CASE WHEN user_id % 4 = 0 THEN 'call me' ELSE concat('Counselor <c', user_id, '@school.edu>') END AS contact",
        "map('keyword', user_id % 9 != 0, 'semantic', user_id % 5 != 0, 'behavioral', true, 'trend', user_id % 3 != 0) AS toggles",
        "user_id % 2 = 0 AS track_app_usage",
        "CASE WHEN user_id % 6 = 0 THEN 'everything' ELSE 'balanced' END AS popup_policy")


SETTINGS = USERS + """, settings AS (SELECT user_id, 'user ' || user_id AS name,
  CASE WHEN user_id % 4 = 0 THEN 'call me' ELSE 'Counselor <c' || user_id || '@school.edu>' END AS contact,
  user_id % 9 != 0 AS t_keyword, user_id % 5 != 0 AS t_semantic, user_id % 3 != 0 AS t_trend,
  user_id % 2 = 0 AS track_app_usage,
  CASE WHEN user_id % 6 = 0 THEN 'everything' ELSE 'balanced' END AS popup_policy FROM users)"""


# --- rhythm reports ----------------------------------------------------------------------------

_SIGNALS = {
    "tab_switches": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN value > 120 THEN CAST(120 AS DOUBLE) ELSE value END",
    "late_night_min": "CAST((event_id * 7) % 60 AS DOUBLE)",
    "avg_session_min": "CAST((event_id * 13) % 180 AS DOUBLE)",
    "interruptions": "CAST((event_id * 5) % 30 AS DOUBLE)",
    "backspace_rate": "CAST((event_id * 3) % 40 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "active_minutes": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 17) % 400 AS DOUBLE) END",
}


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS seq", "ts", *[f"{e} AS {n}" for n, e in _SIGNALS.items()])


REPORTS = "reports AS (SELECT user_id, event_id AS seq, ts, " + ", ".join(
    f"{e} AS {n}" for n, e in _SIGNALS.items()) + " FROM events)"

LATEST = """latest AS (SELECT * FROM (SELECT *, CAST(ts AS DATE) AS day,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, seq DESC) AS rn FROM reports) WHERE rn = 1)"""


def _said(tip: str) -> str:
    return TIPS[tip].replace("'", "''")


_TIPS = ",\n  ".join(f"CASE WHEN {test} THEN '{_said(tip)}' END" for tip, test in (
    ("marathon", "marathon > 0"), ("late", "d_late > 0.5"), ("tabs", "d_tabs > 0.5"), ("interruptions", "d_intr > 0.5"),
    ("corrections", "d_back > 0.5"), ("fragmented", "d_frag > 0.4")))
_STEADY = _said("steady")


def scored_sql(source: str, name: str = "scored") -> str:
    """CTEs ending in `name`: the rows of `source` with deviations, metrics and suggestions."""
    return f"""
  {name}_filled AS (SELECT *, coalesce(tab_switches, 25e0) AS s_tabs, coalesce(late_night_min, 15e0) AS s_late,
    coalesce(avg_session_min, 50e0) AS s_session, coalesce(interruptions, 10e0) AS s_intr,
    coalesce(backspace_rate, 0.1e0) AS s_back,
    CASE WHEN active_minutes IS NULL THEN 1e0 ELSE least(1e0, active_minutes / 45e0) END AS conf FROM {source}),
  {name}_dev AS (SELECT *, greatest(0e0, (s_late - 15e0) / 15e0) * conf AS d_late,
    greatest(0e0, (s_tabs - 25e0) / 25e0) * conf AS d_tabs, greatest(0e0, (s_intr - 10e0) / 10e0) * conf AS d_intr,
    greatest(0e0, (s_back - 0.1e0) / 0.1e0) * conf AS d_back, greatest(0e0, (50e0 - s_session) / 50e0) * conf AS d_frag,
    CASE WHEN s_session > 120 THEN least(15e0, (s_session - 120e0) / 120e0 * 15e0) ELSE 0e0 END
    + CASE WHEN coalesce(active_minutes, 0e0) > 240 THEN least(12e0, (active_minutes - 240e0) / 240e0 * 12e0) ELSE 0e0 END
    AS marathon FROM {name}_filled),
  {name}_burn AS (SELECT *, CAST(round_even(greatest(0e0, least(100e0, least(25e0, d_late * 25e0)
    + least(25e0, d_tabs * 20e0) + least(15e0, d_intr * 18e0) + least(15e0, d_back * 18e0)
    + least(20e0, d_frag * 25e0) + marathon)), 0) AS BIGINT) AS burnout_risk,
    CAST(round_even(greatest(0e0, least(100e0, 100e0 - least(35e0, d_tabs * 28e0) - least(30e0, d_intr * 30e0)
    - least(25e0, d_frag * 30e0))), 0) AS BIGINT) AS focus_score FROM {name}_dev),
  {name} AS (SELECT *, CAST(round_even(greatest(0e0, least(100e0, 100e0 - CAST(burnout_risk AS DOUBLE) * 0.9e0
    - least(10e0, d_late * 10e0))), 0) AS BIGINT) AS mental_battery,
    CASE WHEN burnout_risk < 25 THEN 'Healthy' WHEN burnout_risk < 50 THEN 'Slightly elevated'
    WHEN burnout_risk < 75 THEN 'Elevated' ELSE 'High strain' END AS status,
    coalesce(nullif(concat_ws(' | ', {_TIPS}), ''), '{_STEADY}') AS tips FROM {name}_burn)"""


DAILY = REPORTS + ", " + LATEST + "," + scored_sql("latest", "daily")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    from tidewell.operators.behavior import daily_metrics
    return daily_metrics(reports(spark, sf))


# --- app usage ---------------------------------------------------------------------------------

def app_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Foreground seconds; a few rows carry no name or no time and are to be refused."""
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS seq", "to_date(ts) AS day",
        "CASE WHEN event_id % 29 = 0 THEN '  ' ELSE concat(' ', event_type, ' ') END AS app",
        "CAST(CASE WHEN event_id % 31 = 0 THEN -1 ELSE value END AS DECIMAL(18,2)) AS seconds")


APP_ROWS = """app_rows AS (SELECT user_id, event_id AS seq, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 29 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END AS app,
  CAST(CASE WHEN event_id % 31 = 0 THEN -1 ELSE value END AS DECIMAL(18,2)) AS seconds FROM events)"""
APP_USAGE = APP_ROWS + """, app_usage AS (SELECT user_id, day, substr(trim(app), 1, 80) AS app, sum(seconds) AS seconds, min(seq) AS first_seq
  FROM app_rows WHERE seconds > 0 AND trim(app) != '' AND user_id % 2 = 0 GROUP BY ALL)"""


# --- conversations -----------------------------------------------------------------------------

def chat(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with an owner, a thread and a time."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id % 20 AS user_id", "conv_id AS thread_id", "turn", "conv_id * 1000 + turn AS seq", "role",
        "text AS content",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(conv_id % 30 AS INT), 0, CAST(turn AS INT), 0) AS ts")


CHAT = """chat AS (SELECT conv_id % 20 AS user_id, conv_id AS thread_id, turn, conv_id * 1000 + turn AS seq, role,
  text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INT)) + to_minutes(turn) AS ts
  FROM conversations)"""

# Sentences appended to the invented prose, so that the guards have something to judge.
SENTENCES = (
    "what time does the library close", "my phone is dead", "i cut myself a slice of pizza", "i give up on this puzzle",
    "lol i want to kill myself", "i am really worn out because of school today", "im having a meltdown", "i give up",
    "i feel so depresssed", "my dog looks sad", "i am tierd", "i want to kill you", "i'll kill you lol",
    "i want to die lol", "want it to stop raining", "everything is falling apart", "thinking of hurting myself",
    "i want to kill that guy tonight", "no reason to live", "he said he will hurt me", "bro im dying laughing lmao",
    "screw this test", "you're worthless", "i am alone and empty", "suicide squad was mid",
)
_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn with a sentence appended."""
    turns = table(spark, sf, "conversations")
    sentence = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]),
                            ((F.col("conv_id") * 31 + F.col("turn")) % len(SENTENCES) + 1).cast("int"))
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("conv_id").alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("conv_id") % 30).cast("int"),
                                                                 mins=F.col("turn").cast("int"))).alias("ts"),
        F.concat("text", F.lit(" "), sentence).alias("text"), sentence.alias("sentence"))


MESSAGES = f"""messages AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id AS user_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INT)) + to_minutes(turn) AS ts,
  text || ' ' || ([{_LIST}])[1 + (conv_id * 31 + turn) % {len(SENTENCES)}] AS text,
  ([{_LIST}])[1 + (conv_id * 31 + turn) % {len(SENTENCES)}] AS sentence FROM conversations)"""


def norm_sql(column: str) -> str:
    """SQL for the normalised text of a column."""
    return (f"lower(trim(regexp_replace(replace(replace(coalesce({column}, ''), '’', ''''), '‘', ''''), "
            r"'[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')))")


def bounded_sql(body: str) -> str:
    """A word-bounded RE2 pattern, with boundaries that know accented letters."""
    return r"(^|[^\p{L}\p{N}_])(?:" + body + r")($|[^\p{L}\p{N}_])"
