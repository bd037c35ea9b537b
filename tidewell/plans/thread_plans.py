"""Threads, transcripts and caps over `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import fusion, threads as ops
from tidewell.plans.inputs import CHAT, chat, table
from tidewell.plans.registry import query

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_FLAT = f"trim(regexp_replace(coalesce(content, ''), '{_WS}', ' ', 'g'))"
_TITLE = f"""CASE WHEN length({_FLAT}) > 44 THEN substr({_FLAT}, 1, 44) || '…' WHEN {_FLAT} = '' THEN 'New conversation' ELSE {_FLAT} END"""
_TITLES = f"""titles AS (SELECT thread_id, coalesce(arg_min({_TITLE}, turn) FILTER (role = 'user'), 'New conversation') AS title
  FROM chat GROUP BY thread_id)"""


@query("thread_titles", f"WITH {CHAT}, {_TITLES} SELECT thread_id, title FROM titles")
def thread_titles(spark, sf):
    return ops.thread_titles(chat(spark, sf))


@query("list_threads", f"""WITH {CHAT}, {_TITLES} SELECT c.user_id, c.thread_id, t.title, epoch_us(max(c.ts)) AS at, count(*) AS count
  FROM chat c JOIN titles t USING (thread_id) GROUP BY ALL""")
def list_threads(spark, sf):
    return ops.list_threads(chat(spark, sf)).withColumn("at", F.unix_micros("ts")).drop("ts")


@query("archivable_threads", f"""WITH {CHAT}, t AS (SELECT user_id, thread_id, max(ts) AS ts, count(*) AS count FROM chat
  GROUP BY ALL HAVING bool_or(role = 'user')) SELECT user_id, thread_id, epoch_us(ts) AS at, count FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, thread_id DESC) AS rn FROM t) WHERE rn <= 50""")
def archivable_threads(spark, sf):
    return ops.archivable_threads(chat(spark, sf), keep=50).withColumn("at", F.unix_micros("ts")).drop("ts")


def _threads(spark, sf):
    return chat(spark, sf).groupBy("user_id", "thread_id").agg(F.count("*").alias("count"))


def _deletions(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey * 3 % 20 AS user_id", "o_orderkey * 3 AS thread_id")


_DEL = CHAT + """, threads AS (SELECT user_id, thread_id, count(*) AS count FROM chat GROUP BY ALL),
  gone AS (SELECT DISTINCT o_orderkey * 3 % 20 AS user_id, o_orderkey * 3 AS thread_id FROM orders)"""


@query("delete_threads", f"WITH {_DEL} SELECT t.* FROM threads t ANTI JOIN gone g ON t.user_id = g.user_id AND t.thread_id = g.thread_id")
def delete_threads(spark, sf):
    return ops.delete_threads(_threads(spark, sf), _deletions(spark, sf))


@query("missing_threads", f"WITH {_DEL} SELECT g.* FROM gone g ANTI JOIN threads t ON t.user_id = g.user_id AND t.thread_id = g.thread_id")
def missing_threads(spark, sf):
    return ops.missing_threads(_threads(spark, sf), _deletions(spark, sf))


def _friend_turns(spark, sf):
    """Of every twelve conversations the last eight are one, long enough for the limit of 60 turns to refuse some."""
    return table(spark, sf, "conversations").selectExpr(
        "CASE WHEN conv_id % 12 < 4 THEN conv_id ELSE -(conv_id div 24) - 1 END AS conv_id", "conv_id * 1000 + turn AS turn", "CASE role WHEN 'user' THEN 'friend' WHEN 'assistant' THEN 'user' END AS role", "text AS content")


_FRIEND = """turns AS (SELECT CASE WHEN conv_id % 12 < 4 THEN conv_id ELSE -(conv_id // 24) - 1 END AS conv_id, conv_id * 1000 + turn AS turn, CASE role WHEN 'user' THEN 'friend' WHEN 'assistant' THEN 'user' END AS role,
  text AS content FROM conversations), caps AS (SELECT conv_id, count(*) AS turns, max(length(content)) AS longest,
  count(*) <= 60 AND coalesce(max(length(content)), 0) <= 4000 AS accepted FROM turns GROUP BY conv_id)"""


@query("conversation_caps", f"WITH {_FRIEND} SELECT conv_id, turns, longest, accepted FROM caps")
def conversation_caps(spark, sf):
    return fusion.conversation_caps(_friend_turns(spark, sf), most_turns=60, longest=4000)


@query("label_transcript", f"""WITH {_FRIEND} SELECT conv_id, string_agg(CASE role WHEN 'friend' THEN 'user: [FRIEND] '
  ELSE 'assistant: [STUDENT (me)] ' END || content, chr(10) ORDER BY turn) AS transcript
  FROM turns WHERE role IS NOT NULL AND conv_id IN (SELECT conv_id FROM caps WHERE accepted) GROUP BY conv_id""")
def label_transcript(spark, sf):
    labelled = fusion.label_transcript(_friend_turns(spark, sf), most_turns=60, longest=4000)
    return labelled.select("conv_id", F.array_join(F.transform(
        "transcript", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n").alias("transcript"))
