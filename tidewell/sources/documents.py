"""Per-user JSON documents: read with defaults, flatten, write back, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.sizing import BROADCAST_LIMIT_BYTES, estimated_bytes, lookup_anti
from tidewell.operators.behavior import SIGNALS
from tidewell.operators.history import TOGGLES

_SIGNALS = "struct<" + ",".join(f"{s}:double" for s in SIGNALS) + ">"
_METRICS = "struct<mental_battery:bigint,focus_score:bigint,burnout_risk:bigint,status:string,suggestions:array<string>>"
_MESSAGE = "struct<role:string,content:string,ts:timestamp>"
DOCUMENT_SCHEMA = f"""
  settings struct<name:string,contact:string,onboarded:boolean,toggles:map<string,boolean>,
                  track_app_usage:boolean,popup_policy:string>,
  days map<string, struct<signals:{_SIGNALS}, metrics:{_METRICS}>>,
  events array<struct<ts:timestamp,layer:int,level:string,category:string>>,
  chat array<{_MESSAGE}>,
  chat_threads array<struct<id:string,title:string,messages:array<{_MESSAGE}>,ts:timestamp>>,
  app_usage map<string, map<string, double>>,
  last_auto_send timestamp
"""
_DEFAULT_CONTACT = "School Counselor <counselor@school.edu>"


def read_user_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per document file, missing parts filled in. An unreadable file counts as an empty one."""
    raw = (
        spark.read.schema(DOCUMENT_SCHEMA + ", _corrupt string").option("multiLine", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        .withColumn("user_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(?:user_)?(.*?)(?:\.json)?$", 1))
    )
    return with_defaults(raw.drop("_corrupt"))


def with_defaults(docs: DataFrame) -> DataFrame:
    """Backfills every missing top-level part, and the missing settings."""
    all_on = F.create_map(*[x for t in TOGGLES for x in (F.lit(t), F.lit(True))])
    settings = F.struct(
        F.coalesce("settings.name", F.lit("")).alias("name"),
        F.coalesce("settings.contact", F.lit(_DEFAULT_CONTACT)).alias("contact"),
        F.coalesce("settings.onboarded", F.lit(False)).alias("onboarded"),
        F.coalesce("settings.toggles", all_on).alias("toggles"),
        F.coalesce("settings.track_app_usage", F.lit(False)).alias("track_app_usage"),
        F.coalesce("settings.popup_policy", F.lit("balanced")).alias("popup_policy"))
    types = {f.name: f.dataType for f in docs.schema}
    empty = {
        name: F.from_json(F.lit("{}" if name in ("days", "app_usage") else "[]"), types[name])
        for name in ("days", "events", "chat", "chat_threads", "app_usage")}
    return docs.withColumns({"settings": settings, **{n: F.coalesce(n, e) for n, e in empty.items()}})


@dataclass
class UserTables:
    settings: DataFrame
    daily: DataFrame
    events: DataFrame
    chat: DataFrame
    threads: DataFrame
    app_usage: DataFrame


def explode_docs(docs: DataFrame) -> UserTables:
    """The document parts as long tables keyed by user."""
    days = docs.select("user_id", F.explode("days").alias("_day", "_d"))
    apps = docs.select("user_id", F.explode("app_usage").alias("_day", "_apps"))
    return UserTables(
        settings=docs.select("user_id", "settings.*"),
        daily=days.select("user_id", F.to_date("_day").alias("day"), "_d.signals.*", "_d.metrics.*"),
        events=docs.select("user_id", F.posexplode("events").alias("seq", "_e")).select(
            "user_id", F.col("seq").cast("long"), "_e.*"),
        chat=docs.select("user_id", F.posexplode("chat").alias("seq", "_m")).select(
            "user_id", F.col("seq").cast("long"), "_m.*"),
        threads=docs.select("user_id", F.explode("chat_threads").alias("_t")).select(
            "user_id", F.col("_t.id").alias("thread_id"), "_t.title", "_t.ts", "_t.messages"),
        app_usage=apps.select("user_id", F.to_date("_day").alias("day"), F.explode("_apps").alias("app", "seconds")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def write_user_docs(docs: DataFrame, path: str, buckets: int = 256, most_rows_per_file: int = 100_000) -> None:
    """Replace the documents of the given users.

    Documents live in hash buckets of users, so the number of folders does not grow with the users.
    Only the touched buckets are rewritten, each with its other users' documents kept. The number of write tasks follows the size of the
    data: adaptive execution cuts a large bucket into parts of the advised size and puts small ones together.
    """
    spark = docs.sparkSession
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        touched = bucketed.select("bucket").distinct()
        kept = lookup_anti(
            spark.read.schema(bucketed.schema).json(path).join(F.broadcast(touched), "bucket", "left_semi"), bucketed, ["user_id"])
        bucketed = cut_lineage(bucketed.unionByName(kept))
    (bucketed.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", most_rows_per_file).partitionBy("bucket").json(path))


def erase_history(spark: SparkSession, path: str, erased: DataFrame, key: str = "user_id") -> list[str]:
    """Rewrite the days of a day-partitioned history that hold an erased user, and no others. Returns those days.

    The rows that stay are written to the shared folder first, so a lost executor or a second run finds them. A day left without rows is removed.
    """
    history = spark.read.parquet(path)
    days = [str(r["day"]) for r in history.join(F.broadcast(erased.select(key).distinct()) if estimated_bytes(erased) <= BROADCAST_LIMIT_BYTES
                                               else erased.select(key).distinct(), key, "left_semi").select("day").distinct().collect()]  # a row a day
    if not days:
        return []
    left = cut_lineage(lookup_anti(history.where(F.col("day").cast("string").isin(days)), erased, [key]))
    kept = {str(r["day"]) for r in left.select("day").distinct().collect()}
    left.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in sorted(set(days) - kept):
        _delete(spark, f"{path}/day={day}")
    return sorted(days)


def compact_history(spark: SparkSession, path: str, stream: str, until: int) -> None:
    """Put the micro-batches up to `until` of one stream's history together, a few files a day in place of a few a micro-batch.

    They become the one batch of the stream `<name>-compacted`, together with what that held. Whatever its newest batch already holds is deleted before
    anything else, so a run that was cut off is finished by the next. Readers that run between the two steps see rows twice: compact while none does.
    """
    done = f"{path}/stream={stream}-compacted"
    held = max(_batches(spark, done), default=-1)
    for folder, least in ((f"{path}/stream={stream}", held + 1), (done, held)):
        for batch in _batches(spark, folder):
            if batch < least:
                _delete(spark, f"{folder}/batch={batch}")
    old = [b for b in _batches(spark, f"{path}/stream={stream}") if b <= until]
    if not old:
        return
    earlier = [f"{done}/batch={b}" for b in _batches(spark, done)]
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/stream={stream}/batch={b}" for b in old], *earlier).drop("stream", "batch")
    part = f"{path}/_compacting-{stream}-{until}"  # readers skip names that begin so
    rows.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(part)
    _rename(spark, part, f"{done}/batch={max(old)}")
    for folder in [*earlier, *(f"{path}/stream={stream}/batch={b}" for b in old)]:
        _delete(spark, folder)


def read_written_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id string, " + DOCUMENT_SCHEMA).json(path)


def _at(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    files, at = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    files.mkdirs(target.getParent())
    if not files.rename(at, target):
        raise OSError(f"{path} could not be renamed to {to}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a stream's micro-batch folders."""
    files, at = _at(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def append_events(events: DataFrame, path: str) -> None:
    """Append history rows, partitioned by day so that gates and reports prune to the days they need."""
    allowed = {"user_id", "seq", "ts", "layer", "level", "category"}
    extra = set(events.columns) - allowed
    if extra:
        raise ValueError(f"history rows may not carry {sorted(extra)}")
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def export_user(tables: dict[str, DataFrame], user_id) -> DataFrame:
    """Everything stored about one user, one JSON line per record: (section, line).

    A record per line keeps a long history exportable without gathering it in one row.
    """
    parts = None
    for section, df in sorted(tables.items()):
        lines = df.where(F.col("user_id") == user_id).select(
            F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("line"))
        parts = lines if parts is None else parts.unionByName(lines)
    return parts

