"""What the operators share: tables, written intermediate results, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.functions.ordered import free_names
from tidewell.functions.text import bind

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    made = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tidewell-{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, and any executor can read it again."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by `saved` that nothing will read again."""
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over `edges` (a, b), for every id that has an edge.

    Alternates the large-star and small-star steps until the edges stay the same. Minima are
    combined before the shuffle; the joins that carry them back are plain equi-joins, which
    adaptive execution splits where one id has very many neighbours. Edges with a null end are dropped.
    """
    def key(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    now = saved(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        state = key(now)
        if state == last or not state[0]:
            break
        last = state
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.where("m < a").select("a", "m")).where("a <> b").distinct()
        large, before = saved(large, "edges"), now
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", "m")).where("a <> b").distinct()
        now = saved(small, "edges")
        forget(before), forget(large)
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops)


__all__ = ["LOWER", "UPPER", "bind", "components", "forget", "free_names", "new_path", "read", "saved", "sha256_hex", "shared_folder", "text_of"]
