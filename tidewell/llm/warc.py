"""WARC archives: written as text by Spark, read by a Python data source.

`write_archives` writes a record per page; pages whose payload equals that of a page with a smaller page_id become revisit records, which
carry no payload and refer to that page. A record is a value of the text writer, whose line separator is the blank lines that end a
record; so any file system Spark writes to will do, and no payload passes through Python.

The data source plans one partition per file, so writers bound the files. Filters on record_type, target_uri, record_id, refers_to and
payload_digest (=, IN, starts with, is not null) are pushed to the reader, which parses a record's headers first and steps over
the payload of a record that they reject. What becomes of the other payloads is the `payload` option: "skip", "digest"
(length and SHA-1, in slices, nothing decoded) or "text".

Null html is an empty payload, null url an empty target. Rows that repeat a page_id are records of their own, of one type. A null page_id
gives a record without a number; it refers to the smallest known page of its payload. Line breaks in a url are written as %0A.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from tidewell.llm.common import new_path, read
from tidewell.llm.registry import query

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
SLICE = 1 << 20
SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, "
          "computed_digest string, payload string")


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in upper-case base32: 5 hex digits make 4 letters."""
    hexed = F.sha1(F.encode(text, "UTF-8"))
    letters = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, record_type, refers_to, value (the record as text) per page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]+", "%0A").alias("url"), html.alias("html"),
                        base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    known = rows.join(first.select("digest", "first"), "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull()
    named = known.withColumn("refers_to", F.when(revisit, F.col("first")))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    body = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number, F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(body) + len(HTTP)).cast("string"), F.lit("\r\n\r\n" + HTTP))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return named.select("page_id", kind.alias("record_type"), "refers_to", F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    records(pages, least_bytes).select("value").write.option("lineSep", END).option("compression", compression).text(path)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Warc(DataSource):
    """format("tidewell_warc"), options: path, payload (skip, digest or text)."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(self.options["path"], self.options.get("payload", "digest"))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        if payload not in ("skip", "digest", "text"):
            raise ValueError(f"payload may be skip, digest or text, not {payload}")
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        header = {"record_type", "target_uri", "record_id", "refers_to", "payload_digest"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in header:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True))
                 if f.is_file and not f.base_name.startswith(("_", ".")) and f.size]
        return [FilePartition(f.path) for f in sorted(files, key=lambda f: (-f.size, f.path))]

    def accepts(self, row: dict) -> bool:
        for column, how, value in self.tests:
            own = row[column]
            if own is None or how == "in" and own not in value or how == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition is None:
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path, compression=None) as raw:
            plain = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            yield from self.rows(io.BufferedReader(plain, SLICE))

    def rows(self, stream: io.BufferedReader) -> Iterator[tuple]:
        while True:
            line = stream.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            head = headers(stream)
            left = int(head["content-length"])
            row = {
                "record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
                "refers_to": bare(head.get("warc-refers-to")), "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                "payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None, "computed_digest": None, "payload": None}
            if self.payload == "skip" or not self.accepts(row):
                skip(stream, left)
            else:
                if head.get("content-type", "").startswith("application/http"):
                    left -= http_head(stream, left)
                if row["record_type"] == "revisit":
                    skip(stream, left)
                elif self.payload == "text":
                    body = stream.read(left)
                    row |= {"payload": body.decode("utf-8", "replace"), "payload_bytes": left,
                            "computed_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}
                else:
                    digest, rest = hashlib.sha1(), left
                    while rest:
                        part = stream.read(min(rest, SLICE))
                        if not part:
                            raise EOFError("the record ends early")
                        digest.update(part)
                        rest -= len(part)
                    row |= {"payload_bytes": left, "computed_digest": base64.b32encode(digest.digest()).decode()}
            if self.accepts(row):
                yield tuple(row.values())


def bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def headers(stream: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def http_head(stream: io.BufferedReader, most: int) -> int:
    """Step over the HTTP headers; returns how many bytes they take."""
    taken = 0
    while taken < most:
        line = stream.readline(most - taken)
        taken += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
    return taken


def skip(stream: io.BufferedReader, size: int) -> None:
    while size > 0:
        part = stream.read(min(size, SLICE))
        if not part:
            raise EOFError("the record ends early")
        size -= len(part)


def read_archives(spark: SparkSession, path: str, payload: str = "digest") -> DataFrame:
    """The records under `path`. Header predicates are pushed where the session allows data sources written in Python to take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("tidewell_warc").option("path", path).option("payload", payload).load()


_SQL_LETTERS = " || ".join(
    f"substr('{ALPHABET}', ((('0x' || substr(s, {5 * i + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))


@query("op9_warc", f"""
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM d GROUP BY s)
SELECT page_id, payload_bytes, {_SQL_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (s)""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))

    def number(column: str) -> Column:
        return F.regexp_extract(column, "^urn:page:([0-9-]+)$", 1).try_cast("long")
    return back.select(
        number("record_id").alias("page_id"), "payload_bytes", F.coalesce("computed_digest", "payload_digest").alias("payload_digest"), "record_type",
        number("refers_to").alias("refers_to"))
