"""WARC archives: writing, reading and revisit resolution.

Archives are written by Spark's text writer, a record a row with CR LF after it, so commits and stores are
Spark's: any folder it reaches. Bytes pass through string columns unchanged. Deduplication shuffles headers
only: the records' digests choose the response of each payload and the other records become revisits, which are written
from headers alone. The archives are read again where they are, with the places of their revisits beside them, and all
but those are written with fresh headers. An archive is read whole, so it has to be below 2 GiB.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop_path, drop_written, fresh_path, table, written

#: Payloads of at least so many bytes may become revisits.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
_FIELDS = "file string, place long, type string, record_id string, url string, page_id long, digest string, payload_bytes long, refers_to string"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Line ends inside are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(type_: Column, record_id: Column, url: Column, page_id: Column, digest: Column, payload: Column, payload_bytes: Column, refers_to: Column, refers_to_url: Column) -> Column:
    """A WARC/1.1 record but for its last CR LF. A revisit's block is the HTTP header alone."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), payload_bytes.cast("string"), F.lit(CRLF * 2))
    block_bytes = F.octet_length(http) + F.when(type_ == "response", payload_bytes).otherwise(F.lit(0))
    revisit = type_ == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", type_),
        _header("WARC-Record-ID", record_id),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, refers_to)),
        _header("WARC-Refers-To-Target-URI", F.when(revisit, refers_to_url)),
        _header("X-Page-ID", page_id),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        _header("Content-Length", block_bytes),
        F.lit(CRLF),
        http,
        F.when(type_ == "response", payload).otherwise(F.lit("")),
        F.lit(CRLF),
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Writes records(value) as gzipped archives."""
    records.select("value").write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def _records(with_payload: bool):
    def parse(path: str, content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if content[:2] == b"\x1f\x8b" else raw
        place = 0
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {line[:40]!r}")
            head: dict[bytes, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.partition(b":")
                head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
            size = int(head[b"content-length"])
            block = stream.read(size)
            if len(block) < size:
                raise ValueError(f"{path}: a record ends early")
            kind = head.get(b"warc-type", "")
            payload = block
            if head.get(b"content-type", "").startswith("application/http"):
                _, _, payload = block.partition(b"\r\n\r\n")
            if kind == "revisit":
                payload, digest, length = b"", head.get(b"warc-payload-digest", "").rpartition(":")[2], None
            else:
                digest, length = hashlib.sha1(payload, usedforsecurity=False).hexdigest(), len(payload)
            page = head.get(b"x-page-id")
            yield path, place, kind, head.get(b"warc-record-id"), head.get(b"warc-target-uri"), int(page) if page else None, digest, length, head.get(b"warc-refers-to"), payload
            place += 1

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in _FIELDS.split(", ")] + ["payload"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[: 9 + with_payload]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for k in range(b.num_rows):  # one archive in memory at a time
                path, content, places = (c[k].as_py() for c in b.columns)
                skip = set(places or ())
                for row in parse(path, content):
                    if row[1] in skip:
                        continue
                    rows.append(row)
                    size += len(row[-1]) if with_payload else 0
                    if len(rows) >= 2000 or size > 8_000_000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """One row per record of the archives in a folder, by file and place in it, without the places that skip(file, places) has."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if skip is None:
        files = files.withColumn("places", F.lit(None).cast("array<long>"))
    else:
        files = files.join(skip, files["path"] == skip["file"], "left").select("path", "content", "places")
    return files.mapInArrow(_records(with_payload), _FIELDS + ", payload binary" * with_payload)


def deduplicated(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes the archives of source to target with all but one record of each payload of at least
    least_bytes as revisits of it: the response is the one with the largest page_id (nulls first; of
    equal ones the last by file and place). Up to BROADCAST_IDS revisits, their places go to the archives; beyond it the
    archives are shuffled by name, as they are compressed."""
    heads = written(read_archives(spark, source), "heads")
    one = F.max(F.struct("page_id", "file", "place", "url")).alias("to")
    responses = heads.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(one, F.count("*").alias("n")).filter("n > 1").drop("n")
    found = heads.filter(F.col("payload_bytes") >= least_bytes).join(responses, "digest").filter((F.col("file") != F.col("to.file")) | (F.col("place") != F.col("to.place")))
    revisits = written(found, "revisits")
    places = revisits.groupBy("file").agg(F.collect_list("place").alias("places"))
    skip = F.broadcast(places) if revisits.count() <= BROADCAST_IDS else places
    fresh = lambda file, place: _urn(F.lit("fresh"), F.element_at(F.split(F.col(file), "/"), -1), F.col(place))
    headers = (F.col("url"), F.col("page_id"), F.col("digest"))
    nothing = F.lit(None).cast("string")
    kept = read_archives(spark, source, with_payload=True, skip=skip)
    kept = kept.select(record(F.lit("response"), fresh("file", "place"), *headers, F.col("payload").cast("string"), F.col("payload_bytes"), nothing, nothing).alias("value"))
    again = revisits.select(record(F.lit("revisit"), fresh("file", "place"), *headers, F.lit(""), F.col("payload_bytes"), fresh("to.file", "to.place"), F.col("to.url")).alias("value"))
    write_archives(kept.union(again), target)
    for df in (heads, revisits):
        drop_written(df)


def revisits_resolved(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as archives, deduplicates them and reads the result: one row per
    page with page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url no header; a null page_id stays null; rows that repeat
    a page are records of their own, so all but one of them are revisits. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    first, second = fresh_path(spark, "archives"), fresh_path(spark, "deduplicated")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = F.octet_length(html)
    nothing = F.lit(None).cast("string")
    digest = F.sha1(html.cast("binary"))
    raw = record(F.lit("response"), _urn(F.lit("raw"), F.monotonically_increasing_id(), digest), F.col("url"), F.col("page_id"), digest, html, size, nothing, nothing)
    write_archives(pages.select(raw.alias("value")), first)
    deduplicated(spark, first, second, least_bytes)
    records = written(read_archives(spark, second), "records")
    for path in (first, second):
        drop_path(spark, path)
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type")]
    responses = records.filter("type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"))
    revisits = records.filter("type = 'revisit'").drop("payload_bytes").join(targets, "refers_to", "left").withColumnRenamed("of_bytes", "payload_bytes")
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).union(revisits.select(*columns, F.col("of_page").alias("refers_to")))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits_resolved(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS r FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> r THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> r THEN r END AS refers_to FROM m
"""
