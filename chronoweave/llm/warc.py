"""Web archives: records with payload digests, revisit resolution, and deduplicated archives with fresh headers.

Archives are written by Spark's text writer with the record separator of the format as line separator, one gzip member per
file, so they land in any file system that Spark knows, under its commit protocol.  They are read as
whole files (at most ``RECORDS`` records of one partition each) and cut by Content-Length.

Resolution moves headers only: page ids and digests are grouped by digest (partially aggregated first) to find the response of each
payload, and joined back with a join whose hot digests Spark may split.  Payloads are moved once, by page id.

Defined cases: a null payload is an empty one; equal payloads below ``min_bytes`` are all responses; of equal ones the largest page id
is the response (rows that repeat a page id: each is written, and all rows with that largest id are responses); a null page id
counts as smaller than any other; a null url is written as ``urn:page:<id>``; other columns are ignored; empty tables give no archives' rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Records of one archive file at most.
RECORDS = 2048
RECORD_END = "\r\n\r\n"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HEADERS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1, by built-in functions: each five hexadecimal digits are four digits to base 32."""
    digest = F.sha1(payload)
    quads = [F.upper(F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")) for i in range(8)]
    return F.translate(F.concat(*quads), _DIGITS, _BASE32)


def describe(pages: DataFrame) -> DataFrame:
    """Pages with payload text, its length in bytes and its digest; ``cw_row`` tells rows apart that repeat a page id."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers (page_id, payload_bytes, payload_digest) with record_type and refers_to.

    The number of rows that share a digest is not bounded: the group's response is a partially aggregated maximum, and the join back to
    it can be split where a digest is hot.
    """
    shared = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.max("page_id").alias("cw_response"), F.count("*").alias("cw_copies")
    )
    shared = shared.where("cw_copies > 1").select(F.col("payload_digest").alias("cw_digest"), "cw_response")
    found = headers.join(shared, F.col("payload_digest") == F.col("cw_digest"), "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("cw_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("cw_response"))
    return found.select(
        *headers.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("cw_response")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Writes records (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) as gzipped WARC files."""
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"[\r\n]", "")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("payload"))
    text = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type",
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "payload_digest",
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("refers_to")
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body,
    )
    records.select(text.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _records(data: bytes) -> Iterator[tuple]:
    """The records of one file's bytes, cut by Content-Length: id, url, type, bytes and digest of the payload, and the id referred to."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.decode().partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        payload = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        at = end + 8 + size
        page, other = (None if x in (None, "none") else int(x) for x in (_page(head.get("warc-record-id")), _page(head.get("warc-refers-to"))))
        said = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != said:
                raise ValueError(f"payload of page {page} does not match its digest")
            yield page, head["warc-target-uri"], "response", size, digest, None
        else:
            yield page, head["warc-target-uri"], "revisit", None, said, other


def _page(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") if urn else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records of the archives under ``path``; payload_bytes is null for revisits until they are resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        for batch in batches:
            for content in batch.column(0):
                rows = list(_records(gzip.decompress(content.as_py())))
                columns = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, HEADERS)


def with_payload_sizes(headers: DataFrame) -> DataFrame:
    """Fills payload_bytes of revisits from the responses they refer to, by digest; only headers are moved."""
    responses = headers.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("cw_digest")).agg(F.max("payload_bytes").alias("cw_bytes"))
    # Responses keep their own size, so only revisits are joined, and a hot digest can be split.
    revisits = headers.where("record_type = 'revisit'").join(responses, F.col("payload_digest") == F.col("cw_digest"))
    revisits = revisits.withColumn("payload_bytes", F.col("cw_bytes")).drop("cw_digest", "cw_bytes")
    return headers.where("record_type = 'response'").unionByName(revisits)


def deduplicated_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives in which each payload is stored once, and returns the resolved headers read back from them."""
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    described = describe(pages)
    headers = described.select("page_id", "payload_bytes", "payload_digest")
    # Decisions are needed for rows of shared payloads only; a page id that repeats has one decision for each digest.
    revisits = resolve_revisits(headers, min_bytes).where("record_type = 'revisit'")
    revisits = revisits.groupBy(F.col("page_id").alias("cw_page"), F.col("payload_digest").alias("cw_digest")).agg(F.max("refers_to").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("cw_page")) & (F.col("payload_digest") == F.col("cw_digest"))
    records = described.join(revisits.hint("shuffle_hash"), same, "left").withColumn(
        "record_type", F.when(F.col("cw_digest").isNotNull(), "revisit").otherwise("response")
    )
    write_archives(records, path)
    return with_payload_sizes(written(read_archives(spark, path)))
