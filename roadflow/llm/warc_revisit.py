"""WARC revisit resolution.

Archives are written and read with Spark's own text and binary readers, so any
store that Spark reaches will do.  Writing: payload digests are made where the
pages lie; only headers (id, size, digest) are shuffled by digest, and the
smallest id of a digest becomes the response.  The decisions are joined back by
page id, so that a payload shared by a third of all pages is not sent to one
task.  Each record is written with fresh headers; revisits carry no payload.

Archives are compressed, each as one gzip member.

Reading: every archive is parsed by its Content-Length fields, and revisit
records are joined by payload digest to the responses that hold their payload.

Defined results: a null payload is an empty one; payloads below ``min_bytes``
are all responses; of equal payloads every row that has the smallest page id is
a response (repeated rows of one page), the others revisit it; a null page id
counts as larger than all.  Control characters in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm.shared import scratch_path
from roadflow.session import cut_lineage

#: An archive has about so many bytes before compression; one record may exceed it.
ARCHIVE_BYTES = 32 << 20
#: No archive holds more than this many bytes of records of the largest size.
LARGEST_ARCHIVE = 512 << 20
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = ("page_id long, record_type string, payload_bytes long, payload_digest string, "
           "record_id string, refers_to_id string, target_uri string")


def base32_digest(payload: Column) -> Column:
    """Base32 SHA-1: ten hex digits are forty bits, which are eight base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(page: Column) -> Column:
    """A record id that a task which runs again makes anew."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_value(value: Column) -> Column:
    out = F.coalesce(value, F.lit("about:blank"))
    for c in "\r\n\t":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(out, r"[\x00-\x1F\x7F]", "%20")


def decide(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Headers (page_id, payload_bytes, payload_digest) with ``first``: the response of a revisit, else null."""
    firsts = headers.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    revisits = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & \
        ~F.col("page_id").eqNullSafe(F.col("first"))
    return headers.join(firsts, "payload_digest").select(
        "page_id", "payload_bytes", "payload_digest", F.when(revisits, F.col("first")).alias("first"))


def payload_headers(pages: DataFrame, id_col: str, payload: str) -> DataFrame:
    content = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.octet_length(content).cast("long").alias("payload_bytes"),
                        base32_digest(content).alias("payload_digest"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url",
                   payload: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write one record per row of ``pages`` as deduplicated archives under ``path``."""
    headers = cut_lineage(payload_headers(pages, id_col, payload))
    total = headers.agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"),
                        F.max("payload_bytes").alias("most")).first()
    mean = (total.bytes or 0) // max(total.n, 1) + 1024
    records = max(1, min(ARCHIVE_BYTES // mean, LARGEST_ARCHIVE // ((total.most or 0) + 1024)))
    decided = decide(headers, min_bytes).select(
        F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"),
        F.col("payload_bytes").alias("__bytes"), F.col("first").alias("__first")).distinct()
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), header_value(F.col(url)).alias("uri"),
                          text.alias("payload"), base32_digest(text.cast("binary")).alias("digest"))
    joined = source.join(decided, source.page_id.eqNullSafe(F.col("__id")) &
                         (source.digest == F.col("__digest")))
    revisit = F.col("__first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("__bytes").cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("__bytes"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    none = F.lit("")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(none),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("__first"))),
                                 line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")), F.lit("\r\n"), http,
        F.when(revisit, none).otherwise(F.col("payload")))
    # the record separator is the writer's line separator
    (joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records).text(path))


def parse(content: bytes) -> list[tuple]:
    """The records of one archive; payload sizes and digests of responses are taken from the payload itself."""
    if content.startswith(b"\x1f\x8b"):
        content = gzip.decompress(content)
    rows, at = [], 0
    while content.startswith(b"WARC/", at):
        end = content.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in content[at:end - 4].decode().split("\r\n")[1:])
        stop = end + int(fields["Content-Length"])
        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        size = None
        if fields["WARC-Type"] == "response":
            payload = memoryview(content)[content.index(b"\r\n\r\n", end, stop) + 4:stop]
            size = len(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        page = fields.get("WARC-Page-ID")
        rows.append((int(page) if page is not None else None, fields["WARC-Type"], size, digest,
                     fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI")))
        at = stop + 4
    if at != len(content):
        raise ValueError(f"no record at byte {at} of an archive of {len(content)}")
    return rows


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``; payloads stay in their tasks."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in HEADERS.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*parse(content.as_py()), strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, HEADERS)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Headers are shuffled by digest; a revisit takes the size of the response that
    holds its payload.
    """
    revisits = F.col("record_type") == "revisit"
    held = records.filter(~revisits).groupBy("payload_digest").agg(
        F.min("page_id").alias("__first"), F.max("payload_bytes").alias("__bytes"))
    return records.join(held, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest",
        "record_type", F.when(revisits, F.col("__first")).alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives (a new folder in the shared scratch folder unless given) and resolve them."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return resolve(cut_lineage(read_archives(spark, path)))
