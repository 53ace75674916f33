"""A content-addressed web archive.

Two tables make the archive. `payloads` holds each payload's bytes once, under the
SHA-256 of the bytes and their number; that equal keys do have equal bytes is
verified while they are gathered (the least and the greatest payload of a key are
the same bytes). `headers` holds the exact header bytes of every WARC record with
the key of its payload. `records` joins the two and gives back each original
record: a response's header, its payload and the closing line ends; a revisit has
no block of its own, and its payload is that of the record that it refers to.

Only payloads of at least `min_revisit` bytes are written as revisits; the record
with the largest page_id among equal payloads is the response.

Defined results: null html is an empty payload; a null url an empty target; rows
that share the largest page_id of a payload are all responses; a null page_id
never becomes a response that others refer to, unless no page_id of its payload is
set, and is then a response itself; an empty table gives empty archives; further
columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.common import new_path

MIN_REVISIT = 1000
#: The date of records of pages that have none.
NO_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def _with_payload(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload")).withColumns(
        {"payload_sha256": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )


def _header(kind: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    block = F.octet_length(http) + F.when(kind == "response", F.col("payload_bytes")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record(F.col("response_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    return F.encode(head, "UTF-8")


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = NO_DATE) -> None:
    """Write the archive of pages below path, as the tables `payloads` and `headers`."""
    spark = pages.sparkSession
    rows = _with_payload(pages, page_id, url, html)
    # Equal payloads meet once per task before the shuffle, however many rows hold them.
    stored = rows.groupBy("payload_sha256", "payload_bytes").agg(F.min("payload").alias("payload"), F.max("payload").alias("_other"), F.max("page_id").alias("response_id"))
    verified = F.when(F.col("payload") == F.col("_other"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("payload_sha256"))).cast("binary"))
    stored.select("payload_sha256", "payload_bytes", F.sha1("payload").alias("payload_sha1"), "response_id", verified.alias("payload")).write.parquet(f"{path}/payloads")
    keys = spark.read.parquet(f"{path}/payloads").select("payload_sha256", "payload_bytes", "payload_sha1", "response_id")
    kind = F.when((F.col("payload_bytes") >= min_revisit) & (F.col("page_id").eqNullSafe(F.col("response_id")) == F.lit(False)), F.lit("revisit")).otherwise(F.lit("response"))
    small = rows.drop("payload").join(keys, ["payload_sha256", "payload_bytes"])
    small.select("page_id", "payload_sha256", "payload_bytes", _header(kind, date).alias("header")).write.parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; one whose bytes no longer have their digest fails the read."""
    t = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("payload_sha256")
    return t.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_sha256"))).cast("binary")))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' header fields, parsed from the exact header bytes."""
    t = spark.read.parquet(f"{path}/headers").withColumn("head", F.decode("header", "UTF-8"))
    field = lambda name: F.regexp_extract("head", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    page = lambda name: F.regexp_extract("head", f"\\r\\n{name}: <urn:page:(-?[0-9]+)>\\r\\n", 1)
    number = lambda x: F.when(x != "", x).cast("long")
    return t.select(number(page("WARC-Record-ID")).alias("page_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("url"), number(page("WARC-Refers-To")).alias("refers_to"), "payload_sha256", F.col("payload_bytes"), "header")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every original record with its full payload: `record` holds a response's exact bytes, or a revisit's header."""
    t = headers(spark, path).join(payloads(spark, path).select("payload_sha256", "payload_bytes", "payload"), ["payload_sha256", "payload_bytes"])
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return t.select("page_id", "url", "record_type", "refers_to", "payload", F.concat("header", block, end).alias("record"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record with the length and SHA-1 of its full payload, worked out from the stored bytes once per payload."""
    facts = payloads(spark, path).select("payload_sha256", F.col("payload_bytes").alias("_n"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    t = headers(spark, path).withColumnRenamed("payload_bytes", "_n").join(facts, ["payload_sha256", "_n"])
    return t.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive(pages: DataFrame) -> DataFrame:
    """Write pages into a new archive in the shared folder and read its index back."""
    path = new_path(pages.sparkSession, "archive")
    write(pages, path)
    return index(pages.sparkSession, path)
