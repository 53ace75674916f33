"""The archive gives back the records, and stores each payload once."""

import hashlib

import pytest

from pactum.llm import warc
from pactum.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload string"
BIG = "<p>é</p>" * 200


def test_round_trip(spark):
    rows = [(1, "http://a/1", BIG, ""), (2, "http://a/2", BIG, ""), (7, None, BIG, None), (3, "http://a/3", "small", ""), (4, "u", "small", ""), (5, "u", None, ""), (6, "u\r\nX: y", "", ""), (8, "u", BIG + "x", ""), (8, "u", BIG + "x", ""), (None, "u", BIG, "")]
    path = new_path(spark, "t")
    warc.write(spark.createDataFrame(rows, SCHEMA), path)
    assert warc.payloads(spark, path).count() == 4
    index = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.index(spark, path).collect()}
    n = len(BIG.encode())
    assert index == {(1, "revisit", 7, n), (2, "revisit", 7, n), (7, "response", None, n), (None, "revisit", 7, n), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0), (8, "response", None, n + 1)}
    found = warc.records(spark, path).collect()
    assert len(found) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in found:
        assert bytes(r.payload) == html[r.page_id]
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
        assert rest.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(rest) - 4
        assert rest[:-4].endswith(bytes(r.payload)) or r.record_type == "revisit"


def test_damage_is_found(spark):
    path = new_path(spark, "t")
    warc.write(spark.createDataFrame([(1, "u", BIG, "")], SCHEMA), path)
    worse = new_path(spark, "t")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{worse}/headers")
    from pyspark.sql import functions as F

    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{worse}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.index(spark, worse).collect()


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
