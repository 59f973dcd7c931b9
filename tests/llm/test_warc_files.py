"""WARC files of others, and archives of this library read as others read them."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from skyframe.llm import warc


def record(kind, uri, block, extra="", content="application/http; msgtype=response", newline="\r\n"):
    head = (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\n"
            f"WARC-Record-ID: <urn:uuid:{hashlib.md5(uri.encode()).hexdigest()}>\r\n{extra}Content-Type: {content}\r\n"
            f"content-length: {len(block)}\r\n\r\n").replace("\r\n", newline)
    return head.encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
RECORDS = [record("warcinfo", "file", b"software: hand\r\n", content="application/warc-fields"),
           record("response", "http://b.example.org/x?y", HTTP + b"WARC/1.0 and\r\n\r\nmore \xff bytes"),
           record("response", "<http://a.example.org/>", HTTP + b"", newline="\n"),
           record("revisit", "http://c.example.org/", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", "WARC-Payload-Digest: sha1:ABCD\r\n"),
           record("resource", "http://d.example.org/big", b"z" * (3 << 20), content="image/png")]


@pytest.mark.parametrize("kind", ["plain", "whole", "each"])
def test_files_of_others_are_read(spark, tmp_path, kind):
    parts = [gzip.compress(r) for r in RECORDS] if kind == "each" else RECORDS
    data = b"".join(parts)
    (tmp_path / "x.warc").write_bytes(gzip.compress(data) if kind == "whole" else data)
    rows = warc.read_warc(spark, str(tmp_path / "x.warc")).orderBy("url").collect()
    got = {r["url"]: r for r in rows}
    assert len(rows) == 5
    page = got["http://b.example.org/x?y"]
    assert bytes(page["payload"]) == b"WARC/1.0 and\r\n\r\nmore \xff bytes"
    assert page["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(page["payload"])).digest()).decode()
    assert bytes(got["http://a.example.org/"]["payload"]) == b""
    assert (got["http://c.example.org/"]["payload"], got["http://c.example.org/"]["payload_bytes"],
            got["http://c.example.org/"]["payload_digest"]) == (None, 77, "ABCD")
    assert got["http://d.example.org/big"]["payload_bytes"] == 3 << 20
    if kind == "each":  # a member can be read from the place that the index gives
        at = got["http://d.example.org/big"]["offset"]
        assert gzip.decompress(data[at:]) == RECORDS[4]
    if kind == "plain":
        assert data[page["offset"]:].startswith(RECORDS[1])
    index = warc.merge_runs(warc.sorted_runs(warc.read_warc(spark, str(tmp_path))), range_rows=2).collect()
    keys = [r["url_key"] for r in index]
    assert keys == sorted(keys) and len(keys) == 5


def test_cut_off_files_are_an_error(spark, tmp_path):
    (tmp_path / "cut.warc").write_bytes(RECORDS[1][:-40])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_own_archives_are_warc_files(spark, tmp_path):
    rows = [(1, "http://x.example/a", "page é one"), (2, None, ""), (3, "http://x.example/b", "page é one"), (4, "http://y.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("captured", F.timestamp_seconds(F.lit(86400)))
    path = str(tmp_path / "own")
    mark = warc.write_archives(pages, path)
    columns = ["page_id", "url", "time", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def rows_of(df):
        return sorted(map(str, df.select(*columns).collect()))
    assert rows_of(warc.read_warc(spark, path)) == rows_of(warc.read_archives(spark, path, mark))


def test_records_are_read_from_their_places(spark, tmp_path):
    """Files are split anywhere, and every record can be read alone, by us and by gzip."""
    rows = [(i, f"http://h{i % 9}.example/{i}", "".join(chr(97 + (i * j * j) % 23) for j in range(i % 700))) for i in range(1500)]
    pages = (spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
             .withColumn("captured", F.timestamp_seconds(F.col("page_id") * 86399)))
    path = str(tmp_path / "own")
    mark = warc.write_archives(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        back = warc.read_archives(spark, path, mark)
        assert back.rdd.getNumPartitions() > 20
        got = {r["page_id"]: r for r in back.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1500
    assert {r["page_id"]: (r["offset"], r["archive"]) for r in warc.read_warc(spark, path).collect()} == {
        i: (r["offset"], r["archive"]) for i, r in got.items()}
    for i in (0, 7, 1499):
        data = (tmp_path / "own" / got[i]["archive"]).read_bytes()
        (_, fields, _), = warc.warc_records(io.BytesIO(data[got[i]["offset"]:got[i]["offset"] + got[i]["length"]]))
        assert fields["warc-record-id"] == f"<urn:page:{i}>"
    index = warc.merge_runs(warc.sorted_runs(warc.read_archives(spark, path, mark, payloads=False)), range_rows=400)
    found = warc.fetch(index.where("page_id % 10 = 3"), path).collect()
    assert len(found) == 150 and all(r == got[r["page_id"]] for r in found)


def test_times_are_utc_and_urls_are_kept(spark, tmp_path):
    rows = [(1, "http://x.example/a b", 1), (2, " http://x.example/ ", 1_700_000_000), (3, None, None), (4, "", -86400)]
    pages = (spark.createDataFrame(rows, "page_id long, url string, s long").withColumn("captured", F.timestamp_seconds("s"))
             .withColumn("html", F.lit("x")))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        path = str(tmp_path / "own")
        mark = warc.write_archives(pages, path)
        got = warc.read_archives(spark, path, mark).select("page_id", "url", F.unix_seconds("time").alias("s")).orderBy("page_id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r) for r in got] == [(1, "http://x.example/a b", 1), (2, "http://x.example/", 1_700_000_000), (3, None, 0), (4, "", -86400)]
    dates = [f["warc-date"] for p in (tmp_path / "own").glob("part-*") for _, f, _ in warc.warc_records(io.BytesIO(p.read_bytes()))]
    assert "2023-11-14T22:13:20Z" in dates and "1969-12-31T00:00:00Z" in dates
