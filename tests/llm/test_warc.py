import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from equiframe.llm import warc

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a/", "same"), (2, "http://b/é ?%20\n", "same"), (9, "http://c/", "same"), (3, None, None), (4, "http://d", ""),
    (5, "http://e", "WARC/1.1\r\n\r\nhtml \0 ü 漢" * 50), (6, "http://f", "x" * 3_000_000), (7, "http://g", "same\n"),
    (8, "http://h", "y" * 10), (None, "http://i", "same"),
]


def expected(rows):
    response = {}
    for page, _, html in rows:
        if page is not None:
            response[html or ""] = max(page, response.get(html or "", page))
    for page, _, html in rows:
        raw = (html or "").encode()
        other = page is not None and page < response[html or ""]
        yield (page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
               "revisit" if other else "response", response[html or ""] if other else None)


def test_round_trip(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = warc.read_records(index).collect()
    key = lambda r: repr(r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(
        expected(ROWS), key=key)
    by = {r.page_id: r for r in got}
    for page, url, html in ROWS:
        assert by[page].url == url
        if by[page].record_type == "response":
            assert bytes(by[page].payload) == (html or "").encode() and by[page].digest_holds
        else:
            assert by[page].payload is None


def test_index_and_selected_reads(spark):
    index = warc.write_archives(spark.createDataFrame([(i, f"http://{i}", f"page {i} " * (i % 50)) for i in range(500)], SCHEMA))
    rows = index.collect()
    for r in rows[:20]:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    got = warc.read_records(index, F.col("page_id") % 7 == 0, gap=0).select("page_id").collect()
    assert sorted(r.page_id for r in got) == list(range(0, 500, 7))


def test_tasks_follow_the_bytes(spark, monkeypatch):
    index = warc.write_archives(spark.createDataFrame([(i, f"http://{i}", f"page {i} " * (i % 50)) for i in range(500)], SCHEMA))
    monkeypatch.setattr(warc, "RANGE_BYTES", 8 << 10)
    read = warc.read_records(index)
    assert read.count() == 500 and read.rdd.getNumPartitions() > 5


def test_ranges():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (40, 5), (100, 5)], 25, 1000) == [(0, 45, 0, 2), (100, 5, 3, 3)]
    assert warc.coalesce_ranges([(0, 10), (10, 10)], 25, 15) == [(0, 10, 0, 0), (10, 10, 1, 1)]
    assert warc.coalesce_ranges([], 1, 1) == []


def test_small_payloads_are_not_shared(spark):
    index = warc.write_archives(spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long"), (4, "d", "long")], SCHEMA), least_bytes=3)
    assert {(r.page_id, r.record_type) for r in warc.read_records(index).collect()} == {
        (1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_empty(spark):
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
