"""WARC archives: written with an index, read back by coalesced byte ranges.

Every task writes one archive of gzip members, one per record, under a name of its own, and returns
the index rows ``(file, offset, length, url, digest, ...)``.  Only the rows of tasks whose work
Spark has committed reach the index; what a lost attempt wrote is never read.  A reader sorts the
index rows it wants by file and offset, joins near ranges into one read, and cuts the records out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiframe.functions.scale import shared_path
from equiframe.llm.shared import Stored, slices

INDEX = ("file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, "
         "payload_bytes bigint")
RECORD = ("file string, offset bigint, record_type string, page_id bigint, url string, refers_to bigint, "
          "payload_digest string, payload_bytes bigint, payload binary, digest_holds boolean")
DATE = "2000-01-01T00:00:00Z"  # the tables carry no time of capture
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
BATCH_BYTES = 8 << 20
RANGE_BYTES = 16 << 20  # of compressed records that a task reads
MOST_RANGES = 50_000


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP head alone."""
    head = HTTP.format(len(payload)).encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if url is None:
        fields[4:5] = []
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: {_name(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# Everything printable stays as it is; control characters, spaces and % are encoded and so come back.
_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def parse(raw: bytes) -> dict:
    """The fields of one record and its payload (none for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    url = fields.get("WARC-Target-URI")
    return {
        "record_type": kind, "page_id": _page(fields["WARC-Record-ID"]), "url": None if url is None else unquote(url),
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": digest, "payload_bytes": size, "payload": body if kind == "response" else None,
        "digest_holds": len(body) == size and digest_of(body) == digest if kind == "response" else None,
    }


def _with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``(page_id, url, html, refers_to, revisit)``: of equal payloads the largest page id is the response.

    Pages are told apart by SHA-1 and length.  Pages without an id are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.select("page_id", "url", payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1"),
                          F.octet_length(payload).cast("bigint").alias("bytes"))
    # Only payloads that occur more than once need a partner; their summary is joined, other rows find none.
    shared = (
        marked.filter((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha1", "bytes").agg(F.max("page_id").alias("response"), F.min("page_id").alias("low"))
        .filter("response > low").drop("low")
    )
    joined = marked.join(Stored(shared, "shared").frame, ["sha1", "bytes"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("response"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("response")).alias("refers_to"),
                         revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write a record per row of ``pages (page_id, url, html)`` and return the stored index.

    Null html is an empty payload.  Of records with equal payloads of ``least_bytes`` at least, the one
    with the largest page id is a response and the others revisit it; rows that repeat a page id and its
    payload are alike.  A null url leaves the URL field out.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = place = file = None
        offset = 0
        try:
            for batch in slices(batches, "html", BATCH_BYTES):
                if file is None:
                    store, place = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    file = store.open_output_stream(place, compression=None)
                rows = []
                for row in batch.to_pylist():
                    payload = row["html"].encode()
                    member = gzip.compress(
                        record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"]), level, mtime=0)
                    file.write(member)
                    rows.append({
                        "file": f"{folder}/{place.rpartition('/')[2]}", "offset": offset, "length": len(member),
                        "url": row["url"], "digest": digest_of(payload), "page_id": row["page_id"],
                        "record_type": "revisit" if row["revisit"] else "response", "payload_bytes": len(payload)})
                    offset += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
        finally:
            if file is not None:
                file.close()

    return Stored(_with_roles(pages, least_bytes).mapInArrow(write, INDEX), "warc-index").frame


_INDEX_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64())])
_RECORD_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("payload", pa.binary()), ("digest_holds", pa.bool_())])


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted ``(offset, length)`` joined into reads ``(offset, length, first, last)`` over no gap above ``gap``;
    a read of several records holds ``most`` bytes at most."""
    reads: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads:
            start, held, first, _ = reads[-1]
            if offset - (start + held) <= gap and offset + length - start <= most:
                reads[-1] = (start, max(held, offset + length - start), first, i)
                continue
        reads.append((offset, length, i, i))
    return reads


def read_records(
    index: DataFrame, where: Column | None = None, gap: int = 64 << 10, most: int = BATCH_BYTES,
    ranges: int | None = None,
) -> DataFrame:
    """The records that the index rows (those that hold ``where``) name, one row each.

    Rows are dealt out by ranges of file and offset, so that near records meet in a task; there is a range for
    every ``RANGE_BYTES`` that the wanted records have in the archives.
    """
    wanted = (index if where is None else index.filter(where)).select("file", "offset", "length")
    if not ranges:
        total = wanted.agg(F.sum("length")).first()[0] or 0
        ranges = max(1, min(MOST_RANGES, -(-total // RANGE_BYTES)))
    dealt = wanted.repartitionByRange(ranges, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        try:
            for batch in batches:
                rows = batch.to_pylist()
                start = 0
                while start < len(rows):
                    end = start
                    while end < len(rows) and rows[end]["file"] == rows[start]["file"]:
                        end += 1
                    part, start = rows[start:end], end
                    if part[0]["file"] != name:
                        if stream is not None:
                            stream.close()
                        name = part[0]["file"]
                        store, place = fs.FileSystem.from_uri(name)
                        stream = store.open_input_file(place)
                    for offset, length, first, last in coalesce_ranges(
                            [(r["offset"], r["length"]) for r in part], gap, most):
                        data = stream.read_at(length, offset)
                        yield pa.RecordBatch.from_pylist([
                            {"file": name, "offset": r["offset"], **parse(gzip.decompress(
                                data[r["offset"] - offset:r["offset"] - offset + r["length"]]))}
                            for r in part[first:last + 1]], schema=_RECORD_ARROW)
        finally:
            if stream is not None:
                stream.close()

    return dealt.mapInArrow(read, RECORD)
