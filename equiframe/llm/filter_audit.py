"""Filter interaction audit: what each filter removes in every order of the filters.

A text's own filters are one pass over the texts, which keeps a bit mask and a SHA-256 digest per row.
Whether an earlier row has the same text is found out in two steps.  Each task counts the digests of
its rows in a counting Bloom sketch whose counters stop at two; the merged counters clear every
text whose counters are not all at two, for it is certainly unique.  Only rows that may repeat
are shuffled, by the digest of the full text, for the smallest id of each text.  Masks are then
added up, and the counts of the masks answer all orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.shared import Stored, slices

FILTERS = "ABCDE"  # the bit of a filter in a mask is its place here
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point
SLICE_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
HASHES, CELLS_PER_ROW = 3, 8  # of unique texts about 3 in 100 pass for possible repeats
SECTION = 1 << 16
MOST_CELLS = 1 << 28  # 32 MB of merged bits, whatever the table; a fuller sketch clears fewer rows and loses none
FLUSH_ROWS = 1 << 18


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces cut behind white space, of about a megabyte unless a single word is longer."""
    start = 0
    while start < len(raw):
        end = start + PIECE_BYTES
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[start:end]
        start = end


def own_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails.

    A: under 100 words; B: under 80 distinct words in 100; C: over 10 of A-Z in 100 code points; D: holds
    one of ``#$%&*|``.  Words stand between white space (space, 0x09 to 0x0D), as ``bytes.split`` cuts them.
    """
    words, distinct = 0, set()
    for piece in _pieces(raw):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    points = len(raw.translate(None, CONTINUED))
    return ((words < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(raw.translate(None, MARKS)) < len(raw)) << 3)


def marked(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``(doc_id, part, mask, digest)`` of every row: its own filters and the SHA-256 of the full text."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            masks, digests = [], []
            for value in batch.column(2).cast(pa.binary()):
                raw = value.as_py()
                masks.append(own_mask(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = [*rows.schema.fields[:2], T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]
    return rows.mapInArrow(fold, T.StructType(kinds))


def cell_count(rows: int, most: int = MOST_CELLS) -> int:
    """Counters for so many rows, a power of two."""
    return min(most, max(SECTION, 1 << (CELLS_PER_ROW * rows - 1).bit_length()))


def cells_of(digests: pa.Array, cells: int) -> np.ndarray:
    """The counters of each digest, ``(n, HASHES)``."""
    words = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(len(digests), -1)
    return (words[:, :HASHES] & np.uint64(cells - 1)).astype(np.int64)


def repeated_cells(digests: DataFrame, cells: int) -> np.ndarray:
    """One bit for each counter of the merged sketch: whether it stands at two or more.

    A task adds up its own rows and hands on each counter it has touched, at most twice.  Counters are merged
    by sections of 65,536, so a text that holds a third of all rows is a few counters of each task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(cells_of(batch.column(0), cells).ravel())
            rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield _sections(held)
                held, rows = [], 0
        if held:
            yield _sections(held)

    def merge(pieces: pa.Table) -> pa.Table:
        touched = np.frombuffer(b"".join(pieces.column("cells").to_pylist()), dtype="<u2")
        often = np.packbits(np.bincount(touched, minlength=SECTION) >= 2, bitorder="little")
        return pa.table({"section": pieces.column("section")[:1], "often": pa.array([often.tobytes()], pa.binary())})

    found = digests.mapInArrow(count, "section int, cells binary").groupBy("section").applyInArrow(
        merge, "section int, often binary").toArrow()
    bits = np.zeros((cells // SECTION, SECTION // 8), dtype=np.uint8)
    for section, often in zip(found["section"].to_pylist(), found["often"].to_pylist()):
        bits[section] = np.frombuffer(often, dtype=np.uint8)
    return bits.ravel()


def _sections(held: list[np.ndarray]) -> pa.RecordBatch:
    """Touched counters by section, each at most twice."""
    touched = np.sort(np.concatenate(held))
    touched = touched[np.concatenate([np.ones(min(2, len(touched)), bool), touched[2:] != touched[:-2]])]
    sections, starts = np.unique(touched // SECTION, return_index=True)
    parts = np.split((touched % SECTION).astype("<u2"), starts[1:])
    return pa.RecordBatch.from_arrays(
        [pa.array(sections.astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["section", "cells"])


def with_repeats(rows: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """``(doc_id, part, mask)`` of the rows of :func:`marked`, with the bit of E where a smaller id has the same text.

    ``rows`` have to be written, as several jobs read them.  A null id is neither smaller nor larger.
    """
    cells = cell_count(max(1, rows.count()), most_cells)
    often = repeated_cells(rows.select("digest"), cells)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells_of(batch.column(3), cells)
            may = (often[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], names=[*batch.schema.names, "may_repeat"])

    checked = Stored(rows.mapInArrow(check, T.StructType([*rows.schema.fields, T.StructField("may_repeat", T.BooleanType())])),
                     "checked").frame
    possible = checked.filter("may_repeat")
    first = Stored(possible.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"),
                   "first-ids").frame
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return possible.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + repeat).alias("mask")).union(
        checked.filter("not may_repeat").select("doc_id", "part", "mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per mask, and those that a label calls good or toxic.

    An id with several labels is good, or toxic, if one of them says so.
    """
    known = labels.groupBy(F.col(key).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def all_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit's rows from mask counts: every part, order and step."""
    orders = F.explode(F.split(F.lit(",".join(map("".join, permutations(filters)))), ","))
    bit = {c: 1 << i for i, c in enumerate(filters)}
    value = F.create_map(*[F.lit(x) for pair in bit.items() for x in pair])
    each = (
        counts.withColumn("filter_order", orders)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("own", value[F.expr("substring(filter_order, step, 1)")])
        .withColumn("before", F.aggregate(
            F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda s, c: s + value[c]))
    )
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    # A row is removed by each filter that it fails in an equal share of all orders.
    share = F.lit(len(list(permutations(filters)))) / F.greatest(F.bit_count("mask"), F.lit(1))

    def total(amount: Column, where: Column) -> Column:
        return F.sum(F.when(where, amount).otherwise(0)).cast("bigint")

    return each.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~fails & ~gone).alias("kept"), total(F.col("n"), removed).alias("removed"),
        total(F.col("n"), fails & gone).alias("redundant"), total(F.col("n"), F.col("mask") == F.col("own")).alias("unique_fails"),
        total(F.col("good"), removed).alias("good_lost"), total(F.col("toxic"), removed).alias("toxic_lost"),
        total(F.col("n") * F.round(share).cast("bigint"), fails).alias("shapley"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", most_cells: int = MOST_CELLS,
) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    One row per part, order of the five filters and step, zeros included; an empty table has no parts.  Null
    text is empty text, a null part is the part ``""``.  Every row of ``docs`` counts, repeated ones too; of
    rows that repeat id and text none is an earlier one of the other.  ``shapley`` adds up what the step's
    filter removes over all orders.  Ids without a label count as neither good nor toxic.  Other columns are
    not read.  At most ``most_cells / 8`` bytes of the sketch go to the driver and to each task.
    """
    rows = Stored(marked(docs, key, text, part), "marked").frame
    return all_orders(mask_counts(with_repeats(rows, most_cells), labels, key))
