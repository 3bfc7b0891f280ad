"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint sums the bits of the hashes of a text's shingles.  Two fingerprints link when they
differ in at most ``max_bits`` bits.  They are cut into ``max_bits // 2 + 1`` segments, so that at
least one segment of a linked pair differs in at most one bit.  Every segment is indexed as it is
and once for each of its bits left out.  An equality join on these keys meets every pair that
can link, and the whole fingerprints decide.

Groups of copies stay cheap.  Equal fingerprints are one vertex.  Vertices that share a segment are
first linked to a few central vertices of that segment only; the full join then emits a pair only
if its sides are not yet in one component, so a dense group yields a tree, not all its pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.components import connected_components
from equiframe.llm.shared import Stored, free_name, slices, text_key

LANE, SEED = 64, 42
CENTRES = 3  # vertices of a segment to which the others are linked first
SLICE_BYTES = 4 << 20
FEW_BYTES = 16 << 20  # of keys and digests of copies that are broadcast
BLOCK = 1 << 16  # hashes whose bytes are counted at once
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_in(text: bytes) -> list[bytes]:
    """Words of UTF-8 text between white space (space, 0x09 to 0x0D), A-Z in lower case."""
    return _WORD.findall(text.lower())


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Each run of ``width`` words, repeats included; all words if they are fewer; none for no words."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*[words[i:] for i in range(width)])]


def hashes_of(runs: list[bytes], lanes: int) -> np.ndarray:
    """XXH64 of each shingle, seed 42 for the first lane, 43 for the next, as ``(n, lanes)``."""
    return np.stack([
        np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED + x)), dtype="<u8", count=len(runs))
        for x in range(lanes)], axis=1)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes have, of hashes ``(n, lanes)``.

    Equal bytes at one place are counted first; each of the 256 values then adds its eight bits.
    """
    lanes = hashes.shape[1]
    places = np.arange(8 * lanes, dtype=np.int64) * 256
    counts = np.zeros(8 * lanes * 256, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[start:start + BLOCK]).view(np.uint8)
        counts += np.bincount((part + places).ravel(), minlength=len(counts))
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    on = (counts.reshape(-1, 256) @ bits.astype(np.int64)).ravel()
    return np.packbits(2 * on > len(hashes), bitorder="little").view("<i8").reshape(lanes)


def fingerprints(docs: DataFrame, key: list[str], text: str, width: int = 3, lanes: int = 1) -> DataFrame:
    """``(*key, text_key, f0 .. f{lanes-1})``, one row per row; ``text_key`` is the text's MD5.

    A bit is 1 if it is set in over half of the hashes.  Null, empty and blank texts have fingerprint zero.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE_BYTES):
            marks, found = [], []
            for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
                raw = value.as_py()
                marks.append(b"" if raw is None else hashlib.md5(raw).digest())
                found.append(_majority(hashes_of(shingles(words_in(raw or b""), width), lanes)))
            bits = np.array(found, dtype="<i8").reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(marks, pa.binary()), *[pa.array(bits[:, x]) for x in range(lanes)]],
                names=[*key, "text_key", *[f"f{x}" for x in range(lanes)]])

    rows = docs.select(*key, F.col(text).alias("_text"))
    kinds = [*rows.schema.fields[:-1], T.StructField("text_key", T.BinaryType()),
             *[T.StructField(f"f{x}", T.LongType()) for x in range(lanes)]]
    return rows.mapInArrow(fold, T.StructType(kinds))


def _signed(value: int) -> int:
    return value - (1 << LANE) if value >= 1 << (LANE - 1) else value


def _masks(bits: list[int], lanes: int) -> list[int]:
    """Bits of a fingerprint as one signed mask per lane."""
    return [_signed(sum(1 << (i % LANE) for i in bits if i // LANE == lane)) for lane in range(lanes)]


def _segments(lanes: int, max_bits: int) -> list[list[int]]:
    n, parts = LANE * lanes, max_bits // 2 + 1
    return [list(range(n * j // parts, n * (j + 1) // parts)) for j in range(parts)]


def _keys(lanes: int, max_bits: int, bit: int | None) -> Column:
    """Join keys of a fingerprint: segments as they are, and, if ``bit`` is given, segments without
    one of the bits that have this value."""
    tags = []
    for j, segment in enumerate(_segments(lanes, max_bits)):
        tags.append((j * 1000, *_masks(segment, lanes), *_masks([], lanes)))
        if bit is not None:
            tags += [(j * 1000 + 1 + k, *_masks([x for x in segment if x != i], lanes), *_masks([i], lanes))
                     for k, i in enumerate(segment)]
    names = ["tag", *[f"m{x}" for x in range(lanes)], *[f"b{x}" for x in range(lanes)]]
    table = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(t, names)]) for t in tags])
    if bit is not None:
        def fits(t: Column) -> Column:
            on = reduce(Column.bitwiseOR, [F.col(f"f{x}").bitwiseAND(t[f"b{x}"]) for x in range(lanes)])
            return (t["tag"] % 1000 == 0) | ((on != 0) if bit else (on == 0))
        table = F.filter(table, fits)
    return F.transform(table, lambda t: F.struct(
        F.xxhash64(t["tag"], *[F.col(f"f{x}").bitwiseAND(t[f"m{x}"]) for x in range(lanes)]).alias("key"),
        (t["tag"] % 1000 == 0).alias("whole")))


def components_of(vertices: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """``(vertex, component)`` of the vertices ``(vertex, f0 ..)`` that link with any other."""
    lane = [f"f{x}" for x in range(lanes)]

    def near(left: str, right: str) -> Column:
        return reduce(Column.__add__, [
            F.bit_count(F.col(f"{left}.{f}").bitwiseXOR(F.col(f"{right}.{f}"))) for f in lane]) <= max_bits

    whole = vertices.select("vertex", *lane, F.inline(_keys(lanes, max_bits, None))).drop("whole")
    shared = whole.join(whole.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    # The text that copies were made from shares all its segments with many of them, a copy only some.
    busy = shared.groupBy("vertex").agg(F.sum("n").alias("busy"))
    members = Stored(shared.drop("n").join(busy, "vertex"), "members")
    centres = members.frame.groupBy("key", F.pmod(F.xxhash64("vertex"), F.lit(CENTRES)).alias("part")).agg(
        F.max(F.struct("busy", F.xxhash64("vertex").alias("tie"), "vertex", *lane)).alias("c")).select("key", "c.vertex", *[f"c.{f}" for f in lane])
    stars = (
        members.frame.alias("x").join(centres.alias("y"), "key")
        .filter((F.col("x.vertex") != F.col("y.vertex")) & near("x", "y"))
        .select(F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b")).distinct()
    )
    starred = Stored(stars, "stars")
    members.drop()
    held = Stored(connected_components(starred.frame), "held")
    placed = vertices.join(held.frame, "vertex", "left").select(
        "vertex", F.coalesce("component", "vertex").alias("component"), *lane)
    left = placed.select("vertex", "component", *lane, F.inline(_keys(lanes, max_bits, 0))).alias("x")
    right = placed.select("vertex", "component", *lane, F.inline(_keys(lanes, max_bits, 1))).drop("whole").alias("y")
    meet = ((F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
            & (~F.col("x.whole") | (F.col("x.vertex") < F.col("y.vertex"))) & near("x", "y"))
    crossing = left.join(right, meet).select(
        F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b")).distinct()
    found = Stored(crossing, "crossing")
    held.drop()
    return connected_components(starred.frame.union(found.frame))


def _groups(docs: DataFrame, key: str, text: str, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(key, text_key, f0)`` of all rows, and ``(f0, group, low)`` of all fingerprints.

    Vertices are fingerprints, so a key with several texts ties none of them together.  ``group`` is the smallest
    fingerprint that links reach, ``low`` the smallest key of the group's rows.
    """
    held = Stored(fingerprints(docs.select(key, text), [key], text, width), "fingerprints")
    rows = held.frame.groupBy(key, "text_key").agg(F.first("f0").alias("f0"))
    vertices = Stored(held.frame.groupBy("f0").agg(F.min(key).alias("low")), "vertices").frame
    linked = Stored(components_of(vertices.select(F.col("f0").alias("vertex"), "f0"), 1, max_bits).withColumnRenamed(
        "vertex", "f0"), "linked").frame
    lowest = linked.join(vertices, "f0").groupBy("component").agg(F.min("low").alias("least"))
    named = linked.join(lowest, "component")
    groups = vertices.join(named, "f0", "left").select(
        "f0", F.coalesce("component", "f0").alias("group"), F.when(F.col("component").isNull(), F.col("low")).otherwise(
            F.col("least")).alias("low"))
    return rows, groups


def simhash_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3,
) -> DataFrame:
    """``(key, fingerprint, component_id)``: fingerprint groups of whole texts.

    Fingerprints are compared as they are, so blank texts (fingerprint zero) link like any others.
    ``component_id`` is the smallest key that links reach, the row's own included.  Rows that repeat
    key and text give one row; one key with several texts gives a row for each text.  A null key is a
    row as well, but it names no component.
    """
    rows, groups = _groups(docs, key, text, width, max_bits)
    return rows.join(groups, "f0", "left").select(
        key, F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3,
) -> DataFrame:
    """``docs`` with one document of each group of :func:`simhash_groups`, all columns.

    The one with the smallest key stays, null keys last; of several texts of that key the one with the smallest
    MD5.  Rows that repeat the key and text of a row that stays, stay with it: they are one document.  Blank and null texts
    are one group.
    """
    rows, groups = _groups(docs, key, text, width, max_bits)
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("text_key").alias("mark"))
    placed = Stored(rows.join(groups.select("f0", "group"), "f0").select("group", own.alias("own")), "placed").frame
    stays = Stored(placed.groupBy("group").agg(F.min("own").alias("stays"), F.count("*").alias("n")).filter("n > 1").drop("n"), "stays").frame
    mark, gone, gone_mark = (free_name(docs, n) for n in ("_mark", "_gone", "_gone_mark"))
    away = Stored(placed.join(stays, "group").filter(F.col("own") != F.col("stays")).select(
        F.col("own.key").alias(gone), F.col("own.mark").alias(gone_mark)), "copies").frame
    size = away.agg(F.sum(F.coalesce(F.octet_length(F.col(gone).cast("string")), F.lit(0)) + 48)).first()[0] or 0
    if size <= FEW_BYTES:  # texts then pass by and are not shuffled
        away = F.broadcast(away)
    marked = docs.withColumn(mark, text_key(F.col(text)))
    return marked.join(away, F.col(key).eqNullSafe(F.col(gone)) & (F.col(mark) == F.col(gone_mark)), "left_anti").drop(mark)
