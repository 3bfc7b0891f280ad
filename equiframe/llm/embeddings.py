"""Embedding near-duplicates by random-hyperplane sign hashing.

Each table hashes a vector to the signs of ``bits`` projections.  Vectors that meet in a table are
compared by exact cosine.  The number of bits follows the number of distinct vectors, so that the
expected occupancy of a hash value stays the same at every size, and the number of tables follows
from the bits and the wanted recall at the threshold.

Equal vectors are one class, compared once; the class size enters the link counts.  A row of a table carries the
hash values of the first few tables, so a pair that has met in one of them is not joined again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.components import connected_components
from equiframe.llm.shared import Stored

CARRIED = 8  # tables whose hash values every row carries


def plan_tables(vectors: int, threshold: float, recall: float, spare_bits: int = 4) -> tuple[int, int]:
    """``(bits, tables)``: hash values outnumber the vectors, tables reach ``recall`` at the threshold."""
    bits = max(8, math.ceil(math.log2(max(2, vectors))) + spare_bits)
    same_side = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-(same_side ** bits)))


def _hashed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``(key, at, class, s0, s1, ...)`` per table ``at``; ``s`` are the hash values of the first tables."""
    carried = min(CARRIED, tables)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.left_shift(np.uint64(1), np.arange(bits, dtype=np.uint64))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((size, tables * bits))
                for start in range(0, len(rows), 256):
                    part = rows[start:start + 256]
                    vectors = np.stack([flat[ends[i]:ends[i] + size] for i in part]).astype(np.float64)
                    vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the product
                    signs = (vectors @ planes[size] >= 0).reshape(len(part), tables, bits)
                    values = (signs * weights).sum(axis=2, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))),
                         pa.array(np.full(len(part) * tables, size, np.int32)),
                         pa.array(values.ravel()), pa.array(np.repeat(ids[part], tables)),
                         *[pa.array(np.repeat(values[:, i], tables)) for i in range(carried)]],
                        names=["at", "dim", "value", "class", *[f"s{i}" for i in range(carried)]])

    signed = classes.select("class", "vector").mapInArrow(sign, ", ".join(
        ["at int, dim int, value bigint, class bigint", *[f"s{i} bigint" for i in range(carried)]]))
    return signed.select(F.xxhash64("at", "dim", "value").alias("key"), "at", "class", *[f"s{i}" for i in range(carried)])


def _meetings(hashed: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of classes that share a hash value, each pair once.

    A pair is left out of a table if it has met in an earlier one of those that rows carry; ``distinct``
    sees the few that meet only in later tables.
    """
    x, y = hashed.alias("x"), hashed.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.class") < F.col("y.class"))
    for i in range(sum(c.startswith("s") for c in hashed.columns)):
        meet &= (F.col("x.at") <= i) | (F.col(f"x.s{i}") != F.col(f"y.s{i}"))
    return x.join(y, meet).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _cosine(x: Column, y: Column) -> Column:
    """In double precision; both are scaled by their largest component first, so no square overflows."""
    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def embedding_groups(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
    recall: float = 0.995, seed: int = 7,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per key.

    ``n_links`` counts the other vectors whose cosine is found to be at least ``threshold``,
    ``component_id`` is the smallest key that links reach, ``kept`` says it is the row's own.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths.  Rows that repeat a key are one vector, the smallest that is not null.  Null keys
    are one row that is never kept and links with nothing.
    """
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall lie between 0 and 1")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("raw")).groupBy("key").agg(
        F.min("raw").alias("raw"))
    largest = F.array_max(F.transform("raw", F.abs))
    sound = (F.size("raw") > 0) & ~F.exists("raw", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (largest > 0)
    rows = rows.withColumn("vector", F.when(sound, F.transform("raw", lambda v: v / largest)))
    usable = rows.filter(F.col("vector").isNotNull() & F.col("key").isNotNull())
    classes = Stored(usable.groupBy("raw").agg(
        F.min("key").alias("class"), F.count("*").alias("members"), F.first("vector").alias("vector")), "classes").frame
    bits, tables = plan_tables(classes.count(), threshold, recall)
    hashed = Stored(_hashed(classes, bits, tables, seed), "hashed").frame
    met = _meetings(hashed)
    known = classes.select("class", "members", "vector")
    compared = (
        met.join(known.select(F.col("class").alias("a"), F.col("members").alias("m"), F.col("vector").alias("v")), "a")
        .join(known.select(F.col("class").alias("b"), F.col("members").alias("n"), F.col("vector").alias("w")), "b")
        .filter((F.size("v") == F.size("w")) & (_cosine(F.col("v"), F.col("w")) >= threshold))
        .select("a", "b", "m", "n")
    )
    links = Stored(compared, "links").frame
    counts = (
        links.select(F.col("a").alias("class"), F.col("n").alias("other"))
        .union(links.select(F.col("b").alias("class"), F.col("m").alias("other")))
        .groupBy("class").agg(F.sum("other").alias("others"))
    )
    groups = connected_components(links).withColumnRenamed("vertex", "class")
    placed = (
        classes.select("raw", "class", "members").join(counts, "class", "left").join(groups, "class", "left")
        .select("raw", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                F.coalesce("component", "class").alias("component_id"))
    )
    joined = rows.filter("key is not null and vector is not null").join(placed, "raw").select("key", "n_links", "component_id")
    alone = rows.filter("key is null or vector is null").select(
        "key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
