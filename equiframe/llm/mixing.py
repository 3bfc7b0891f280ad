"""Mixing sources to target weights.

Sizes are added up per source, targets follow from weights, and the repetition rate of a source is
its target over its size.  A document is taken floor(rate) times, and once more if the hash of
its key falls below the rate's fraction.  Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiframe.functions.scale import lookup_join
from equiframe.llm.shared import WORD, Stored, free_name

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``rank`` from 0, in order of code points, null last.

    Ranges are sorted apart from each other; only their sizes, one row per range, are added up in order.
    """
    ordered = Stored(values.orderBy(F.col(column).asc_nulls_last())
                     .withColumn("_at", F.monotonically_increasing_id()), "ranked").frame
    placed = ordered.withColumn("_range", F.shiftright("_at", 33)).withColumn(
        "_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_in")).drop(
        "_at", "_range", "_in", "_n", "_before")


def source_targets(
    sizes: DataFrame, source: str, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS,
) -> DataFrame:
    """``(source, source_size, target, rate)`` from one row ``(source, source_size)`` per source.

    Targets share the total of all sizes by weight, stop at ``most`` times their source's size, and what
    lies above is shared again by weight until no target is above.  A round settles at least one source,
    and rounds end with the first that settles none; rows never leave the executors, two sums do.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights must be positive and repeats at least 1")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = Stored(ranked(sizes, source).withColumn("weight", weight.cast("bigint")).drop("rank"), "targets").frame
    cap = F.col("source_size") * most
    total = held.agg(F.sum("source_size")).first()[0] or 0
    rest, free, settled = total, held.agg(F.sum("weight")).first()[0] or 0, F.lit(False)
    while free:
        above = settled | (cap.cast("double") < F.lit(float(rest)) * F.col("weight") / F.lit(float(free)))
        capped, weight_left = held.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        settled, last = above, (rest, free)
        rest, free = total - (capped or 0), weight_left or 0
        if (rest, free) == last:
            break
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(free or 1))
    target = F.when(settled, cap.cast("double")).otherwise(share)
    return held.select(source, "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def chance(key: Column, seed: str = "mix") -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix",
) -> DataFrame:
    """All columns of ``docs`` and ``size, source_size, target, rate, copies, taken``, one row per row.

    ``copies`` says how often the mix takes the document, ``taken`` how many words that makes.  Null
    text has size 0, a null source is a source.  Rows that repeat a key are taken equally often.
    Columns of ``docs`` with one of the added names are left out.
    """
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    sized = docs.drop(*added).withColumn("size", word_count(F.col(text)))
    sums = sized.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    summary = source_targets(sums, "_source", weights, most)
    mark, whole = free_name(sized, "_mark"), F.floor("rate")
    copies = whole + (chance(F.col(key), seed) < F.col("rate") - whole).cast("bigint")
    return (
        lookup_join(sized.withColumn(mark, source_mark(F.col(source))),
                    summary.select(source_mark(F.col("_source")).alias(mark), "source_size", "target", "rate"),
                    [mark], F.col(key))
        .drop(mark).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    )


def source_mark(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as the mix takes it, with all columns of ``mix``."""
    mixed = mix(docs, **options)
    copy = free_name(mixed, "_copy")
    return mixed.withColumn(copy, F.explode(
        F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))).drop(copy)
