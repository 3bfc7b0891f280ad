"""The most frequent values of a column, exact, without shuffling all its distinct values.

One aggregate keeps a frequent-items sketch of value hashes.  It names the few hashes that can be among
the ``n`` most frequent ones and bounds the count of every other; a second pass counts only those, exactly.
Where the ``n``-th count does not clear the bound, nothing stands out in the column and all its values are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from equiframe.functions.scale import partitions

TRACKED = 10_000      # hashes that a sketch keeps, 16 bytes each
MOST_CANDIDATES = 1_000


@dataclass
class Heavy:
    """Hashes of the values that can be among the most frequent; every other value is rarer than ``cut`` or at most at ``least``."""

    keys: list[int]
    cut: float
    least: int

    def proves(self, nth: int | None, counted: int, present: int) -> bool:
        """Whether exact counts of the candidates settle the matter.

        ``nth`` is the ``n``-th largest count (None if there are fewer), ``counted`` the rows of all
        candidates, ``present`` the rows that hold a value.
        """
        return counted == present or (nth is not None and nth >= self.cut and nth > self.least)


def sketch(value: Column) -> Column:
    """Aggregate: ``(item, count)`` of the hashes that the sketch is sure of; counts are never too small."""
    size = F.lit(TRACKED)
    return F.call_function("approx_top_k", F.when(value.isNotNull(), F.xxhash64(value)), size, size)


def heavy_hashes(found: Sequence[Row], n: int, present: int) -> Heavy | None:
    """Candidates for the ``n`` most frequent values, or None if the sketch cannot tell.

    A hash is listed if its lower bound exceeds the sketch's error, so the error is under half of any listed count,
    and an unlisted hash occurs at most as often as the least listed count says.
    """
    listed = sorted(((r["count"], r["item"]) for r in found if r["item"] is not None), reverse=True)
    if not listed or (len(listed) < n and sum(c for c, _ in listed) < present):
        return None
    least = min(r["count"] for r in found)
    cut = listed[n - 1][0] - least / 2 if len(listed) >= n else 0.0
    keys = [item for count, item in listed if count >= cut]
    return Heavy(keys, cut, least) if len(keys) <= MOST_CANDIDATES else None


def most_counted(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest of ``(column, value, n)`` per column, ties by value.

    A column's counts are ranked in parts first, so that a column of many values is spread over tasks.
    """
    def best(frame: DataFrame, *keys: Column) -> DataFrame:
        order = Window.partitionBy("column", *keys).orderBy(F.desc("n"), "value")
        return frame.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)

    part = F.pmod(F.xxhash64("value"), F.lit(partitions(counts.sparkSession)))
    return best(best(counts, part).drop("_rank"))
