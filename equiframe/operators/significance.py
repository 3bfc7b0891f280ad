"""Tests of group differences: chi-square, ANOVA, Kolmogorov-Smirnov, Cohen's d.

Every test reads the table once or twice, reduces it to per-group or per-value
totals, and works on those.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.functions.columns import clean, is_numeric, ladder, melt_typed, ref, require, rows_of
from equiframe.functions.pvalues import chi2_p, f_p, ks_exact_p, ks_p, ks_series_p
from equiframe.functions.scale import (
    bucket_count, bucketed_rows, lookup_join, materialise, partitions, salted_join, settle, unordered_pairs, value_totals,
)

INF = float("inf")

# ship this module's task function with its jobs, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _listed(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def chi_square(df: DataFrame, columns: str | Sequence[str], group_col: str) -> DataFrame:
    """Independence of each column and the group: ``(feature, test, stat, dof, p_value, n)``.

    All columns are counted in one pass, whose cells are written once.  The statistic includes empty cells without
    building them: the sum of ``(O - E)^2 / E`` over all cells is
    ``n (sum O^2 / (R C) - 1)``.  With one degree of freedom the continuity
    correction is applied; in a 2 x 2 table ``|O - E|`` is the same in all cells and
    ``1 / E`` sums to ``n sum(1/R) sum(1/C)``.
    """
    columns = _listed(columns)
    require(df, *columns, group_col)
    grouped = clean(df).withColumn("_group", ref(group_col).cast("string"))
    cells = materialise(  # read twice below
        melt_typed(grouped, columns, ["_group"])
        .filter(F.col("_group").isNotNull())
        .groupBy(F.col("column").alias("feature"), F.col("value").alias("row"), F.col("_group").alias("col"))
        .agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("feature", "col").agg(F.sum("n").alias("c"))
    by_row = (
        salted_join(cells, totals, ["feature", "col"], F.col("row"))
        .groupBy("feature", "row")
        .agg(F.sum("n").alias("r"), F.sum(F.col("n").cast("double") * F.col("n") / F.col("c")).alias("s"),
             F.min_by(F.struct("n", "c"), F.col("col")).alias("cell"))
        .groupBy("feature")
        .agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_rows"),
             F.sum(F.col("s") / F.col("r")).alias("s"), F.sum(1 / F.col("r")).alias("inv_r"),
             F.min_by(F.struct("cell.n", "cell.c", "r"), F.col("row")).alias("cell"))
    )
    by_col = totals.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    n = F.col("n").cast("double")
    away = F.abs(F.col("cell.n") - F.col("cell.r").cast("double") * F.col("cell.c") / n)
    corrected = F.pow(away - F.least(F.lit(0.5), away), 2) * n * F.col("inv_r") * F.col("inv_c")
    return (
        by_row.join(by_col, "feature")
        .withColumn("dof", (F.col("n_rows") - 1) * (F.col("n_cols") - 1))
        .withColumn("stat", F.when(F.col("dof") == 0, 0.0).when(F.col("dof") == 1, corrected)
                    .otherwise(F.greatest(F.lit(0.0), n * (F.col("s") - 1))))
        .select("feature", F.lit("chi-square").alias("test"), "stat", "dof",
                chi2_p("stat", "dof").alias("p_value"), "n")
    )


def group_moments(df: DataFrame, columns: str | Sequence[str], group_col: str) -> DataFrame:
    """``(feature, group, n, mean, variance)`` of number columns in one pass.

    Text columns have NULL moments and a row count, so a chi-square result of text
    still lists its groups.
    """
    columns = _listed(columns)
    require(df, *columns, group_col)
    types = dict(df.dtypes)
    none = F.lit(None).cast("double")
    aggs = []
    for i, c in enumerate(columns):
        if is_numeric(df, c) or types[c] == "boolean":
            v = ref(c).cast("double")
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
        else:
            aggs.append(F.count(ref(c)).alias(f"n{i}"))
    wide = (
        clean(df).filter(ref(group_col).isNotNull())
        .groupBy(ref(group_col).cast("string").alias("group")).agg(*aggs)
    )
    have = set(wide.columns)
    return wide.select("group", rows_of([
        {"feature": F.lit(c), "n": F.col(f"n{i}"),
         "mean": F.col(f"m{i}") if f"m{i}" in have else none,
         "variance": F.col(f"v{i}") if f"v{i}" in have else none}
        for i, c in enumerate(columns)
    ])).select("feature", "group", "n", "mean", "variance")


def anova(
    df: DataFrame, columns: str | Sequence[str], group_col: str, moments: DataFrame | None = None,
) -> DataFrame:
    """One-way ANOVA of each column: ``(feature, test, stat, df1, df2, p_value)``.

    One pass over the table for all columns.  A group without any value makes a
    result undefined, as it does for the usual implementation.  ``moments`` of :func:`group_moments`
    that cover the columns save that pass.
    """
    if moments is None:
        g = group_moments(df, columns, group_col)
    else:
        g = moments.filter(F.col("feature").isin(_listed(columns)))
    n = F.col("n").cast("double")
    sums = g.groupBy("feature").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least"),
        (F.sum(n * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("centre"),
        F.sum(F.coalesce((n - 1) * F.col("variance"), F.lit(0.0))).alias("within"),
        F.min("mean").alias("lowest"), F.max("mean").alias("highest"),
    )
    # means are centred before squaring, for precision
    between = (
        g.join(sums.select("feature", "centre"), "feature")
        .groupBy("feature").agg(F.sum(n * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"))
    )
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    defined = (F.col("least") > 0) & (df1 > 0) & (df2 > 0)
    ratio = F.col("between") / df1 / F.nullif(F.col("within") / df2, F.lit(0.0))
    stat = (
        F.when(~defined, None).when(F.col("within") > 0, ratio)
        .when(F.col("highest") > F.col("lowest"), INF)
    )
    return (
        sums.join(between, "feature")
        .select("feature", F.lit("anova").alias("test"), stat.alias("stat"), df1.alias("df1"), df2.alias("df2"))
        .withColumn("p_value", f_p("stat", "df1", "df2"))
    )


P_VALUES = {"auto": ks_p, "exact": ks_exact_p, "series": ks_series_p}
TILE_GROUPS = 256  # groups whose running counts a task holds side by side


def ks_pairs(df: DataFrame, column: str, group_col: str, method: str = "auto") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of every pair of groups.

    Each group's distinct values are counted first, in one pass.  Values are cut into buckets and sorted there;
    a task walks through a bucket with one running count per group, side by side, and keeps the largest gap
    between the running shares of any two.  Integers are compared as integers.  ``method`` is that of the p-value: ``"auto"`` (exact
    for equal sizes and up to 10,000 rows in the smaller group, a corrected series beyond), ``"exact"`` or ``"series"``.
    Over ``TILE_GROUPS`` groups meet tile by tile, so no task holds all of them.
    """
    if method not in P_VALUES:
        raise ValueError(f"method is one of {', '.join(P_VALUES)}")
    require(df, column, group_col)
    frame = clean(df).filter(ref(group_col).isNotNull()).select(
        ref(group_col).cast("string").alias("group"), ref(column).alias("value")
    )
    buckets = bucket_count(df.sparkSession)
    totals = materialise(value_totals(bucketed_rows(frame, ["value"], ["group"], exact=True), ["group"], ["n"]), "totals")
    sizes = settle(totals.groupBy("group").agg(F.sum("n").alias("size")))
    # Every group opens every bucket with what it has before it, so no bucket lacks a group.
    whole = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = sizes.frame.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    openings = (
        grid.join(totals.groupBy("group", "bucket").agg(F.sum("n").alias("n")), ["group", "bucket"], "left")
        .select("group", "bucket", F.lit(None).cast(totals.schema["value"].dataType).alias("value"),
                F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("n"), "size")
    )
    counted = lookup_join(totals, sizes, ["group"], F.col("value")).select("group", "bucket", "value", "n", "size")
    tiles = max(1, math.ceil(sizes.frame.count() / TILE_GROUPS))
    own, other = F.pmod(F.xxhash64("group"), F.lit(tiles)).cast("int"), F.sequence(F.lit(0), F.lit(tiles - 1))
    steps = counted.unionByName(openings).withColumn("tile", F.explode(F.transform(
        other, lambda t: F.concat_ws("-", F.least(own, t), F.greatest(own, t)))))
    walked = (
        steps.repartition(partitions(df.sparkSession), "tile", "bucket")
        .sortWithinPartitions("tile", "bucket", F.col("value").asc_nulls_first())
        .mapInArrow(_largest_gaps, "group1 string, group2 string, n1 bigint, n2 bigint, stat double")
    )
    return (
        walked.groupBy("group1", "group2", "n1", "n2").agg(F.max("stat").alias("stat"))
        .select(F.lit(column).alias("feature"), F.lit("ks").alias("test"), "group1", "group2", "n1", "n2", "stat")
        .withColumn("p_value", P_VALUES[method]("stat", "n1", "n2"))
    )


def _largest_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket the largest gap between the running shares of each two of its groups.

    Rows come sorted by tile, bucket and value; those without a value say what each group has before the bucket.  A value's rows
    may run on into the next batch, so the last value seen waits until another one follows.
    """
    names: list[str] = []
    place: dict[str, int] = {}
    where = last = None
    sizes = running = best = np.empty(0)

    def widen(shares: np.ndarray) -> None:
        for i in range(len(names) - 1):
            np.maximum(best[i, i + 1:], np.abs(shares[:, i + 1:] - shares[:, i:i + 1]).max(axis=0, initial=0.0), out=best[i, i + 1:])

    def finished() -> pa.RecordBatch:
        widen(running[None, :] / sizes)
        rows = [(*sorted([(names[i], int(sizes[i])), (names[j], int(sizes[j]))]), float(best[i, j]))
                for i in range(len(names)) for j in range(i + 1, len(names))]
        return pa.RecordBatch.from_pylist(
            [{"group1": a, "group2": b, "n1": x, "n2": y, "stat": gap} for (a, x), (b, y), gap in rows],
            schema=pa.schema([("group1", pa.string()), ("group2", pa.string()), ("n1", pa.int64()), ("n2", pa.int64()), ("stat", pa.float64())]))

    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        keys = list(zip(column["tile"].to_pylist(), column["bucket"].to_pylist()))
        starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            groups, counts = column["group"].slice(start, end - start).to_pylist(), column["n"].slice(start, end - start).to_numpy()
            values = column["value"].slice(start, end - start)
            if keys[start] != where:
                if where is not None:
                    yield finished()
                where, last, names, place, running = keys[start], None, [], {}, np.empty(0)
            opening = values.null_count
            if opening:
                names += groups[:opening]
                place = {g: i for i, g in enumerate(names)}
                running = np.concatenate([running, counts[:opening].astype(np.float64)])
                known = column["size"].slice(start, opening).to_numpy().astype(np.float64)
                sizes = known if len(names) == opening else np.concatenate([sizes, known])
                best = np.zeros((len(names), len(names)))
                if opening == len(values):
                    continue
                groups, counts, values = groups[opening:], counts[opening:], values.slice(opening)
            fresh = np.concatenate([
                [last is None or values[0] != last],
                pa.compute.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)])
            last = values[len(values) - 1]
            if fresh[0]:
                widen(running[None, :] / sizes)
            number = np.cumsum(fresh) - fresh[0]
            table = np.zeros((int(number[-1]) + 1, len(names)))
            np.add.at(table, (number, [place[g] for g in groups]), counts)
            table = np.cumsum(table, axis=0) + running
            widen(table[:-1] / sizes)
            running = table[-1]
    if where is not None:
        yield finished()


def standardized_difference(df: DataFrame, column: str, group_col: str) -> DataFrame:
    """Cohen's d of every pair of groups with a pooled deviation, largest first."""
    g = group_moments(df, column, group_col).filter("n > 0")
    pooled = F.sqrt(
        (F.coalesce((F.col("n1") - 1) * F.col("variance1"), F.lit(0.0))
         + F.coalesce((F.col("n2") - 1) * F.col("variance2"), F.lit(0.0)))
        / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0))
    )
    # a group of one row has no deviation, so neither has a pair with it
    known = F.col("variance1").isNotNull() & F.col("variance2").isNotNull()
    return (
        unordered_pairs(g, "group", ["n", "mean", "variance"])
        .withColumn("pooled_sd", F.when(known, pooled))
        .withColumn("d", F.when(F.col("pooled_sd") > 0,
                                (F.col("mean1") - F.col("mean2")) / F.nullif(F.col("pooled_sd"), F.lit(0.0))))
        .withColumn("effect_size", F.coalesce(ladder(F.abs("d"), X.EFFECT_SIZE), F.lit("Unknown")))
        .select("group1", "group2", "d", "effect_size", "mean1", "mean2", "n1", "n2", "pooled_sd")
        .orderBy(F.abs("d").desc_nulls_last(), "group1", "group2")
    )
