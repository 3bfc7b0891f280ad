"""Chart-ready aggregates: counts, proportions, box statistics, histograms, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiframe.functions.columns import (
    clean, is_numeric, kinds, label_of, melt, melt_typed, one_row, ref, require, rows_of,
)
from equiframe.functions.scale import (
    bucketed_rows, evaluated, lookup_join, materialise, opened, partitions, quantile_buckets, ranked_values, salted_join,
    take_buckets,
)
from equiframe.functions.scan import Scan
from equiframe.operators.demographics import (
    TOP_GROUPS, chart_age_group, is_chart_age, split_charted,
)
from equiframe.operators.profile import id_like, profile, profile_of, valid_target

GRID = 200
INF = float("inf")
LONG = "attribute string, statistic string, group string, category string, value double"


def _listed(columns: str | Sequence[str] | None) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns or [])


def column_labels(df: DataFrame) -> DataFrame:
    """Display label of every column, ``(column, label)``."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return names.select("column", label_of(F.col("column")).alias("label"))


def group_proportions(df: DataFrame, group_col: str, target: str) -> DataFrame:
    """Share of each target value within its group: ``(group, category, n, proportion)``."""
    require(df, group_col, target)
    cells = (
        clean(df).filter(ref(group_col).isNotNull() & ref(target).isNotNull())
        .groupBy(ref(group_col).cast("string").alias("group"), ref(target).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = cells.groupBy("group").agg(F.sum("n").alias("total"))
    return (
        salted_join(cells, totals, ["group"], F.col("category"))
        .select("group", "category", "n", (F.col("n") / F.col("total")).alias("proportion"))
    )


def box_stats(
    df: DataFrame, columns: str | Sequence[str], by: str | Sequence[str] | None = None, scan: Scan | None = None,
    splits: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Quartiles and whiskers of number columns, per group when ``by`` names group columns.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the box;
    ``outliers`` counts the rows beyond them.  Rows without a group are left out.

    Bucket totals bound the quartiles and so the whiskers' ends: one more read, of the few buckets that may hold
    a quartile or an end, settles both; all other buckets lie within the whiskers or beyond by their own ends.
    Without groups a ``scan`` of the same table gives the totals; with groups, ``splits`` that are known save a pass.
    """
    columns, by = _listed(columns), _listed(by)
    require(df, *columns, *by)
    if scan is not None and not by:
        return _boxes(scan.ordered_rows(columns), scan.totals(columns), ["column"])
    frame = clean(df)
    keys = [f"_g{i}" for i in range(len(by))]
    frame = frame.select(
        *[ref(b).cast("string").alias(k) for b, k in zip(by, keys)],
        *[ref(c).cast("double").alias(c) for c in columns],
    )
    for k in keys:
        frame = frame.filter(F.col(k).isNotNull())
    rows = bucketed_rows(frame, columns, keys, splits=splits)
    keys.append("column")
    totals = materialise(rows.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "totals")
    boxes = _boxes(rows, totals, keys)
    return boxes.select("column", *[F.col(k).alias(b) for k, b in zip(keys, by)], *_BOX)


def _boxes(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes from bucketed rows ``(*keys, bucket, value, n)`` and bucket totals ``(*keys, bucket, n, low, high)``."""
    whole = Window.partitionBy(*keys)
    known = opened(totals, keys, ["n"])

    def holding(rank: Column, end: str) -> Column:
        """``end`` of the bucket that holds a rank."""
        inside = (rank >= F.col("before_n")) & (rank < F.col("before_n") + F.col("n"))
        return F.max(F.when(inside, F.col(end))).over(whole)

    first, third = (F.lit(p) * (F.col("total_n") - 1) for p in (0.25, 0.75))
    bounds = known.select(
        "*", holding(F.floor(first), "low").alias("a1"), holding(F.ceil(first), "high").alias("b1"),
        holding(F.floor(third), "low").alias("a3"), holding(F.ceil(third), "high").alias("b3"))
    # a quartile lies between its bounds, an end between these; the slack is for rounding
    slack = 1e-9 * (F.abs("a1") + F.abs("b1") + F.abs("a3") + F.abs("b3"))

    def near(least: Column, largest: Column) -> Column:
        return (F.col("high") >= F.nanvl(least - slack, F.lit(-INF))) & (F.col("low") <= F.nanvl(largest + slack, F.lit(INF)))

    borders = bounds.filter(
        near(2.5 * F.col("a1") - 1.5 * F.col("b3"), 2.5 * F.col("b1") - 1.5 * F.col("a3"))
        | near(2.5 * F.col("a3") - 1.5 * F.col("b1"), 2.5 * F.col("b3") - 1.5 * F.col("a1"))).select(*keys, "bucket")
    wanted = evaluated(
        quantile_buckets(known, keys, (0.25, 0.5, 0.75)).join(borders, [*keys, "bucket"], "full"), "wanted")
    taken = materialise(take_buckets(rows, wanted, keys), "taken")
    boxes = ranked_values(taken, keys).groupBy(*keys).agg(*[
        F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
        for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    pieces = totals.join(wanted, [*keys, "bucket"], "left_anti").select(*keys, "n", "low", "high").unionByName(
        taken.select(*keys, "n", F.col("value").alias("low"), F.col("value").alias("high")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    start, end = F.col("q1") - reach, F.col("q3") + reach
    within = F.col("low").between(start, end) & F.col("high").between(start, end)
    return (
        lookup_join(pieces, boxes, keys, F.col("low"))
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(within, F.col("low"))).alias("whisker_low"),
            F.max(F.when(within, F.col("high"))).alias("whisker_high"),
            F.sum("n").alias("n"),
            F.sum(F.when(within, 0).otherwise(F.col("n"))).alias("outliers"),
        )
        .select(*keys, *_BOX)
    )


@dataclass
class Range:
    """Row count, ends and deviation of a column's finite numbers, its infinite rows, and its bins."""

    n: int
    low: float
    high: float
    deviation: float
    below: int = 0
    above: int = 0
    bins: int = 0

    @property
    def start(self) -> float:
        # a constant gets one unit of width around it, as plotting libraries give it
        return self.low - 0.5 if self.low == self.high else self.low

    @property
    def width(self) -> float:
        return (self.high - self.low or 1.0) / self.bins


def _ranges(scan: Scan, columns: Sequence[str]) -> dict[str, Range]:
    """Ranges of the columns that have a value, from the facts of a scan."""
    facts = {c: scan.facts[c] for c in columns}
    return {
        c: Range(f.finite, f.low, f.high, f.deviation or 0.0, f.below, f.above)
        for c, f in facts.items() if f.finite or f.below or f.above
    }


def _finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, missing where they are infinite."""
    return df.select(*[F.when(F.abs(ref(c).cast("double")) < INF, ref(c).cast("double")).alias(c) for c in columns])


def _finite_counts(scan: Scan, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of finite numbers, from their counts."""
    return scan.value_rows(columns).filter(F.abs("value") < INF).select("column", "value", "n")


def _set_bins(scan: Scan, ranges: dict[str, Range], bins: int | str) -> None:
    """A fixed bin count, or the one of the smaller of the Sturges and Freedman-Diaconis widths."""
    boxes = {}
    if bins == "auto":
        unbounded = [c for c, r in ranges.items() if r.below or r.above]
        boxes = scan.quartiles([c for c in ranges if c not in unbounded])
        if unbounded:  # quartiles of the finite values
            boxes |= Scan(_finite(scan.df, unbounded), unbounded).quartiles(unbounded)
    for c, r in ranges.items():
        if bins != "auto":
            r.bins = bins
        elif r.low == r.high:
            r.bins = 1
        else:
            sturges = (r.high - r.low) / (math.log2(r.n) + 1)
            spread = 2 * (boxes[c][1] - boxes[c][0]) / r.n ** (1 / 3)
            r.bins = math.ceil((r.high - r.low) / (min(sturges, spread) if spread > 0 else sturges))


def histogram(
    df: DataFrame, columns: str | Sequence[str], bins: int | str = 20, scan: Scan | None = None,
) -> DataFrame:
    """Non-empty bins ``(column, bin, low, high, n)`` of equal width; the last one is closed.

    Ranges of all columns come from one pass, their bin counts from another.  Bins span the finite values; rows
    at an infinity are counted in a row without a bin, from that infinity to itself.  A ``scan`` of the same table
    gives the ranges, and the rows of columns whose values it has counted.
    """
    columns = _listed(columns)
    require(df, *columns)
    scan = scan or Scan(df, columns, ordered=columns if bins == "auto" else ())
    known = _ranges(scan, columns)
    schema = "column string, bin bigint, low double, high double, n bigint"
    beyond = [(c, None, end, end, n) for c, r in known.items() for end, n in ((-INF, r.below), (INF, r.above)) if n]
    ends = df.sparkSession.createDataFrame(beyond, schema)
    ranges = {c: r for c, r in known.items() if r.n}
    if not ranges:
        return ends
    _set_bins(scan, ranges, bins)
    counted = [c for c in ranges if c in scan.compact]
    others = [c for c in ranges if c not in counted]
    long = [_finite_counts(scan, counted)] if counted else []
    if others:
        long.append(_finite(scan.df, others).select(rows_of([
            {"column": F.lit(c), "value": ref(c), "n": F.lit(1).cast("bigint")} for c in others
        ])).filter(F.col("value").isNotNull()))
    facts = F.create_map(*[e for c, r in ranges.items() for e in (F.lit(c), F.struct(
        F.lit(float(r.start)).alias("start"), F.lit(float(r.width)).alias("width"),
        F.lit(r.bins - 1).cast("bigint").alias("last")))])
    edge = F.col("f.start") + F.col("bin") * F.col("f.width")
    found = (
        reduce(DataFrame.unionByName, long).withColumn("f", F.element_at(facts, F.col("column")))
        .withColumn("bin", F.least(F.floor((F.col("value") - F.col("f.start")) / F.col("f.width")), F.col("f.last")))
        .groupBy("column", "bin").agg(F.sum("n").alias("n"))
        .withColumn("f", F.element_at(facts, F.col("column")))
        .select("column", "bin", edge.alias("low"),
                (F.col("f.start") + (F.col("bin") + 1) * F.col("f.width")).alias("high"), "n")
    )
    return found.unionByName(ends) if beyond else found


def density(
    df: DataFrame, columns: str | Sequence[str], points: int = GRID, scan: Scan | None = None,
) -> DataFrame:
    """Gaussian kernel density ``(column, point, x, density)`` from the smallest to the largest value.

    Bandwidth is the sample deviation times ``n ** -0.2``.  Every row adds to every grid
    point of its column.  Each task sums its own rows with NumPy and hands on
    ``points`` partial sums per column, so no row is shuffled.  Infinite values, which lie
    on no grid, are left out; :func:`histogram` counts them.  A ``scan`` serves as in :func:`histogram`.
    """
    columns = _listed(columns)
    require(df, *columns)
    scan = scan or Scan(df, columns, ordered=())
    ranges = {c: r for c, r in _ranges(scan, columns).items() if r.deviation > 0}
    if not ranges:
        return df.sparkSession.createDataFrame([], "column string, point int, x double, density double")
    names = list(ranges)
    grids = [np.linspace(r.low, r.high, points) for r in ranges.values()]
    widths = [r.deviation * r.n ** -0.2 for r in ranges.values()]
    counted = [c for c in names if c in scan.compact]
    others = [c for c in names if c not in counted]

    def add(totals, i, values, counts):
        for at in range(0, len(values), 4096):
            z = (grids[i][:, None] - values[None, at:at + 4096]) / widths[i]
            totals[i] += np.exp(-0.5 * z * z) @ counts[at:at + 4096]

    def summed(totals):
        for i in range(len(grids)):
            yield pd.DataFrame({"i": i, "point": np.arange(points), "total": totals[i]})

    def sums_of_rows(batches):
        totals = np.zeros((len(grids), points))
        for batch in batches:
            for c in others:
                i = names.index(c)
                add(totals, i, *np.unique(batch[f"v{i}"].dropna().to_numpy(), return_counts=True))
        yield from summed(totals)

    def sums_of_counts(batches):
        totals = np.zeros((len(grids), points))
        for batch in batches:
            for i, part in batch.groupby("i"):
                add(totals, i, part["value"].to_numpy(), part["n"].to_numpy())
        yield from summed(totals)

    partial, schema = [], "i int, point int, total double"
    if others:
        partial.append(_finite(scan.df, others).select(*[
            ref(c).alias(f"v{names.index(c)}") for c in others]).mapInPandas(sums_of_rows, schema))
    if counted:
        place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")) - 1
        partial.append(_finite_counts(scan, counted).select(
            place.cast("int").alias("i"), "value", "n").mapInPandas(sums_of_counts, schema))
    sums = reduce(DataFrame.unionByName, partial).groupBy("i", "point").agg(F.sum("total").alias("total"))
    facts = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(r.low)).alias("low"),
                 F.lit((r.high - r.low) / (points - 1)).alias("step"),
                 F.lit(r.n * w * math.sqrt(2 * math.pi)).alias("mass"))
        for (c, r), w in zip(ranges.items(), widths)
    ])
    return sums.withColumn("f", F.get(facts, F.col("i"))).select(
        "f.column", "point", (F.col("f.low") + F.col("point") * F.col("f.step")).alias("x"),
        (F.col("total") / F.col("f.mass")).alias("density"))


def _counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(attribute, category, n)`` of all columns in one pass; missing values as ``None``.

    Columns without any value are left out.
    """
    picked = df.select(*[
        (chart_age_group(c) if is_chart_age(df, c) else ref(c)).alias(c) for c in columns
    ])
    counts = melt(picked, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    some = counts.filter(F.col("value").isNotNull()).select("column").distinct()
    return counts.join(some, "column", "left_semi").select(
        F.col("column").alias("attribute"), F.coalesce("value", F.lit("None")).alias("category"), "n"
    )


def _not_id_like(df: DataFrame, columns: Sequence[str], scan: Scan | None = None) -> list[str]:
    """Columns that do not look like identifiers.  Only text columns can."""
    text = [c for c in columns if kinds(df)[c] == "categorical"]
    if not text:
        return list(columns)
    found = (profile(df, text) if scan is None else profile_of(scan)).filter(id_like()).select("column").collect()
    return [c for c in columns if c not in {r["column"] for r in found}]


def demographic_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts per value of the requested demographic columns."""
    df = clean(df)
    demo, _ = split_charted(_not_id_like(df, columns))
    if not demo:
        return df.sparkSession.createDataFrame([], "attribute string, category string, n bigint")
    return _counts(df, demo)


def _is_demographic(name: str) -> bool:
    return any(word in name for word in ("demographic", "gender", "race", "ethnicity"))


def _stat_rows(df: DataFrame, columns: dict[str, str], attribute: Column, group: Column) -> DataFrame:
    """Long rows from a result table: ``columns`` maps statistic names to columns."""
    return df.select(attribute.alias("attribute"), group.alias("group"), rows_of([
        {"statistic": F.lit(s), "category": F.lit(None).cast("string"), "value": F.col(c).cast("double")}
        for s, c in columns.items()
    ])).select("attribute", "statistic", "group", "category", "value")


_BOX = {s: s for s in ("n", "whisker_low", "q1", "median", "q3", "whisker_high", "outliers")}
_BARS = {"low": "low", "high": "high", "bin_count": "n"}
_CURVE = {"x": "x", "density": "density"}


def _bars(df: DataFrame, columns: Sequence[str], bins: int | str, scan: Scan | None = None) -> DataFrame:
    return _stat_rows(histogram(df, columns, bins, scan), _BARS, F.col("column"), F.col("bin").cast("string"))


def _curves(df: DataFrame, columns: Sequence[str], scan: Scan | None = None) -> DataFrame:
    return _stat_rows(density(df, columns, scan=scan), _CURVE, F.col("column"), F.col("point").cast("string"))


def _value_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = (
        melt(df, columns).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return _stat_rows(counts, {"count": "n"}, F.col("column"), F.col("value"))


def _union(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LONG)


def _wanted(df: DataFrame, columns: Sequence[str]) -> Scan:
    numbers = [c for c in columns if is_numeric(df, c)]
    return Scan(df, numbers, [c for c in columns if c not in numbers])


def distributions(df: DataFrame, columns: Sequence[str], scan: Scan | None = None) -> DataFrame:
    """Histogram with automatic bins and density of each number, value counts of the rest.

    Ranges, bucket totals, quartiles and value counts come from one scan; pass that of the same table to share it.
    """
    require(df, *columns)
    scan = scan or _wanted(df, columns)
    numbers = [c for c in columns if is_numeric(df, c)]
    others = [c for c in columns if c not in numbers]
    parts = [_bars(df, numbers, "auto", scan), _curves(df, numbers, scan)] if numbers else []
    if others:
        parts.append(_stat_rows(scan.counts(others), {"count": "n"}, F.col("column"), F.col("value")))
    return _union(df.sparkSession, parts)


def overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`distributions` and the box of each number, from one scan."""
    columns = [c for c in columns if c in df.columns]
    numbers = [c for c in columns if is_numeric(df, c)]
    scan = _wanted(df, columns)
    if not numbers:
        return distributions(df, columns, scan)
    boxes = evaluated(box_stats(df, numbers, scan=scan), "boxes")
    scan.note_quartiles(boxes)
    return distributions(df, columns, scan).unionByName(_stat_rows(boxes, _BOX, F.col("column"), F.lit("all")))


def _top_values(df: DataFrame, columns: Sequence[str], n: int, scan: Scan | None = None) -> dict[str, list]:
    """The ``n`` most frequent values of each column, ties by value, from one count of all columns, or that of a scan.

    A column's counts are ranked in parts first, so that a column of many values is spread over tasks.
    """
    if not columns:
        return {}
    if scan is None:
        counts = melt_typed(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = scan.cells.filter(F.col("column").isin(list(columns)) & F.col("value").isNotNull()).select("column", "value", "n")

    def best(frame: DataFrame, *keys: Column) -> DataFrame:
        order = Window.partitionBy("column", *keys).orderBy(F.desc("n"), "value")
        return frame.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")

    part = F.pmod(F.xxhash64("value"), F.lit(partitions(df.sparkSession)))
    out: dict[str, list] = {c: [] for c in columns}
    for r in best(best(counts, part)).collect():
        out[r["column"]].append(next(v for v in r["value"] if v is not None))
    return out


def groupwise(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Chart data of every demographic column, against a target when one is given.

    Long ``(attribute, statistic, group, category, value)``: box statistics of a
    numeric target, proportions of a categorical one; without a target counts, or a
    20-bin histogram of a number with ten or more values.  A column with over 20
    values is cut to its 20 largest groups.  All columns are charted in the same pass.
    """
    df = clean(df)
    demo = [c for c in columns if c in df.columns and _is_demographic(c)]
    asked = [target] if target is not None and target in df.columns else []
    number = [c for c in asked if is_numeric(df, c)]
    scan = Scan(df, number, demo + [c for c in asked if c not in number])
    demo = _not_id_like(df, demo, scan) if demo else []
    if not demo:
        return df.sparkSession.createDataFrame([], LONG)
    facts = profile_of(scan).withColumn("ok", valid_target()).collect()
    sizes = scan.sizes
    target = next((r["column"] for r in facts if r["column"] in asked and r["ok"]), None)
    groups = {}
    top = _top_values(df, [c for c in demo if not is_chart_age(df, c) and sizes[c] > TOP_GROUPS], TOP_GROUPS, scan)
    for c in demo:
        if is_chart_age(df, c):
            groups[c] = chart_age_group(c)
        elif sizes[c] > TOP_GROUPS:
            groups[c] = F.when(ref(c).isin(top[c]), ref(c))
        else:
            groups[c] = ref(c)
    if target is None:
        shown = df.select(*[groups[c].alias(c) for c in demo])
        binned = [c for c in demo if is_numeric(shown, c) and sizes[c] >= 10]
        whole = [c for c in demo if c not in binned and not is_chart_age(df, c) and sizes[c] <= TOP_GROUPS]
        counted = [c for c in demo if c not in binned and c not in whole]
        parts = [_bars(shown, binned, 20)] if binned else []
        if whole:  # their counts are known
            parts.append(_stat_rows(scan.counts(whole), {"count": "n"}, F.col("column"), F.col("value")))
        return _union(df.sparkSession, parts + ([_value_rows(shown, counted)] if counted else []))
    picked = df.select(ref(target).alias("_target"), *[groups[c].alias(c) for c in demo])
    long = melt(picked, demo, ["_target"])
    if is_numeric(df, target):
        boxes = box_stats(long.withColumnsRenamed({"column": "attribute", "value": "group"}),
                          "_target", ["attribute", "group"], splits={"_target": scan.facts[target].splits})
        return _stat_rows(boxes, _BOX, F.col("attribute"), F.col("group"))
    cells = (
        long.filter(F.col("value").isNotNull() & F.col("_target").isNotNull())
        .groupBy(F.col("column").alias("attribute"), F.col("value").alias("group"),
                 F.col("_target").cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = cells.groupBy("attribute", "group").agg(F.sum("n").alias("total"))
    return salted_join(cells, totals, ["attribute", "group"], F.col("category")).select(
        "attribute", F.lit("proportion").alias("statistic"), "group", "category",
        (F.col("n") / F.col("total")).alias("value"))


def group_profile(df: DataFrame, group_col: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per group after scaling it to [0, 1]: ``(group, metric, value)``."""
    metrics = [m for m in metrics if m in df.columns]
    if len(metrics) < 2:
        raise ValueError("at least two metrics are needed")
    frame = clean(df)
    per_group = frame.groupBy(ref(group_col).cast("string").alias("group")).agg(*[
        a for i, m in enumerate(metrics) for a in (
            F.avg(ref(m).cast("double")).alias(f"mean{i}"),
            F.min(ref(m).cast("double")).alias(f"low{i}"),
            F.max(ref(m).cast("double")).alias(f"high{i}"),
        )
    ])
    # the overall range is the range of the groups' ranges: no second pass
    ends = one_row(per_group.agg(*[
        a for i in range(len(metrics)) for a in (F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}"))
    ]))
    rows = []
    for i, m in enumerate(metrics):
        low, high, mean = ends.getField(f"low{i}"), ends.getField(f"high{i}"), F.col(f"mean{i}")
        scaled = F.when(high == low, F.when(mean.isNotNull(), 0.0)).otherwise(
            (mean - low) / F.nullif(high - low, F.lit(0.0)))
        rows.append({"metric": F.lit(m), "value": scaled})
    return per_group.filter(F.col("group").isNotNull()).select("group", rows_of(rows))
