"""Representation audit: each group's share against a benchmark distribution."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.functions.columns import as_text, clean, ladder, one_row, ref, require, rows_of, safe_div
from equiframe.functions.scale import (
    bucket_openings, bucketed_rows, evaluated, lookup_join, materialise, running_totals, settle, value_totals,
)
from equiframe.sources.benchmark import benchmark_from_dict, default_benchmark

METRICS = ("kl_divergence", "wasserstein_distance", "total_variation")
SORTABLE = ("observed_count", "observed_share", "expected_share", "disparity_ratio", "abs_difference")


def validate(df: DataFrame, group_col: str, benchmark) -> DataFrame:
    """Check the inputs and return the benchmark as a frame.

    Warns when the expected shares do not add up to about 1.
    """
    require(df, group_col)
    if df.isEmpty():
        raise ValueError("the table is empty")
    if benchmark is None:
        frame = default_benchmark(df.sparkSession)
    elif isinstance(benchmark, DataFrame):
        require(benchmark, "group", "expected")
        frame = benchmark
    else:
        frame = benchmark_from_dict(df.sparkSession, benchmark)
    total = frame.agg(F.sum("expected")).first()[0]
    if total is not None and not 0.95 <= total <= 1.05:
        warnings.warn(f"benchmark shares add up to {total:.3f}, not 1", stacklevel=3)
    return frame


def input_fairness(
    df: DataFrame, group_col: str, benchmark=None,
    low: float = X.FAIR_RATIO[0], high: float = X.FAIR_RATIO[1], sort_by: str = "observed_share",
) -> DataFrame:
    """Observed and expected share of every group, NULL included, with a verdict.

    ``benchmark`` is a frame ``(group, expected)``, a mapping, or ``None`` for the
    default one.  One aggregation reads the table, at once; later steps see one row per group.
    """
    if sort_by not in SORTABLE:
        raise ValueError(f"sort_by is one of {', '.join(SORTABLE)}")
    expected = validate(df, group_col, benchmark)
    types = {f.name: f.dataType for f in df.schema.fields}
    observed = evaluated(
        clean(df.select(ref(group_col)))
        .groupBy(as_text(group_col, types[group_col]).alias("group"))
        .agg(F.count(F.lit(1)).alias("observed_count")), "groups")
    total = observed.agg(F.sum("observed_count").alias("t")).scalar()
    share = F.col("observed_count") / total
    ratio = F.col("disparity_ratio")
    known = expected.select(F.col("group").alias("_group"), F.col("expected").alias("_expected"))
    # no hint: the benchmark is broadcast only when its size is under the session's threshold
    return (
        observed.join(known, F.col("group").eqNullSafe(F.col("_group")), "left")
        .select(
            "group", "observed_count", share.alias("observed_share"),
            F.coalesce("_expected", F.lit(X.MISSING_EXPECTED)).alias("expected_share"),
        )
        .withColumn("disparity_ratio", F.when(F.col("expected_share") == 0, float("inf")).otherwise(
            F.col("observed_share") / F.nullif(F.col("expected_share"), F.lit(0.0))))
        .withColumn("abs_difference", F.abs(F.col("observed_share") - F.col("expected_share")))
        .withColumn("fair", F.when(ratio.between(low, high), "Fair").otherwise("Not Fair"))
        .withColumn("deviation_type", F.when(ratio < low, "Under-represented")
                    .when(ratio > high, "Over-represented").otherwise("Within bounds"))
        .orderBy(F.desc(sort_by), "group")
    )


def _wasserstein(result: DataFrame) -> DataFrame:
    """Mean gap between the sorted observed and the sorted expected shares.

    The shares themselves are the samples.  Up to ``LOOKUP_ROWS`` groups both lists are sorted as arrays in one
    aggregate; beyond that the gap is integrated bucket by bucket.
    """
    lookup = settle(result.select("observed_share", "expected_share"))
    if not lookup.small:
        return _integrated_gap(lookup.frame)
    p, q = (F.array_sort(F.collect_list(c)) for c in ("observed_share", "expected_share"))
    total = F.aggregate(F.zip_with(
        "p", "q", lambda x, y: F.abs(x / F.col("sp") - y / F.col("sq"))), F.lit(0.0), lambda s, v: s + v)
    return lookup.frame.agg(
        p.alias("p"), q.alias("q"), F.sum("observed_share").alias("sp"), F.sum("expected_share").alias("sq"),
        F.count(F.lit(1)).alias("n"),
    ).select((total / F.nullif("n", F.lit(0))).alias("wasserstein_distance"))


def _integrated_gap(shares: DataFrame) -> DataFrame:
    """The same as the area between the two running counts over the shares, cut into buckets that are sorted apart.

    A bucket's last step ends at the first value of the next bucket that has one.
    """
    sums = shares.agg(F.sum("observed_share").alias("p"), F.sum("expected_share").alias("q")).first()
    steps = shares.select(rows_of([
        {"x": F.col("observed_share") / F.lit(sums["p"]), "np": F.lit(1), "nq": F.lit(0)},
        {"x": F.col("expected_share") / F.lit(sums["q"]), "np": F.lit(0), "nq": F.lit(1)},
    ])).withColumn("all", F.lit(0))
    counts = ["np", "nq"]
    rows = materialise(bucketed_rows(steps, ["x"], ["all"], {c: F.col(c) for c in counts}).drop("column"), "steps")
    openings = bucket_openings(rows, ["all"], counts)
    following = rows.groupBy("all", "bucket").agg(F.min("value").alias("first")).select(
        "all", "bucket", F.lead("first").over(Window.partitionBy("all").orderBy("bucket")).alias("next"))
    running = running_totals(value_totals(rows, ["all"], counts), openings, ["all"], counts)
    inside = Window.partitionBy("all", "bucket").orderBy("value")
    width = F.coalesce(F.lead("value").over(inside), "next") - F.col("value")
    return lookup_join(running, following, ["all", "bucket"], F.col("value")).select(
        F.abs(F.col("cum_np") - F.col("cum_nq")).alias("gap"), width.alias("width"), "np").agg(
        (F.sum(F.col("gap") * F.col("width")) / F.sum("np")).alias("wasserstein_distance"))


def distribution_distance(result: DataFrame) -> DataFrame:
    """One row ``(kl_divergence, wasserstein_distance, total_variation)`` of an
    :func:`input_fairness` table."""
    p = F.greatest("observed_share", F.lit(X.KL_FLOOR))
    q = F.greatest("expected_share", F.lit(X.KL_FLOOR))
    sums = result.agg(
        F.sum(p).alias("p"), F.sum(q).alias("q"), F.sum(p * F.log(p / q)).alias("plogpq"),
        (F.sum(F.abs(F.col("observed_share") - F.col("expected_share"))) / 2).alias("total_variation"),
    )
    return sums.select(
        (F.col("plogpq") / F.col("p") + F.log(F.col("q") / F.col("p"))).alias("kl_divergence"),
        _wasserstein(result).scalar().alias("wasserstein_distance"),
        "total_variation",
    )


def severity_of(metric: str, value: Column) -> Column:
    return ladder(value, X.SEVERITY[metric])


def severity_labels(distances: DataFrame) -> DataFrame:
    """Long ``(metric, value, severity)`` of a distance row."""
    return distances.select(rows_of([
        {"metric": F.lit(m), "value": F.col(m), "severity": severity_of(m, F.col(m))} for m in METRICS
    ]))


def fairness_summary(result: DataFrame) -> DataFrame:
    """Group totals, fair rate, distances and their labels in one row."""
    totals = result.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(F.col("fair") == "Fair").alias("fair_groups"),
    )
    return (
        totals.withColumn("_d", one_row(distribution_distance(result)))
        .select("*", "_d.*")
        .select(
            "total_groups", "fair_groups",
            (F.col("total_groups") - F.col("fair_groups")).alias("unfair_groups"),
            safe_div(F.col("fair_groups"), F.col("total_groups")).alias("fairness_rate"),
            *METRICS,
            *[severity_of(m, F.col(m)).alias(f"{m}_severity") for m in METRICS],
        )
    )


def top_disparity(result: DataFrame, n: int = 20) -> DataFrame:
    """Groups with the highest disparity ratio; ``extreme`` marks over 2 or under 0.5."""
    ratio = F.col("disparity_ratio")
    return (
        result.select("group", "disparity_ratio", "fair", ((ratio > 2.0) | (ratio < 0.5)).alias("extreme"))
        .orderBy(F.desc("disparity_ratio"), "group").limit(n)
    )


def observed_vs_expected(result: DataFrame, n: int = 20) -> DataFrame:
    """Long ``(group, kind, share)`` of the ``n`` largest groups."""
    return (
        result.orderBy(F.desc("observed_share"), "group").limit(n)
        .select("group", rows_of([
            {"kind": F.lit("observed"), "share": F.col("observed_share")},
            {"kind": F.lit("expected"), "share": F.col("expected_share")},
        ]))
    )
