import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiframe.functions.scan import Scan
from equiframe.operators import charts
from equiframe.operators.prepare import _fills, recommend
from equiframe.operators.profile import profile, profile_of, table_summary
from equiframe.plans.audit import audit_report

ROWS = 4000


def watched(spark, seen):
    """A table whose every read is counted in ``seen``."""
    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(ROWS, numPartitions=4).select(
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("race"), (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 40).cast("int").alias("level"), F.when(F.col("id") % 9 > 0, F.sqrt(F.col("id").cast("double"))).alias("x"),
        F.lit(2.5).cast("decimal(5,1)").alias("fee"), (F.col("id") % 5 / 4).cast("float").alias("part"))
    return df.mapInArrow(count, df.schema)


def passes(spark, job):
    seen = spark.sparkContext.accumulator(0)
    job(watched(spark, seen))
    return seen.value / ROWS


@pytest.mark.parametrize("job, most", [
    (lambda df: table_summary(df).collect(), 3),
    (lambda df: charts.groupwise(df, ["race"], "x").collect(), 4),
    (lambda df: charts.groupwise(df, ["race"]).collect(), 2),
    (lambda df: _fills(df, df.columns), 3),
    (lambda df: Scan(df, tops={"race": 1, "level": 1}).top_values(), 2),
    (lambda df: charts.box_stats(df, "x", "race").collect(), 3),
    (lambda df: charts.overview(df, ["race", "x", "part"]).collect(), 5),
    (lambda df: charts.histogram(df, ["x", "level"], "auto").collect(), 4),
    (lambda df: [f.collect() for f in audit_report(df, ["flag", "level", "part"], "race").values()], 4),
])
def test_passes(spark, job, most):
    assert passes(spark, job) <= most


def test_profile_of_a_scan(spark):
    df = watched(spark, spark.sparkContext.accumulator(0))
    numbers = ["level", "x", "fee", "part"]
    plain, shared = profile(df), profile_of(Scan(df, numbers, df.columns))
    assert shared.orderBy("position").drop("skewness").collect() == plain.orderBy("position").drop("skewness").collect()
    for a, b in zip(shared.orderBy("position").collect(), plain.orderBy("position").collect()):
        assert (a["skewness"] is None) == (b["skewness"] is None)
        if a["skewness"] is not None and not math.isnan(a["skewness"]):
            assert a["skewness"] == pytest.approx(b["skewness"])
    plan = recommend(df, shared).orderBy("position").select("column", "recommendation").collect()
    assert plan == recommend(df).orderBy("position").select("column", "recommendation").collect()


def test_counted_and_bucketed_columns_agree(spark):
    """Quantiles, boxes, histograms and densities are the same from counts of values and from the table."""
    df = watched(spark, spark.sparkContext.accumulator(0))
    columns = ["level", "part", "fee"]
    counted, bucketed = Scan(df, columns, columns), Scan(df, columns)
    assert counted.compact == columns and bucketed.compact == []
    at = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0)
    values = {c: np.array([float(r[0]) for r in df.select(c).collect()]) for c in columns}
    for scan in (counted, bucketed):
        for r in scan.quantiles(columns, at).collect():
            assert r["value"] == pytest.approx(np.quantile(values[r["column"]], r["q"]))
    for call in (lambda s: charts.box_stats(df, columns, scan=s), lambda s: charts.histogram(df, columns, "auto", scan=s)):
        assert sorted(map(tuple, call(counted).collect())) == sorted(map(tuple, call(bucketed).collect()))
    first, second = (charts.density(df, columns, 30, s).orderBy("column", "point").collect() for s in (counted, bucketed))
    assert [r["density"] for r in first] == pytest.approx([r["density"] for r in second])


def test_texts_of_counted_values(spark):
    df = watched(spark, spark.sparkContext.accumulator(0))
    scan = Scan(df, [], df.columns)
    found = {(r["column"], r["value"]): r["n"] for r in scan.counts(df.columns).collect()}
    for c in df.columns:
        expected = {(c, r["v"]): r["n"] for r in df.filter(F.col(c).isNotNull()).groupBy(
            F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).collect()}
        assert {k: n for k, n in found.items() if k[0] == c} == expected


def test_empty_table_and_missing_columns(spark):
    df = spark.createDataFrame([], "t string, x double, k int")
    scan = Scan(df, ["x", "k"], ["t", "x"])
    assert scan.rows == 0 and scan.sizes == {"t": 0, "x": 0} and scan.quantiles(["x", "k"], [0.5]).count() == 0
    assert charts.box_stats(df, ["x"], scan=scan).count() == 0 and charts.overview(df, ["t", "x"]).count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", None)], "t string, x double")
    got = {(r["column"], r["statistic"]): r["number"] for r in table_summary(nulls).collect()}
    assert got[("x", "count")] == 0 and got[("x", "mean")] is None and got[("t", "freq")] == 2
    with pytest.raises(ValueError):
        Scan(df, ["none"])


@pytest.mark.parametrize("seed", range(6))
def test_boxes_against_numpy(spark, seed):
    """Heavy tails, ties, constants and infinite values, in many buckets and few."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_cauchy(400), np.repeat(rng.normal(size=3), 150), rng.normal(50, 1, 40)])
    if seed % 2:
        x = np.concatenate([x, [np.inf, -np.inf, np.inf]])
    g = rng.integers(0, 3, len(x))
    rows = [(f"g{k}", float(v)) for k, v in zip(g, x)] + [("one", 4.0)] * 5 + [("nothing", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in charts.box_stats(df, "x", "g").collect()}
    assert set(got) == {"g0", "g1", "g2", "one"}
    for k, r in got.items():
        v = np.array([b for a, b in rows if a == k])
        q1, q2, q3 = np.quantile(np.sort(v), [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert (r["n"], r["outliers"]) == (len(v), len(v) - len(inside))
