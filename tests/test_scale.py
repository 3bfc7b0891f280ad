import numpy as np
import pytest
from pyspark.sql import functions as F

from equiframe.functions.scale import (
    bucket_openings, bucketed_rows, lookup_join, materialise, quantiles, release, running_totals, salted_join,
    unordered_pairs, value_totals,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, and one group holds most rows."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random(5000) < 0.34, 7.0, rng.normal(0, 50, 5000).round(2))
    g = np.where(rng.random(5000) < 0.7, "hot", rng.choice(["a", "b", "c"], 5000))
    rows = [(str(a), float(b)) for a, b in zip(g, x)]
    return spark.createDataFrame(rows, "g string, x double").repartition(5), g, x


@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_quantiles_match_numpy(spark, skewed, buckets, monkeypatch):
    df, g, x = skewed
    monkeypatch.setattr("equiframe.functions.scale.bucket_count", lambda _: buckets)
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["q"]: r["value"] for r in quantiles(df, ["x"], at).collect()}
    assert [got[q] for q in at] == pytest.approx(np.quantile(x, at))
    per = {(r["g"], r["q"]): r["value"] for r in quantiles(df, ["x"], [0.5, 0.9], ["g"]).collect()}
    for name in np.unique(g):
        assert per[(name, 0.9)] == pytest.approx(np.quantile(x[g == name], 0.9))
        assert per[(name, 0.5)] == pytest.approx(np.median(x[g == name]))


def test_quantiles_of_one_row_and_nulls(spark):
    df = spark.createDataFrame([(5.0,), (None,), (float("nan"),)], "x double")
    assert [r["value"] for r in quantiles(df, ["x"], [0.25, 0.5]).collect()] == [5.0, 5.0]


@pytest.mark.parametrize("partitions", [1, 8])
def test_running_totals(spark, skewed, partitions):
    df, _, x = skewed
    rows = bucketed_rows(df.repartition(partitions), ["x"])
    out = running_totals(value_totals(rows, ["column"], ["n"]), bucket_openings(rows, ["column"], ["n"]),
                         ["column"], ["n"]).collect()
    values, counts = np.unique(x, return_counts=True)
    assert dict(zip(values, counts.cumsum())) == {r["value"]: r["cum_n"] for r in out}


def test_pairs_and_salted_join(spark):
    names = spark.createDataFrame([(f"g{i:02d}", i) for i in range(30)], "group string, n int")
    pairs = unordered_pairs(names, "group", ["n"])
    assert pairs.count() == 30 * 29 // 2 and pairs.filter("n1 >= n2").isEmpty()
    assert "Cartesian" not in pairs._jdf.queryExecution().toString()
    big = spark.range(1000).select(F.lit("g01").alias("group"), "id")
    joined = salted_join(big, names, ["group"], F.col("id"))
    assert joined.count() == 1000 and joined.select("n").distinct().count() == 1


def test_materialise_uses_the_shared_folder(spark):
    written = materialise(spark.range(5).select(F.col("id").alias("a.b c")))
    assert written.columns == ["a.b c"] and written.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in written.inputFiles()[0]
    assert release(spark) >= 1 and release(spark) == 0


@pytest.mark.parametrize("bound, limit", [("ROWS", 0), ("ROWS", 1000), ("BYTES", 10), ("BYTES", 1000)])
def test_lookup_join_both_ways(spark, monkeypatch, bound, limit):
    monkeypatch.setattr(f"equiframe.functions.scale.LOOKUP_{bound}", limit)
    big = spark.range(900).select((F.col("id") % 3).alias("k"), "id")
    summary = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    joined = lookup_join(big, summary, ["k"], F.col("id"))
    assert joined.count() == 600
    assert ("_salt" in joined._jdf.queryExecution().toString()) == (limit < 1000)


@pytest.mark.parametrize("limit", [0, 20_000])
def test_quantiles_both_ways(skewed, monkeypatch, limit):
    monkeypatch.setattr("equiframe.functions.scale.LOOKUP_ROWS", limit)
    df, g, x = skewed
    got = {r["g"]: r["value"] for r in quantiles(df, ["x"], [0.3], ["g"]).collect()}
    assert got == pytest.approx({k: np.quantile(x[g == k], 0.3) for k in np.unique(g)})
