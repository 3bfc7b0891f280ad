import numpy as np
import pytest
from pyspark.sql import functions as F

from equiframe.operators import charts


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, 700), np.full(300, 0.25), [15.0, -12.0]])
    g = np.array(["a", "b"])[rng.integers(0, 2, len(x))]
    rows = [(str(k), float(v)) for k, v in zip(g, x)] + [(None, 1.0), ("a", None)]
    return spark.createDataFrame(rows, "gender string, x double").repartition(5), g, x


def test_box(numbers):
    df, g, x = numbers
    for r in charts.box_stats(df, "x", "gender").collect():
        v = x[g == r["gender"]]
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert (r["n"], r["outliers"]) == (len(v), len(v) - len(inside))


@pytest.mark.parametrize("bins", [20, "auto"])
def test_histogram_matches_numpy(numbers, bins):
    df, _, x = numbers
    values = np.append(x, 1.0)
    if bins == "auto":  # the narrower of two estimators
        edges = max((np.histogram_bin_edges(values, e) for e in ("fd", "sturges")), key=len)
        counts, edges = np.histogram(values, edges)
    else:
        counts, edges = np.histogram(values, bins)
    got = {r["bin"]: r for r in charts.histogram(df, "x", bins).collect()}
    assert {b: r["n"] for b, r in got.items()} == {i: n for i, n in enumerate(counts) if n}
    assert all(r["low"] == pytest.approx(edges[b]) for b, r in got.items())


def test_constant_histogram(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    rows = charts.histogram(df, "x", 2).collect()
    assert [(r["bin"], r["n"], r["low"]) for r in rows] == [(1, 4, 3.0)]
    assert charts.density(df, "x").count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_density(numbers, partitions):
    df, _, x = numbers
    values = np.append(x, 1.0)
    width = values.std(ddof=1) * len(values) ** -0.2
    got = charts.density(df.repartition(partitions), "x", 50).orderBy("point").collect()
    grid = np.linspace(values.min(), values.max(), 50)
    expected = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert [r["x"] for r in got] == pytest.approx(grid)
    assert [r["density"] for r in got] == pytest.approx(expected)


def test_counts_and_labels(spark):
    rows = [("m", None, 30.0, f"id{i}") for i in range(3)] + [(None, None, 80.0, "id9")]
    df = spark.createDataFrame(
        rows, "`demographic.sex` string, `demographic.none` string, `demographic.age_at_index` double, "
              "`demographic.key` string")
    got = {(r["attribute"], r["category"]): r["n"] for r in charts.demographic_counts(df, df.columns).collect()}
    assert got == {("demographic.sex", "m"): 3, ("demographic.sex", "None"): 1,
                   ("demographic.age_at_index", "25-49"): 3, ("demographic.age_at_index", ">75"): 1}
    assert {r["label"] for r in charts.column_labels(df).collect()} == {"Sex", "None", "Age At Index", "Key"}


def test_groupwise(numbers, spark):
    df, g, x = numbers
    boxes = charts.groupwise(df, ["gender"], "x").filter("statistic = 'n'").collect()
    assert {r["group"]: r["value"] for r in boxes} == {k: float((g == k).sum()) for k in "ab"}
    counts = charts.groupwise(df, ["gender"]).collect()
    assert {r["statistic"] for r in counts} == {"count"} and sum(r["value"] for r in counts) == len(x) + 1
    many = spark.createDataFrame([(f"r{i % 25:02d}", "y" if i % 2 else "n") for i in range(510)], "race string, result string")
    shares = charts.groupwise(many, ["race"], "result")
    assert shares.select("group").distinct().count() == 20
    assert shares.groupBy("group").sum("value").filter("abs(`sum(value)` - 1) > 1e-9").isEmpty()
    ids = charts.groupwise(many, ["race"], "patient_id")  # not a column: falls back to counts
    assert {r["statistic"] for r in ids.collect()} == {"count"}


def test_group_profile(spark):
    df = spark.createDataFrame([("a", 0.0, 5, 1.0), ("a", 10.0, 5, None), ("b", 5.0, 5, 3.0)], "g string, x double, c int, z double")
    got = {(r["group"], r["metric"]): r["value"] for r in charts.group_profile(df, "g", ["x", "c", "z"]).collect()}
    assert got == {("a", "x"): 0.5, ("b", "x"): 0.5, ("a", "c"): 0.0, ("b", "c"): 0.0, ("a", "z"): 0.0, ("b", "z"): 1.0}
    with pytest.raises(ValueError):
        charts.group_profile(df, "g", ["x"])


def test_automatic_bins_of_a_heavy_tail(spark):
    from equiframe.operators.charts import histogram
    df = spark.range(1000).select((F.col("id") % 7 / 10).alias("x")).union(spark.createDataFrame([(1e12,)], "x double"))
    rows = histogram(df, "x", bins="auto").collect()
    assert sum(r["n"] for r in rows) == 1001 and max(r["bin"] for r in rows) > 2**31


def test_most_frequent_values_of_several_columns(spark):
    from equiframe.operators.charts import _top_values
    df = spark.range(600).select((F.col("id") % 50).alias("a"), F.when(F.col("id") < 300, "x").otherwise(
        F.concat(F.lit("y"), (F.col("id") % 30).cast("string"))).alias("b"))
    top = _top_values(df, ["a", "b"], 3)
    assert top["a"] == [0, 1, 2] and top["b"] == ["x", "y0", "y1"]


def test_infinite_values_are_counted_and_span_no_bin(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, inf, inf, -inf, float("nan"), None)], "x double")
    for bins in (4, "auto"):
        rows = charts.histogram(df, "x", bins).collect()
        assert {(r["low"], r["high"], r["n"]) for r in rows if r["bin"] is None} == {(inf, inf, 2), (-inf, -inf, 1)}
        inside = [r for r in rows if r["bin"] is not None]
        assert sum(r["n"] for r in inside) == 3 and min(r["low"] for r in inside) == 1 and max(r["high"] for r in inside) == 3
    finite = charts.density(df.filter("x < 4 and x > 0"), "x").orderBy("point").collect()
    assert charts.density(df, "x").orderBy("point").collect() == finite
    only = charts.histogram(spark.createDataFrame([(inf,), (inf,)], "x double"), "x").collect()
    assert [tuple(r) for r in only] == [("x", None, inf, inf, 2)]
    assert charts.histogram(df.filter("x is null"), "x").count() == 0
