import numpy as np
import pytest

from equiframe.operators import representation as rep
from equiframe.plans.audit import fairness_audit, interactive_audit
from equiframe.sources.benchmark import benchmark_from_dict, benchmark_from_json, observed_benchmark


def people(spark, counts):
    rows = [(g,) for g, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "race string").repartition(4)


def test_verdict_bounds_are_inclusive(spark):
    df = people(spark, {"a": 40, "b": 25, "c": 35})
    bench = {"a": 0.5, "b": 0.2, "c": 0.28}
    got = {r["group"]: r for r in rep.input_fairness(df, "race", bench).collect()}
    assert got["a"]["fair"] == "Fair" and got["a"]["deviation_type"] == "Within bounds"     # 0.8
    assert got["b"]["fair"] == "Fair"                                                     # 1.25
    tight = {r["group"]: r for r in rep.input_fairness(df, "race", {"a": 0.51, "b": 0.19, "c": 0.3}).collect()}
    assert tight["a"]["deviation_type"] == "Under-represented"
    assert tight["b"]["deviation_type"] == "Over-represented" and tight["b"]["fair"] == "Not Fair"


def test_missing_group_and_order(spark):
    df = people(spark, {"a": 5, None: 3, "b": 2})
    rows = rep.input_fairness(df, "race", {"a": 0.6, "b": 0.4, "unseen": 0.0}).collect()
    assert [r["group"] for r in rows] == ["a", None, "b"]
    assert rows[1]["expected_share"] == 0.0001 and rows[1]["observed_share"] == pytest.approx(0.3)
    by_ratio = rep.input_fairness(df, "race", {"a": 0.6, "b": 0.4}, sort_by="disparity_ratio").first()
    assert by_ratio["group"] is None


def test_integer_groups_match_text_benchmark(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    rows = rep.input_fairness(df, "k", {"1": 0.5, "2": 0.5}).collect()
    assert {r["group"]: r["expected_share"] for r in rows} == {"1": 0.5, "2": 0.5}


def test_validation(spark):
    df = people(spark, {"Black": 1})
    with pytest.raises(ValueError):
        rep.input_fairness(df, "nope", {"a": 1.0})
    with pytest.raises(ValueError):
        rep.input_fairness(df.filter("race = 'x'"), "race", {"a": 1.0})
    with pytest.raises(ValueError):
        rep.input_fairness(df, "race", ["a"])
    with pytest.warns(UserWarning):
        rep.input_fairness(df, "race", {"Black": 0.5})
    assert rep.input_fairness(df, "race").first()["expected_share"] == 0.36


def brute_distances(p, q):
    p, q = np.array(p), np.array(q)
    a, b = np.maximum(p, 1e-8), np.maximum(q, 1e-8)
    a, b = a / a.sum(), b / b.sum()
    w = np.abs(np.sort(p / p.sum()) - np.sort(q / q.sum())).mean()
    return (a * np.log(a / b)).sum(), w, np.abs(p - q).sum() / 2


def test_distances_against_brute_force(spark):
    df = people(spark, {"a": 50, "b": 20, "c": 20, "d": 7, "e": 3})
    bench = {"a": 0.2, "b": 0.2, "c": 0.3, "d": 0.25}
    result = rep.input_fairness(df, "race", bench)
    rows = result.collect()
    expected = brute_distances([r["observed_share"] for r in rows], [r["expected_share"] for r in rows])
    assert tuple(rep.distribution_distance(result).first()) == pytest.approx(expected)


def test_equal_distributions_have_no_distance(spark):
    df = people(spark, {"a": 3, "b": 3, "c": 4})
    found = rep.distribution_distance(rep.input_fairness(df, "race", {"a": 0.3, "b": 0.3, "c": 0.4})).first()
    assert tuple(found) == pytest.approx((0, 0, 0), abs=1e-12)


def test_severity_bounds(spark):
    values = spark.createDataFrame([(0.05, 0.30, 0.0999)], "kl_divergence double, wasserstein_distance double, total_variation double")
    got = {r["metric"]: r["severity"] for r in rep.severity_labels(values).collect()}
    assert got == {"kl_divergence": "🟢 Good alignment", "wasserstein_distance": "🚨 Severe deviation",
                   "total_variation": "✅ Excellent alignment"}


def test_summary_and_charts(spark):
    df = people(spark, {"a": 60, "b": 30, "c": 10})
    result = rep.input_fairness(df, "race", {"a": 0.6, "b": 0.1, "c": 0.3})
    row = rep.fairness_summary(result).first()
    assert (row["total_groups"], row["fair_groups"], row["unfair_groups"]) == (3, 1, 2)
    assert [(r["group"], r["extreme"]) for r in rep.top_disparity(result, 2).collect()] == [("b", True), ("a", False)]
    assert rep.observed_vs_expected(result, 1).count() == 2


def test_benchmarks(spark):
    df = people(spark, {"a": 2, "b": 1, "unknown": 5, None: 4})
    observed = {r["group"]: r["expected"] for r in observed_benchmark(df, "race").collect()}
    assert observed == {"a": 0.667, "b": 0.333}
    typed = benchmark_from_json(df, "race", '{"a": 0.25, "b": 0.75}').collect()
    assert {r["group"]: r["expected"] for r in typed} == {"a": 0.25, "b": 0.75}
    assert benchmark_from_json(df, "race", "{oops").count() == 2
    assert benchmark_from_dict(spark, {1: 1}).first()["group"] == "1"


def test_audits(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 1, 0), ("b", 0, 0)], "g string, y int, p int")
    parts = fairness_audit(df, "g", "y", "p", {"a": 0.5, "b": 0.5})
    assert set(parts) == {"input_fairness", "summary", "output_fairness", "disparities"}
    assert interactive_audit(df, "g")["summary"].first()["unfair_groups"] == 0


def test_nan_is_no_group_of_the_observed_benchmark(spark):
    from equiframe.sources.benchmark import observed_benchmark
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (float("nan"),), (None,)], "g double")
    assert {(r["group"], r["expected"]) for r in observed_benchmark(df, "g").collect()} == {("1.0", 0.667), ("2.0", 0.333)}


def test_distance_of_many_groups_needs_no_single_sort(spark):
    rng = np.random.default_rng(4)
    p, q = rng.random(700).round(2) + 0.01, rng.random(700)
    shares = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, q)], "observed_share double, expected_share double")
    expected = np.abs(np.sort(p / p.sum()) - np.sort(q / q.sum())).mean()
    assert rep._wasserstein(shares).first()[0] == pytest.approx(expected)
    assert rep._integrated_gap(shares.repartition(5)).first()[0] == pytest.approx(expected)
