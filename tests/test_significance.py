import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest

from equiframe.functions import pvalues as P
from equiframe.operators import significance as sig


def test_published_table_points():
    assert P.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert P.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert P.chi2_tail(135.806723, 100) == pytest.approx(0.01, abs=1e-6)
    assert P.f_tail(3.354131, 2, 27) == pytest.approx(0.05, abs=1e-6)
    assert P.f_tail(2.244, 8, 30) == pytest.approx(0.0527, abs=2e-3)
    assert P.kolmogorov_tail(1.358099) == pytest.approx(0.05, abs=1e-5)
    assert P.f_tail(math.inf, 2, 5) == 0.0 and P.chi2_tail(0, 4) == 1.0


@pytest.mark.parametrize("n1, n2", [(3, 4), (5, 5), (4, 6)])
def test_exact_ks_tail_against_enumeration(n1, n2):
    def distance(first):
        c1 = c2 = top = 0
        for i in range(n1 + n2):
            c1, c2 = (c1 + 1, c2) if i in first else (c1, c2 + 1)
            top = max(top, abs(c1 * n2 - c2 * n1))
        return top
    every = [distance(set(c)) for c in itertools.combinations(range(n1 + n2), n1)]
    for top in sorted(set(every)):
        share = sum(d >= top for d in every) / len(every)
        assert P.ks_exact_tail(top / (n1 * n2), n1, n2) == pytest.approx(share)


def rows_of(spark, table, names="r string, g string"):
    return spark.createDataFrame(
        [(r, g) for (r, g), n in table.items() for _ in range(n)], names).repartition(3)


def test_chi_square_matches_ml_and_counts_empty_cells(spark):
    table = {("x", "a"): 12, ("x", "b"): 5, ("y", "a"): 7, ("y", "c"): 20, ("z", "b"): 9, ("z", "c"): 3}
    df = rows_of(spark, table)
    ours = sig.chi_square(df, "r", "g").first()
    indexed = StringIndexer(inputCols=["r", "g"], outputCols=["ri", "gi"]).fit(df).transform(df)
    vectors = VectorAssembler(inputCols=["ri"], outputCol="v").transform(indexed)
    ml = ChiSquareTest.test(vectors, "v", "gi").first()
    assert ours["stat"] == pytest.approx(ml["statistics"][0])
    assert ours["dof"] == ml["degreesOfFreedom"][0] == 4
    assert ours["p_value"] == pytest.approx(ml["pValues"][0], abs=1e-9)


@pytest.mark.parametrize("cells", [(10, 20, 30, 5), (8, 0, 3, 9), (5, 5, 5, 5)])
def test_chi_square_corrects_two_by_two(spark, cells):
    names = [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")]
    df = rows_of(spark, dict(zip(names, cells)))
    o = np.array(cells, float).reshape(2, 2)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    away = np.abs(o - e)
    expected = ((away - np.minimum(0.5, away)) ** 2 / e).sum()
    got = sig.chi_square(df, "r", "g").first()
    assert got["dof"] == 1 and got["stat"] == pytest.approx(expected)


def test_chi_square_without_freedom(spark):
    got = sig.chi_square(rows_of(spark, {("x", "a"): 3, ("x", "b"): 4}), "r", "g").first()
    assert (got["dof"], got["stat"], got["p_value"]) == (0, 0.0, 1.0)


def test_anova(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(1000, 1, 30), "b": rng.normal(1000.5, 2, 50), "c": rng.normal(1000, 1, 7)}
    df = spark.createDataFrame(
        [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 1.0), ("a", None)], "g string, x double")
    every = np.concatenate(list(groups.values()))
    ssb = sum(len(x) * (x.mean() - every.mean()) ** 2 for x in groups.values())
    ssw = sum(((x - x.mean()) ** 2).sum() for x in groups.values())
    got = sig.anova(df, "x", "g").first()
    assert got["stat"] == pytest.approx((ssb / 2) / (ssw / 84)) and (got["df1"], got["df2"]) == (2, 84)
    assert got["p_value"] == pytest.approx(P.f_tail(got["stat"], 2, 84))


def test_anova_edges(spark):
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    got = sig.anova(flat, "x", "g").first()
    assert got["stat"] == math.inf and got["p_value"] == 0.0
    empty_group = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, x double")
    assert sig.anova(empty_group, "x", "g").first()["stat"] is None


@pytest.mark.parametrize("partitions", [1, 6])
def test_ks_pairs_against_brute_force(spark, partitions):
    rng = np.random.default_rng(5)
    samples = {"a": rng.normal(0, 1, 300).round(1), "b": rng.normal(0.4, 1, 120).round(1),
               "c": np.full(90, 0.3), "d": rng.normal(0, 3, 500)}
    df = spark.createDataFrame(
        [(g, float(x)) for g, xs in samples.items() for x in xs], "g string, x double").repartition(partitions)
    got = {(r["group1"], r["group2"]): r for r in sig.ks_pairs(df, "x", "g").collect()}
    assert len(got) == 6
    for (a, b), row in got.items():
        at = np.concatenate([samples[a], samples[b]])
        gap = max(abs((samples[a] <= v).mean() - (samples[b] <= v).mean()) for v in at)
        assert row["stat"] == pytest.approx(gap)
        assert row["p_value"] == pytest.approx(P.ks_tail(gap, len(samples[a]), len(samples[b])))


def test_ks_pairs_in_small_batches_and_tiles(spark, monkeypatch):
    """A value's rows, and a bucket's groups, that run over several batches; groups in several tiles."""
    rng = np.random.default_rng(8)
    samples = {f"g{i}": rng.integers(0, 40, rng.integers(1, 60)) * 3 + i % 4 for i in range(14)}
    df = spark.createDataFrame([(g, int(x)) for g, xs in samples.items() for x in xs], "g string, x bigint")

    def gap(a, b):
        at = np.concatenate([samples[a], samples[b]])
        return max(abs((samples[a] <= v).mean() - (samples[b] <= v).mean()) for v in at)

    want = {(a, b): (len(samples[a]), len(samples[b]), gap(a, b)) for a in samples for b in samples if a < b}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for tile in (256, 4):
            monkeypatch.setattr(sig, "TILE_GROUPS", tile)
            got = {(r["group1"], r["group2"]): (r["n1"], r["n2"], r["stat"]) for r in sig.ks_pairs(df, "x", "g", "series").collect()}
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k]) for k in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ks_pairs_edges(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert sig.ks_pairs(none, "x", "g").count() == 0
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None), ("c", float("nan"))], "g string, x double")
    assert sig.ks_pairs(one, "x", "g").count() == 0
    with pytest.raises(ValueError):
        sig.ks_pairs(one, "x", "g", "limit")


def test_standardized_difference(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("b", 3.0), ("a", 5.0), ("a", 9.0), ("one", 4.0), ("flat", 2.0), ("flat", 2.0), ("none", None)],
        "g string, x double")
    rows = sig.standardized_difference(df, "x", "g").collect()
    assert len(rows) == 6  # the group without values has no pair
    first = rows[0]
    assert (first["group1"], first["group2"], first["effect_size"]) == ("a", "flat", "Large")
    pair = next(r for r in rows if (r["group1"], r["group2"]) == ("a", "b"))
    assert pair["d"] == pytest.approx((7 - 2) / math.sqrt((8 + 2) / 2))
    lone = [r for r in rows if "one" in (r["group1"], r["group2"])]
    assert all(r["d"] is None and r["effect_size"] == "Unknown" for r in lone)
    assert sig.standardized_difference(df.filter("g = 'a'"), "x", "g").count() == 0


def test_ks_tail_has_no_step_in_size():
    tails = [P.ks_tail(200 / n, n, n) for n in range(9_998, 10_004)]  # the same step of D's lattice at each size
    assert all(0 < b - a < 2e-5 for a, b in zip(tails, tails[1:]))  # no more than one row does at any size
    assert P.ks_tail(0.02, 10_000, 20_000) == pytest.approx(P.ks_tail(0.02, 10_001, 20_002), rel=0.01)
    assert P.ks_tail(0.0200001, 10_000, 10_000) == P.ks_tail(0.0201, 10_000, 10_000)  # D has no value between
    assert P.ks_tail(0.05, 4_000, 4_000) == pytest.approx(P.ks_exact_tail(0.05, 4_000, 4_000), rel=0.01)


@pytest.mark.parametrize("n", [50, 137, 999, 1_000, 4_000, 10_000])
def test_ks_tail_of_equal_sizes_is_exact(n):
    for scaled in (0.3, 0.8, 1.4, 2.2, 3.2):
        d = math.ceil(scaled * math.sqrt(2 / n) * n) / n
        if d < 1:
            exact = P.ks_exact_tail(d, n, n)
            assert P.ks_tail(d, n, n) == pytest.approx(exact, rel=1e-7)


@pytest.mark.parametrize("n1, n2", [(50, 75), (64, 1_000), (900, 1_200), (3_001, 2_000), (10_000, 9_999)])
def test_ks_tail_of_unequal_sizes_is_exact(n1, n2):
    scale, root = math.lcm(n1, n2), math.sqrt(n1 * n2 / (n1 + n2))
    for scaled in (0.5, 1.0, 1.6, 2.5, 3.2):
        d = round(scaled / root * scale) / scale
        if d < 1:
            assert P.ks_tail(d, n1, n2) == pytest.approx(P.ks_exact_tail(d, n1, n2), rel=1e-9)


def test_ks_series_beyond_the_exact_sizes():
    for n1, n2 in ((12_000, 18_000), (15_000, 30_000), (12_001, 20_011)):
        scale, root = math.lcm(n1, n2), math.sqrt(n1 * n2 / (n1 + n2))
        for scaled in (0.6, 1.0, 1.5, 2.2):
            d = round(scaled / root * scale) / scale
            assert P.ks_tail(d, n1, n2) == pytest.approx(P.ks_exact_tail(d, n1, n2), rel=0.01)
    assert P.ks_tail(2.2 / 10, 100, 10**9) == pytest.approx(P.ks_exact_tail(2.2 / 10 * math.sqrt(1.0005), 100, 200_001), rel=0.01)
    tails = [P.ks_equal_tail(math.ceil(1.5 * math.sqrt(2 / n) * n) / n, n) for n in (10**6, 10**9, 10**12)]
    assert tails == pytest.approx([P.kolmogorov_tail(1.5)] * 3, rel=0.01)


def test_exact_ks_keeps_small_tails():
    assert 1e-21 < P.ks_exact_tail(0.12, 3_000, 3_000) < 1e-17


def test_ks_tells_large_integers_apart(spark):
    df = spark.createDataFrame([("a", 2**53), ("b", 2**53 + 1)], "g string, x bigint")
    assert sig.ks_pairs(df, "x", "g").first()["stat"] == 1
    assert sig.ks_pairs(df, "x", "g", method="exact").first()["p_value"] == 1
