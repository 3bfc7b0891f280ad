import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from equiframe.operators import prepare as prep


def test_impute_mode_tie_and_median(spark):
    df = spark.createDataFrame(
        [("b", 1.0, 1), ("a", 2.0, 4), ("b", 4.0, None), ("a", None, 2), (None, 9.0, 3)],
        "t string, x double, i int")
    rows = prep.impute(df, ["t", "x", "i"]).collect()
    assert rows[4]["t"] == "a"          # the smaller of two modes
    assert rows[3]["x"] == 3.0          # median of 1, 2, 4, 9
    assert rows[2]["i"] == 2.5          # a fractional median widens the column


def test_impute_without_values_uses_fallback(spark):
    df = spark.createDataFrame([(None, None)], "t string, x double")
    assert prep.impute(df, ["t", "x"]).first().asDict() == {"t": "missing_fallback", "x": None}


def test_one_hot_order_missing_and_limit(spark):
    df = spark.createDataFrame(
        [(i, ("b", "a", None)[i % 3], f"w{i}") for i in range(60)], "id int, `d.t` string, wide string")
    out = prep.one_hot(df, ["d.t", "wide"])
    assert out.columns == ["id", "wide", "d.t_a", "d.t_b"]
    assert out.filter("id = 2").select("`d.t_a`", "`d.t_b`").first() == (False, False)


def test_label_encode_text_order(spark):
    df = spark.createDataFrame([("b", 9), ("a", 10), (None, None), ("z", 10)], "t string, n int")
    out = prep.label_encode(df, ["t", "n"]).collect()
    # the missing label sorts between its neighbours; numbers sort as text
    assert [r["t"] for r in out] == [1, 0, 2, 3]
    assert [r["n"] for r in out] == [1, 0, 2, 0]


@pytest.mark.parametrize("bound, limit", [("LOOKUP_ROWS", 0), ("LOOKUP_ROWS", 20_000), ("LOOKUP_BYTES", 100)])
def test_label_codes_of_many_labels_with_a_hot_one(spark, monkeypatch, bound, limit):
    monkeypatch.setattr(prep, bound, limit)
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("t"), "id")
    out = prep.label_encode(df, ["t"]).join(df.withColumnRenamed("t", "was"), "id").collect()
    assert len(out) == 6000
    order = {t: i for i, t in enumerate(sorted({r["was"] for r in out}))}
    assert all(order[r["was"]] == r["t"] for r in out)


@pytest.mark.parametrize("limit", [0, 20_000])
def test_large_columns_share_one_dictionary(spark, monkeypatch, limit):
    monkeypatch.setattr(prep, "LOOKUP_ROWS", limit)
    written, write = [], prep.materialise
    monkeypatch.setattr(prep, "materialise", lambda df, name: written.append(name) or write(df, name))
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 900)).alias("a.b"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("c"), (F.col("id") % 4).alias("d"),
        F.lit(None).cast("string").alias("e"))
    out = prep.label_encode(df, ["a.b", "c", "d", "e"])
    assert out.columns == df.columns and written == ["labels"]
    got = out.toPandas().set_index("id").sort_index()
    was = df.toPandas().set_index("id").sort_index()
    for c, values in (("a.b", was["a.b"].fillna("missing_label")), ("c", was["c"].astype(str)), ("d", was["d"].astype(str))):
        order = {t: i for i, t in enumerate(sorted(set(values)))}
        assert list(got[c]) == [order[v] for v in values]
    assert set(got["e"]) == {0}
    assert prep.label_encode(df.limit(0), ["a.b", "c"]).count() == 0


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5, -1.0), (3.0, 5, 2.0), (None, 5, 0.0)], "x double, c int, neg double")
    rows = prep.min_max_scale(df, ["x", "c"]).collect()
    assert [r["x"] for r in rows] == [0.0, 1.0, None] and [r["c"] for r in rows] == [0.0] * 3
    logged = prep.log1p_transform(df, ["x", "neg"]).collect()
    assert logged[1]["x"] == pytest.approx(math.log(4)) and logged[0]["neg"] == -1.0


def test_plan_end_to_end(spark):
    n = 40
    rows = [(i, f"c{i % 3}", f"s{i % 12}" if i % 5 else None, float(i), None if i % 5 else 1.0, None)
            for i in range(n)]
    df = spark.createDataFrame(
        rows + rows[:7], "id int, few string, some string, num double, sparse double, empty string")
    out = prep.apply_plan(df).toPandas().sort_values("id").reset_index(drop=True)
    assert list(out.columns) == ["id", "some", "num", "few_c0", "few_c1", "few_c2"]
    assert len(out) == n
    src = pd.DataFrame(rows, columns=["id", "few", "some", "num", "sparse", "empty"])
    filled = src["some"].fillna(src["some"].mode()[0])
    codes = filled.map({v: i for i, v in enumerate(sorted(filled.unique()))})
    assert out["some"].tolist() == codes.tolist()
    assert out["num"].tolist() == pytest.approx([i / (n - 1) for i in range(n)])
    assert out["few_c1"].tolist() == [i % 3 == 1 for i in range(n)]


def test_switches(spark):
    df = spark.createDataFrame([(f"c{i % 2}", float(i), None if i == 3 else i % 3) for i in range(12)],
                               "t string, x double, k int")
    plain = prep.apply_plan(df, scaling=False, encoding=False, missing=False)
    assert sorted(map(str, plain.collect())) == sorted(map(str, df.collect()))
    assert "t" in prep.apply_plan(df, encoding=False).columns
    assert prep.apply_plan(df, scaling=False).agg(F.max("x")).first()[0] == 11.0


def test_impute_truths_and_times(spark):
    rows = [(True, "2020-01-01", "2020-01-01 00:00:00"), (True, "2020-01-03", "2020-01-01 02:00:00"), (False, None, None), (None, "2020-01-05", "2020-01-01 04:00:00")]
    df = spark.createDataFrame(rows, "b boolean, d string, t string").selectExpr("b", "cast(d as date) d", "cast(t as timestamp) t")
    got = prep.impute(df, ["b", "d", "t"]).collect()
    assert [r["b"] for r in got] == [True, True, False, True]
    assert str(got[2]["d"]) == "2020-01-03" and got[2]["t"].hour == 2
