import numpy as np
import pytest
from pyspark.sql import functions as F

from equiframe.operators.prepare import recommend, summarize_categories
from equiframe.operators.profile import (
    column_rules, contingency_wide, groupwise_missing, low_variance, missing_top, modes, profile,
    table_summary, target_candidates,
)


def recommendations(df):
    return {r["column"]: r["recommendation"] for r in recommend(df).collect()}


def test_recommend_text_number_and_mostly_missing(spark):
    shades = ["teal", None, "plum", "teal", "plum", "rust", "teal", "rust"]
    hits = [None] * 6 + [4.5, 5.5]
    df = spark.createDataFrame(
        list(zip(shades, range(40, 48), hits)), "shade string, step bigint, hit double")
    assert recommendations(df) == {
        "shade": "OneHotEncoder + ImputeMissing",
        "step": "MinMaxScaler",
        "hit": "LabelEncoder + DropHighNaNs",
    }


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    row = profile(df).first()
    assert (row["non_null"], row["n_unique"], row["null_ratio"]) == (2, 2, 0.5)


@pytest.mark.parametrize("missing, suffix", [
    (0, ""), (1, " + ImputeMissing"), (30, " + ImputeMissing"),
    (31, " + ImputeMissing + ⚠️ HighMissingRate"), (50, " + ImputeMissing + ⚠️ HighMissingRate"),
    (51, " + ImputeMissing + ⚠️ ConsiderDropping"), (69, " + ImputeMissing + ⚠️ ConsiderDropping"),
    (70, " + DropHighNaNs"),
])
def test_missing_ladder(spark, missing, suffix):
    values = [None] * missing + [float(i) for i in range(100 - missing)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert recommendations(df) == {"x": "MinMaxScaler" + suffix}


def test_encoder_ladder(spark):
    rows = [(f"v{i % 10}", f"v{i % 11}", f"v{i % 51}", i % 5, float(2 ** (i % 60)), -float(2 ** (i % 60)), i > 3)
            for i in range(600)]
    df = spark.createDataFrame(
        rows, "ten string, eleven string, many string, five int, right double, left double, flag boolean")
    assert recommendations(df) == {
        "ten": "OneHotEncoder", "eleven": "LabelEncoder", "many": "LabelEncoder + ⚠️ HighCardinality",
        "five": "LabelEncoder", "right": "Log1pTransform", "left": "PowerTransform", "flag": "UnknownType",
    }


def test_empty_column_is_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert recommendations(df)["b"] == "DropColumn"


def test_every_distinct_value_is_counted(spark):
    df = spark.range(5000).select(
        (F.col("id") % 7).cast("string").alias("few"), F.concat(F.lit("u"), "id").alias("ident"),
        (F.col("id") % 3000).alias("many"), (F.col("id") % 2).alias("bit"))
    found = {r["column"]: (r["n_unique"], r["is_binary"]) for r in profile(df).collect()}
    assert found == {"few": (7, False), "ident": (5000, False), "many": (3000, False), "bit": (2, True)}
    assert {r["column"]: r["n_unique"] for r in recommend(df).collect()}["many"] == 3000


def test_low_variance_without_numbers(spark):
    assert low_variance(spark.createDataFrame([("a",)], "t string")).count() == 0


def test_skewness_is_the_moment_ratio(spark):
    values = np.array([1.0, 2, 3, 10, 4, 4, 7])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    centred = values - values.mean()
    expected = (centred ** 3).mean() / (centred ** 2).mean() ** 1.5
    assert profile(df).first()["skewness"] == pytest.approx(expected)


def test_rules(spark):
    rows = [(f"n{i}", i % 3, i, i % 2, "x" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "name string, level int, patient_no int, flag int, outcome string")
    found = {r["column"]: r.asDict() for r in column_rules(df).collect()}
    assert found["name"]["id_like"] and not found["name"]["valid_target"]
    assert found["level"]["group_eligible"] and not found["patient_no"]["group_eligible"]
    assert not found["patient_no"]["valid_target"] and found["outcome"]["valid_target"]
    assert [r["column"] for r in target_candidates(df).collect()] == ["outcome"]


def test_summary_and_modes(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 4.0), ("a", None)], "t string, x double")
    assert [(r["column"], r["top"], r["freq"]) for r in modes(df, ["t"]).collect()] == [("t", "a", 2)]
    got = {(r["column"], r["statistic"]): r["number"] if r["text"] is None else r["text"]
           for r in table_summary(df).collect()}
    assert got[("t", "top")] == "a" and got[("t", "unique")] == 2
    assert got[("x", "50%")] == 2.0 and got[("x", "75%")] == 3.0 and got[("x", "count")] == 3


def test_categories(spark):
    df = spark.createDataFrame(
        [(f"c{i % 3}", i, None, i) for i in range(20)],
        "`demo.race` string, `demo.age` int, `demographic` string, plain int")
    plan = recommend(df)
    exact = {r["category"]: r.asDict() for r in summarize_categories(plan).collect()}
    assert exact["demo"]["columns"] == 2 and exact["project"]["columns"] == 2
    assert exact["project"]["drop_recommended"] == 1 and exact["project"]["avg_missing"] == "50.0%"
    prefix = {r["category"]: r.asDict() for r in summarize_categories(plan, "prefix").collect()}
    assert prefix["demo"]["columns"] == 3  # also catches the undotted name


def test_small_aggregates(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0, 0.001), ("a", None, None, 0.002), ("b", "y", 2.0, 0.003), (None, "y", 3.0, 0.001)],
        "g string, h string, v double, w double")
    rates = {r["group"]: r["missing_rate"] for r in groupwise_missing(df, "v", "g").collect()}
    assert rates == {"a": 0.5, "b": 0.0}
    assert [r["column"] for r in low_variance(df).collect()] == ["w"]
    assert missing_top(df, 2).count() == 2
    wide = {r["row"]: (r["x"], r["y"]) for r in contingency_wide(df, "g", "h", ["x", "y"]).collect()}
    assert wide == {"a": (1, 0), "b": (0, 1)}
