import math

import numpy as np
import pytest

from equiframe.operators import outcome


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a", "x", 1, 1)] * 6 + [("a", "y", 0, 1)] * 2 + [("a", "x", 1, 0)] * 1 + [("a", "y", 0, 0)] * 1
    rows += [("b", "x", 1, 1)] * 2 + [("b", "y", 0, 1)] * 1 + [("b", "y", 1, 0)] * 3 + [("b", "x", 0, 0)] * 4
    rows += [("c", "x", 0, 0)] * 5 + [(None, "x", 1, 1)]
    return spark.createDataFrame(rows, "g string, h string, y int, p int").repartition(3)


def test_group_metrics_and_undefined_ratios(scored):
    got = {r["group"]: r for r in outcome.output_fairness(scored, "y", "p", "g").collect()}
    a = got["a"]
    assert (a["tp"], a["fp"], a["fn"], a["tn"], a["n"]) == (6, 2, 1, 1, 10)
    assert (a["accuracy"], a["precision"], a["selection_rate"]) == pytest.approx((0.7, 0.75, 0.8))
    assert a["recall"] == pytest.approx(6 / 7) and a["f1"] == pytest.approx(12 / 15)
    c = got["c"]
    assert (c["precision"], c["recall"], c["f1"], c["accuracy"]) == (0, 0, 0, 1)
    assert got[None]["n"] == 1


def test_gaps(scored):
    by_group = outcome.output_fairness(scored.filter("g IS NOT NULL"), "y", "p", "g")
    row = outcome.parity_odds(by_group).first()
    assert row["demographic_parity_difference"] == pytest.approx(0.8)
    tpr, fpr = [6 / 7, 2 / 5, 0], [2 / 3, 1 / 5, 0]
    assert row["equalized_odds_difference"] == pytest.approx(max(np.ptp(tpr), np.ptp(fpr)))
    rows = outcome.disparities(by_group).collect()
    values = {(r["metric"], r["statistic"]): r["value"] for r in rows}
    assert values[("precision", "ratio")] == math.inf
    assert values[("accuracy", "ratio")] == pytest.approx(1 / 0.6)
    assert [r["value"] for r in rows] == sorted((r["value"] for r in rows), reverse=True)
    assert {r["plain_name"] for r in rows} >= {"Overall Correctness", "Demographic Parity Difference"}


def test_attributes_together_and_own_metric(scored):
    both = outcome.output_fairness(
        scored, "y", "p", ["g", "h"], metrics={"miss_rate": lambda tp, fp, fn, tn: fn / (tp + fp + fn + tn)})
    assert both.filter("attribute = 'h'").agg({"n": "sum"}).first()[0] == scored.count()
    alone = outcome.output_fairness(
        scored, "y", "p", "h", metrics={"miss_rate": lambda tp, fp, fn, tn: fn / (tp + fp + fn + tn)})
    assert sorted(both.filter("attribute = 'h'").collect()) == sorted(alone.collect())


def test_positive_class_by_name(spark):
    df = spark.createDataFrame([("yes", "yes", "a"), ("no", "yes", "a")], "y string, p string, g string")
    assert outcome.output_fairness(df, "y", "p", "g", positive="yes").first()["precision"] == 0.5


def test_missing_labels_and_double_predictions(spark):
    from equiframe.operators import model
    from equiframe.operators.outcome import output_fairness
    df = spark.createDataFrame([(1, 0.9, "a"), (0, 0.1, "a"), (None, 0.95, "a")], "y int, s double, g string")
    assert model.roc_auc(df, "y", "s").first()["auc"] == 1
    said = df.selectExpr("y", "cast(s > 0.5 as double) as p", "g")
    row = output_fairness(said, "y", "p", "g").first()
    assert (row["n"], row["left_out"], row["accuracy"]) == (2, 1, 1)
    report = {r["class"]: r["f1"] for r in model.classification_report(said.filter("y is not null"), "y", "p").collect()}
    assert report["0"] == report["1"] == 1
