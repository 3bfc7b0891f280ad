import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiframe.operators import model
from equiframe.plans.audit import model_fairness


def test_report_and_confusion(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    got = {r["class"]: r for r in model.classification_report(df).collect()}
    assert got["a"]["precision"] == pytest.approx(5 / 6) and got["a"]["recall"] == pytest.approx(5 / 7)
    assert got["c"]["precision"] == 0 and got["c"]["support"] == 1
    assert got["accuracy"]["f1"] == pytest.approx(8 / 11)
    assert got["weighted avg"]["recall"] == pytest.approx(8 / 11)
    assert got["macro avg"]["recall"] == pytest.approx((5 / 7 + 1 + 0) / 3)
    assert model.confusion_matrix(df).count() == 4


def test_confusion_of_odd_numbers(spark):
    rows = [(1, 1.0), (1, float("nan")), (0, 1e300), (0, None), (None, 1.0), (2**60, float(2**60)), (0, 0.5)]
    df = spark.createDataFrame(rows, "label bigint, prediction double")
    assert {tuple(r) for r in model.confusion_matrix(df).collect()} == {
        ("1", "1", 1), ("0", "1.0E300", 1), (str(2**60), str(2**60), 1), ("0", "0.5", 1)}
    assert model.classification_report(df).filter("class = 'accuracy'").first()["f1"] == 0.5


@pytest.mark.parametrize("partitions", [1, 7])
def test_roc_and_auc(spark, partitions):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 800)
    score = np.where(rng.random(800) < 0.35, 0.5, (rng.random(800) + 0.3 * y).round(2))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, s double").repartition(partitions)
    pos, neg = score[y == 1], score[y == 0]
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    auc = model.roc_auc(df, "y", "s").first()["auc"]
    assert auc == pytest.approx(expected)
    assert auc + model.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"] == pytest.approx(1)
    curve = model.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert curve[0]["threshold"] == math.inf and (curve[0]["fpr"], curve[0]["tpr"]) == (0, 0)
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1, 1)
    for r in curve[1::9]:
        assert r["tpr"] == pytest.approx((pos >= r["threshold"]).mean())
        assert r["fpr"] == pytest.approx((neg >= r["threshold"]).mean())
    area = np.trapezoid([r["tpr"] for r in curve], [r["fpr"] for r in curve])
    assert area == pytest.approx(expected)


@pytest.fixture(scope="module")
def table(spark):
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000
    noise = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000
    return spark.range(4000).select(
        "id", x.alias("x"), noise.alias("noise"),
        F.when(F.col("id") % 3 == 0, "red").when(F.col("id") % 3 == 1, "blue").alias("colour"),
    ).withColumn("target", F.when((F.col("x") > 0.5) | (F.col("colour") == "red"), "yes").otherwise("no"))


def test_split_is_stable_and_about_a_fifth(table):
    train, test = model.split(table, ["id"])
    assert train.count() + test.count() == 4000 and 700 < test.count() < 900
    again = model.split(table.repartition(3), ["id"])[1]
    assert {r["id"] for r in test.collect()} == {r["id"] for r in again.collect()}


def test_baseline_importance_and_fairness(spark, table):
    fitted, found = model_fairness(table, "target", ["colour"], ["x", "noise", "colour"], ["id"], repeats=3)
    assert fitted.classes == ["no", "yes"]
    # first level in text order (blue) has no dummy, and a missing colour reads like it
    assert [tuple(r) for r in fitted.features.orderBy("slot").collect()] == [(0, "x"), (1, "noise"), (2, "colour_red")]
    assert fitted.n_features == 3
    assert found["auc"].first()["auc"] > 0.95
    importance = {r["feature"]: r["importance_mean"] for r in found["importance"].collect()}
    assert importance["x"] > 0.1 and importance["colour_red"] > 0.1 and abs(importance["noise"]) < 0.02
    assert {r["group"] for r in found["output_fairness"].collect()} == {"red", "blue", None}


def test_more_classes_use_a_forest(spark, table):
    three = table.withColumn("level", F.floor(F.col("x") * 3).cast("int"))
    fitted = model.train_baseline(three, "level", ["x", "noise"], ["id"], numTrees=5, maxDepth=4)
    assert len(fitted.classes) == 3 and "RandomForest" in type(fitted.model).__name__
    report = {r["class"]: r for r in model.classification_report(fitted.scored).collect()}
    assert report["accuracy"]["f1"] > 0.9


def test_numeric_classes_keep_their_order(spark, table):
    odd = table.withColumn("level", F.when(F.col("x") > 0.5, 10).otherwise(2))
    fitted = model.train_baseline(odd, "level", ["x"], ["id"])
    assert fitted.classes == [2, 10]
    high = fitted.scored.filter("x > 0.9").agg(F.avg("probability_1")).first()[0]
    assert high > 0.8


def test_unusable_targets(spark, table):
    with pytest.raises(ValueError):
        model.train_baseline(table.withColumn("one", F.lit(1)), "one", ["x"])
    with pytest.raises(ValueError):
        model.train_baseline(table, "id", ["x"])


def test_counted_rows_fit_like_the_rows_themselves(spark):
    """The regression on counted rows against Spark's own on all of them."""
    from pyspark.ml.feature import VectorAssembler

    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    df = spark.range(5000).select(
        "id", (h % 7).cast("double").alias("x"), F.when(h % 3 == 0, "a").when(h % 3 == 1, "b").otherwise("c").alias("g"),
        F.when((h % 7 > 3) | (h % 50 == 0), "yes").otherwise("no").alias("target"))
    fitted = model.train_baseline(df, "target", ["x", "g"], ["id"])
    train, test = model.split(df, ["id"])
    rows = train.select((F.col("target") == "yes").cast("double").alias("_label"), "x",
                        (F.col("g") == "c").cast("double").alias("gc"), (F.col("g") == "b").cast("double").alias("gb"))
    plain = model.select_model(2, train.count()).fit(
        VectorAssembler(inputCols=["x", "gc", "gb"], outputCol="_features").transform(rows))
    assert fitted.model.coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), rel=1e-3)
    assert [r["feature"] for r in fitted.features.orderBy("slot").collect()] == ["x", "g_c", "g_b"]
    assert fitted.scored.count() == test.count()


def test_importance_against_plain_permutation(spark):
    """Each feature's loss from the rows, blocks and distances that the operator states."""
    h = F.pmod(F.xxhash64("id"), F.lit(997))
    df = spark.range(1500).select("id", (h / 997).alias("x"), F.when(h % 2 == 0, "a").otherwise("b").alias("g"),
                                  F.when(h % 5 == 0, 1.0).otherwise(0.0).alias("z"))
    for frame, settings in ((df.withColumn("t", ((F.col("x") > 0.6) | (F.col("g") == "b")).cast("int")), {}),
                            (df.withColumn("t", F.floor(F.col("x") * 3)), {"numTrees": 5, "maxDepth": 4})):
        fitted = model.train_baseline(frame, "t", ["x", "g", "z"], ["id"], **settings)
        got = {r["feature"]: r for r in model.permutation_importance(fitted, 4, 100).collect()}
        rows = fitted.scored.select("label", "prediction", model.vector_to_array("features").alias("v"), model.KEY_HASH).collect()
        blocks = -(-len(rows) // 100)
        number = spark.createDataFrame([(r[model.KEY_HASH],) for r in rows], "k bigint").select(
            F.pmod(F.xxhash64(F.lit(model.SEED), "k"), F.lit(blocks))).collect()
        held = {}
        for r, (b,) in zip(rows, number):
            held.setdefault(b, []).append(r)
        own, changed = [], {(j, t): [] for j in range(3) for t in range(4)}
        for b, members in sorted(held.items()):
            members.sort(key=lambda r: r[model.KEY_HASH])
            own += [(r["label"], r["v"]) for r in members]
            for j, t in changed:
                d = model._distance(b, t, len(members))
                for i, r in enumerate(members):
                    v = list(r["v"])
                    v[j] = members[(i + d) % len(members)]["v"][j]
                    changed[j, t].append((r["label"], v))

        def accuracy(pairs):
            vectors = spark.createDataFrame(pairs, "label double, v array<double>").select(
                "label", model.array_to_vector("v").alias("_features"))
            return fitted.model.transform(vectors).filter("label = _prediction").count() / len(pairs)

        base = accuracy(own)
        for j, name in enumerate(("x", "z", "g_b")):
            losses = [base - accuracy(changed[j, t]) for t in range(4)]
            assert got[name]["importance_mean"] == pytest.approx(np.mean(losses), abs=1e-12)
            assert got[name]["importance_std"] == pytest.approx(np.std(losses), abs=1e-7)


def test_a_feature_of_many_levels(spark):
    """100,000 levels: the dictionary is a table, and their names are too."""
    df = spark.range(120_000).select(
        "id", F.format_string("level %06d", F.col("id") % 100_000).alias("g"), F.lit("same").alias("one"),
        F.when(F.col("id") % 100_000 < 50_000, "low").otherwise("high").alias("t"))
    fitted = model.train_baseline(df, "t", ["g", "one"], ["id"], maxIter=5)
    assert fitted.n_features == 99_999 and fitted.features.count() == 99_999
    ends = fitted.features.agg(F.min("slot"), F.max("slot"), F.min_by("feature", "slot"), F.max_by("feature", "slot")).first()
    assert tuple(ends) == (0, 99_998, "g_level 099999", "g_level 000001")
    row = fitted.scored.filter("id = 100005 or id < 100000").select("g", "slots", "features").first()
    name = fitted.features.filter(F.col("slot") == row["slots"][0]).first()["feature"]
    assert name == f"g_{row['g']}" and row["features"].indices.tolist() == row["slots"]


def test_too_many_classes_are_refused(table, monkeypatch):
    monkeypatch.setattr(model, "MOST_CLASSES", 20)
    with pytest.raises(ValueError, match="classes"):
        model.train_baseline(table.withColumn("c", F.col("id") % 30), "c", ["x"], ["id"])


def test_a_forest_takes_many_equal_rows_in_weighted_parts(spark, monkeypatch):
    monkeypatch.setattr(model, "FOREST_ROWS", 600, raising=False)
    written = {}
    real = model.materialise

    def kept(df, name="frame"):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(model, "materialise", kept)
    df = spark.range(30_000).select("id", F.when(F.col("id") < 20, 9.0).otherwise(F.col("id") % 7).alias("x"),
                                    (F.col("id") % 3).cast("double").alias("z"))
    df = df.withColumn("t", F.when(F.col("x") == 9, "rare").when(F.col("x") > 3, "high").otherwise("low"))
    fitted = model.train_baseline(df, "t", ["x", "z"], ["id"], numTrees=5, maxDepth=4)
    train, test = model.split(df, ["id"])
    at = model.vector_to_array("_features")
    got = {(r["x"], r["z"]): (r["rows"], r["n"]) for r in written["train"].groupBy(at[0].alias("x"), at[1].alias("z")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_weight").alias("n")).collect()}
    told = {(r["x"], r["z"]): r["count"] for r in train.groupBy("x", "z").count().collect()}
    assert {k: n for k, (_, n) in got.items()} == pytest.approx(told)  # all rows count
    assert sum(rows for rows, _ in got.values()) <= 2 * 600 + len(told)
    assert all(rows == told[k] for k, (rows, _) in got.items() if k[0] == 9)  # rare rows are drawn one by one
    assert fitted.scored.count() == test.count() and fitted.scored.filter("label <> prediction").count() == 0


def test_a_small_forest_draws_single_rows(spark, table):
    cells = spark.createDataFrame([(1.0, 5), (2.0, 1)], "_label double, n bigint")
    assert {tuple(r) for r in model._parts(cells, 6, 2).collect()} == {(1.0, 5, 5, 1.0), (2.0, 1, 1, 1.0)}
