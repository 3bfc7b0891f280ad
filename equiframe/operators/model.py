"""Baseline model, its evaluation, and permutation importance."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.functions.columns import clean, kinds, one_row, ref, require, rows_of, safe_div
from equiframe.functions.scale import (
    Lookup, bucket_openings, bucketed_rows, evaluated, lookup_join, materialise, partitions, running_totals, settle,
    value_totals,
)
from equiframe.operators.profile import ID_SHARE

# ship this module's task functions with their jobs, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEST_SHARE = 0.2
SEED = 42
REPEATS = 10
BLOCK_ROWS = 5_000
MOST_CLASSES = 10_000  # a model holds a number per class and feature, or per class and node
FOREST_ROWS = 1_000_000  # up to these a forest draws single rows, beyond it equal rows in parts
KEY_HASH = "key_hash"
SCORED = ("label", "prediction", "probability_1", "features", "slots", "slot_values", KEY_HASH)


@dataclass
class Baseline:
    """A fitted model, the classes in index order, feature names and the scored test rows.

    ``features`` is a frame ``(slot, feature)``: names by place in the feature vector, which has ``n_features``
    places.  ``scored`` has the source columns plus ``label``, ``prediction``, ``probability_1``,
    ``features`` and ``key_hash``, and the vector's filled places as arrays ``slots`` and ``slot_values``; these take the place of source
    columns of the same name.
    """

    model: object
    classes: list
    features: DataFrame
    n_features: int
    scored: DataFrame
    key: list[str]


def select_model(n_classes: int, n_train: int, **options):
    """Logistic regression for two classes, a random forest otherwise.

    The regression has an L2 penalty of strength 1 on the summed loss, which is
    ``1 / n`` on Spark's averaged loss.
    """
    common = {
        "labelCol": "_label", "featuresCol": "_features", "predictionCol": "_prediction",
        "probabilityCol": "_probability", "rawPredictionCol": "_raw",
    }
    if n_classes == 2:
        settings = {"maxIter": 1000, "regParam": 1.0 / max(n_train, 1), "standardization": False}
        return LogisticRegression(**common, **{**settings, **options})
    settings = {"numTrees": 100, "featureSubsetStrategy": "sqrt", "maxDepth": 16, "seed": SEED}
    return RandomForestClassifier(**common, **{**settings, **options})


def _is_test(df: DataFrame, key: Sequence[str] | None = None) -> Column:
    parts = [F.coalesce(ref(c).cast("string"), F.lit("")) for c in key or df.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000 < int(1000 * TEST_SHARE)


def split(df: DataFrame, key: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the MD5 of ``key`` (all columns by default).

    The split depends on values only, so it survives repartitioning and lost executors, and
    any engine can repeat it: the first eight hex digits of ``md5("42|key|key")``, modulo 1,000.
    """
    test = _is_test(df, key)
    return df.filter(~test), df.filter(test)


def _spread(df: DataFrame, key: Sequence[Column]) -> DataFrame:
    """Deal rows out by a hash of the key, so that neither fit nor scores follow the layout of files."""
    return df.repartition(partitions(df.sparkSession), F.xxhash64(*key))


def _classes(cells: DataFrame, target: str) -> list:
    """The classes in order.  They are part of the model, which lives on the driver: over ``MOST_CLASSES``, or a target
    that tells nearly all rows apart, are refused."""
    totals = cells.filter(F.col("_target").isNotNull()).groupBy("_target").agg(F.sum("n").alias("n"))
    seen = totals.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if seen["k"] > 2 and seen["k"] >= ID_SHARE * seen["n"]:
        raise ValueError(f"{target} tells nearly all rows apart: not a classification target")
    if seen["k"] > MOST_CLASSES:
        raise ValueError(f"{target} has {seen['k']} classes; a model holds up to {MOST_CLASSES}")
    classes = [r["_target"] for r in totals.select("_target").orderBy("_target").collect()]
    if len(classes) < 2:
        raise ValueError(f"{target} has fewer than two classes")
    return classes


class _Encoding:
    """How columns become a feature vector: numbers as they are, dummies for text.

    The first level in text order has no dummy.  A missing text has no dummy set, which is
    just what the first level has, so it is filled with that level.  Levels of all text columns are ranked together by ranges and stay
    in a table; one row per column reaches the driver.  Rows meet the table by a join per column, broadcast where a
    column has up to ``LOOKUP_ROWS`` levels.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]) -> None:
        kind = kinds(df)
        types = {f.name: f.dataType for f in df.schema.fields}
        self.text = [c for c in columns if kind[c] == "categorical"]
        self.numbers = [c for c in columns if c not in self.text and isinstance(types[c], (T.NumericType, T.BooleanType))]
        skipped = [c for c in columns if c not in self.text and c not in self.numbers]
        if skipped:
            raise ValueError(f"not usable as features: {', '.join(skipped)}")
        self.inputs = [*[ref(c).cast("double").alias(f"_n{i}") for i, c in enumerate(self.numbers)],
                       *[ref(c).alias(f"_t{i}") for i, c in enumerate(self.text)]]
        self.names = [*[f"_n{i}" for i in range(len(self.numbers))], *[f"_t{i}" for i in range(len(self.text))]]

    def learn(self, cells: DataFrame) -> None:
        """Rank the levels found in ``cells``."""
        self.first: dict[int, str] = {}
        self.size: dict[int, int] = {}
        self.lookups: dict[int, Lookup] = {}
        self.start: dict[int, int] = {}
        at = len(self.numbers)
        rows = [cells.sparkSession.createDataFrame(list(enumerate(self.numbers)), "slot bigint, feature string")]
        if self.text:
            ranked = materialise(_ranked_levels(cells, len(self.text)), "levels")
            spans = ranked.groupBy("column").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.min("level").alias("level"))
            for r in spans.orderBy("column").collect():
                i = r["column"]
                if r["n"] < 2:
                    continue  # one level tells nothing apart
                self.first[i], self.size[i], self.start[i] = r["level"], r["n"], at
                own = ranked.filter(F.col("column") == i)
                index = F.lit(r["n"] - 1 + r["rank"]) - F.col("rank")  # from the last level down, so that the first has no dummy
                self.lookups[i] = settle(own.select(F.col("level").alias(f"_t{i}"), index.cast("double").alias(f"_i{i}")))
                rows.append(own.filter(F.col("rank") > r["rank"]).select(
                    (F.lit(at) + index).alias("slot"), F.concat(F.lit(f"{self.text[i]}_"), F.col("level")).alias("feature")))
                at += r["n"] - 1
        self.features, self.n_features = evaluated(reduce(DataFrame.unionByName, rows), "features"), at

    def encode(self, frame: DataFrame, spread: Column) -> DataFrame:
        """``frame`` with ``_features``, and with the vector's filled places as ``slots`` and ``slot_values``."""
        for i, first in self.first.items():
            frame = lookup_join(frame.withColumn(f"_t{i}", F.coalesce(f"_t{i}", F.lit(first))), self.lookups[i], [f"_t{i}"], spread)
        coded = list(self.first)
        if coded:
            largest = frame.sparkSession.range(1).select(*[F.lit(float(self.size[i] - 1)).alias(f"_i{i}") for i in coded])
            frame = OneHotEncoder(inputCols=[f"_i{i}" for i in coded], outputCols=[f"_v{i}" for i in coded], dropLast=True).fit(
                largest).transform(frame)
        numbers = [f"_n{i}" for i in range(len(self.numbers))]
        dummies = F.filter(F.array(*[F.when(F.col(f"_i{i}") < self.size[i] - 1, (F.lit(self.start[i]) + F.col(f"_i{i}")).cast("int"))
                                     for i in coded]).cast("array<int>"), lambda v: v.isNotNull())
        own = F.array(*[F.lit(i) for i in range(len(numbers))]).cast("array<int>")
        return VectorAssembler(inputCols=[*numbers, *[f"_v{i}" for i in coded]], outputCol="_features").transform(frame).withColumn(
            "slots", F.concat(own, dummies)).withColumn(
            "slot_values", F.concat(F.array(*map(F.col, numbers)).cast("array<double>"), F.transform(dummies, lambda v: F.lit(1.0))))


def _ranked_levels(cells: DataFrame, columns: int) -> DataFrame:
    """``(column, level, rank)`` of all levels of all text columns, in order, ranked by ranges."""
    place = F.monotonically_increasing_id()
    ranged = materialise(
        cells.select(rows_of([{"column": F.lit(i), "level": F.col(f"_t{i}")} for i in range(columns)]))
        .filter(F.col("level").isNotNull()).distinct()
        .repartitionByRange("column", "level").sortWithinPartitions("column", "level")
        .select("column", "level", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row per partition
        ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")))
    return ranged.join(starts, "part").select("column", "level", (F.col("start") + F.col("place")).alias("rank"))


def _parts(cells: DataFrame, total: int, distinct: int) -> DataFrame:
    """``cells`` with ``_parts`` and ``_weight``: how many rows of the fit stand for ``n`` equal ones, and the weight of each.

    The weights of a cell add up to its count, so every row takes part.  Each tree draws every part a Poisson number of
    times.  Up to ``FOREST_ROWS`` rows in all, a part is a row.  Beyond that a cell has its share of ``FOREST_ROWS``, and at least
    an equal share of them, so that rare cells are still drawn row by row; parts are at most twice ``FOREST_ROWS`` and one per cell.
    """
    share = F.ceil(F.col("n") * F.lit(FOREST_ROWS / max(total, 1)))
    parts = F.least(F.col("n"), F.greatest(share, F.lit(FOREST_ROWS // max(distinct, 1))))
    return cells.withColumn("_parts", parts).withColumn("_weight", F.col("n") / F.col("_parts"))


def train_baseline(
    df: DataFrame, target: str, features: Sequence[str] | None = None,
    key: Sequence[str] | None = None, **options,
) -> Baseline:
    """Fit on 80 % of the rows, score the other 20 %.

    Equal rows of target and features are counted first, in the one pass before the fit; classes, levels and the
    training rows come from that table.  The regression weighs each by its count, which is the same loss; a
    forest draws its samples from the rows themselves, or from weighted parts of equal rows (:func:`_parts`).
    Scored rows are written once to the shared folder: evaluation, importance and the fairness audit all read them.
    """
    require(df, target, *(features or []), *(key or []))
    df = clean(df).filter(ref(target).isNotNull())
    features = list(features or [c for c in df.columns if c != target])
    key = list(key or df.columns)
    encoding = _Encoding(df, features)
    inputs = [ref(target).alias("_target"), *encoding.inputs]
    cells = materialise(
        df.select(_is_test(df, key).alias("_test"), *inputs)
        .groupBy("_test", "_target", *encoding.names).agg(F.count(F.lit(1)).alias("n")), "cells")
    classes = _classes(cells, target)
    encoding.learn(cells)
    indexed = Lookup(df.sparkSession.createDataFrame(
        [(c, float(i)) for i, c in enumerate(classes)],
        T.StructType([T.StructField("_target", df.schema[target].dataType), T.StructField("_label", T.DoubleType())])), True)

    def labelled(frame: DataFrame, spread: Column) -> DataFrame:
        return encoding.encode(lookup_join(frame, indexed, ["_target"], spread), spread)

    train = cells.filter(~F.col("_test"))
    total, distinct = train.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ready = labelled(train, F.xxhash64(*encoding.names)).select("_label", "_features", "n")
    if len(classes) == 2:
        ready = ready.withColumn("_weight", F.col("n").cast("double"))
        model = select_model(2, total, **{"weightCol": "_weight", **options}).fit(ready)
    else:
        copies = _parts(ready, total, distinct).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_parts"))))
        rows = _spread(copies, [F.col("_copy"), F.col("_label"), vector_to_array("_features")]).select("_label", "_features", "_weight")
        model = select_model(len(classes), total, **{"weightCol": "_weight", **options}).fit(materialise(rows, "train"))
    test = _spread(df.filter(_is_test(df, key)).select("*", *inputs), [ref(c) for c in key])
    scored = model.transform(labelled(test, F.xxhash64(*[ref(c) for c in key]))).select(
        *[ref(c) for c in df.columns if c not in SCORED],
        F.col("_label").alias("label"), F.col("_prediction").alias("prediction"),
        F.element_at(vector_to_array("_probability"), 2).alias("probability_1"),
        F.col("_features").alias("features"), "slots", "slot_values", F.xxhash64(*[ref(c) for c in key]).alias(KEY_HASH),
    )
    return Baseline(model, classes, encoding.features, encoding.n_features, materialise(scored, "scored"), key)


# --- evaluation ---------------------------------------------------------------------

def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per true and predicted class, ``(label, prediction, n)``.

    Two numeric columns are compared as numbers, so an integer label meets the doubles that models
    predict; whole numbers are written without a fraction.  Rows without a label or a prediction, NaN
    included, are in no cell.
    """
    require(df, label, prediction)
    df = clean(df).filter(ref(label).isNotNull() & ref(prediction).isNotNull())
    both = [ref(label), ref(prediction)]
    if all(isinstance(df.schema[c].dataType, T.NumericType) for c in (label, prediction)):
        both = [_class_text(c) for c in both]
    return (
        df.groupBy(both[0].cast("string").alias("label"), both[1].cast("string").alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _class_text(value: Column) -> Column:
    whole, number = value.try_cast("bigint"), value.cast("double")  # none for numbers beyond a long
    return F.when(whole.cast("double") == number, whole.cast("string")).otherwise(number.cast("string"))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy and two averages."""
    cells = confusion_matrix(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    per_class = (
        cells.select(F.inline(F.array(
            F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("actual"),
                     F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                     F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
        )))
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"))
        .select(
            "class",
            safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
            safe_div(F.col("tp"), F.col("support")).alias("recall"),
            safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
            "support", "tp",
        )
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = per_class.agg(*[F.avg(s).alias(s) for s in scores], total.alias("support"))
    weighted = per_class.agg(
        *[safe_div(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
        total.alias("support"))
    hits = per_class.agg(safe_div(F.sum("tp"), total).alias("a"), total.alias("support"))
    accuracy = hits.select(*[F.col("a").alias(s) for s in scores], "support")
    out = per_class.drop("tp")
    for name, row in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(row.withColumn("class", F.lit(name)))
    return out


def _score_totals(df: DataFrame, label: str, score: str, positive) -> tuple[DataFrame, DataFrame]:
    require(df, label, score)
    hit = ref(label) == F.lit(positive)
    rows = bucketed_rows(
        clean(df).filter(ref(label).isNotNull()), [score],  # a row without a label is on neither side
        sums={"pos": hit.cast("bigint"), "neg": (~hit).cast("bigint")},
    ).drop("column").withColumn("curve", F.lit(1))
    return rows, value_totals(rows, ["curve"], ["pos", "neg"])


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score, from (0, 0) at infinity down.

    Scores are cut into buckets that are sorted separately; no task sorts them all.
    """
    rows, values = _score_totals(df, label, score, positive)
    # from the highest score down, so buckets count backwards
    down = rows.withColumn("bucket", -F.col("bucket"))
    values = values.withColumn("bucket", -F.col("bucket"))
    openings = bucket_openings(down, ["curve"], ["pos", "neg"])
    ends = one_row(openings.agg(F.max("total_pos").alias("p"), F.max("total_neg").alias("n")))
    curve = running_totals(values, openings, ["curve"], ["pos", "neg"], descending=True).select(
        F.col("value").alias("threshold"), "cum_neg", "cum_pos")
    start = df.sparkSession.createDataFrame([(float("inf"), 0, 0)], curve.schema)
    return curve.unionByName(start).select(
        "threshold", safe_div(F.col("cum_neg"), ends.getField("n")).alias("fpr"),
        safe_div(F.col("cum_pos"), ends.getField("p")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Exact area under the ROC curve, ties counted half: one row ``(auc, positives, negatives)``."""
    rows, values = _score_totals(df, label, score, positive)
    openings = bucket_openings(rows, ["curve"], ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg").cast("double") / 2
    return (
        running_totals(values, openings, ["curve"], ["pos", "neg"])
        .agg(F.sum(F.col("pos") * below).alias("u"), F.sum("pos").alias("positives"),
             F.sum("neg").alias("negatives"))
        .select(safe_div(F.col("u"), F.col("positives").cast("double") * F.col("negatives"), None).alias("auc"),
                "positives", "negatives")
    )


# --- permutation importance -----------------------------------------------------------

def permutation_importance(fitted: Baseline, repeats: int = REPEATS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Loss of accuracy when one feature is shuffled: ``(feature, importance_mean, importance_std)``.

    A hash of the key puts rows in blocks of about ``block_rows`` and in an order within them; that is the one
    shuffle.  A task holds a block, and in each repeat every row takes the feature of the row some places further on, around the
    block's end, which permutes the feature over all rows.  The distance follows from block and repeat.
    Only rows whose feature changes by that are looked at again: a regression's margin moves by coefficient times
    difference, and a forest predicts the changed vectors.
    """
    scored = fitted.scored.select("label", (F.col("label") == F.col("prediction")).alias("right"), "slots", "slot_values", KEY_HASH)
    n = max(1, scored.count())
    blocks = max(1, -(-n // block_rows))
    placed = (
        scored.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), KEY_HASH), F.lit(blocks)))
        .repartition(min(blocks, partitions(scored.sparkSession)), "block")
        .sortWithinPartitions("block", KEY_HASH, "slots", "slot_values", "label")
        .select("block", "label", "right", "slots", "slot_values")
    )
    if isinstance(fitted.model, LogisticRegressionModel):
        change = _regression_changes(fitted.model.coefficients.toArray(), float(fitted.model.intercept), repeats)
        losses = placed.mapInArrow(change, "repeat int, slot bigint, lost bigint")
    else:
        changed = placed.mapInArrow(
            _changed_rows(fitted.n_features, repeats), "repeat int, slot bigint, label double, right boolean, own array<double>")
        # only the class is needed here, not scores and probabilities
        predictor = fitted.model.copy().setRawPredictionCol("").setProbabilityCol("")
        losses = predictor.transform(changed.withColumn("_features", array_to_vector("own"))).select(
            "repeat", "slot", (F.col("right").cast("bigint") - (F.col("label") == F.col("_prediction")).cast("bigint")).alias("lost"))
    found = losses.groupBy("slot", "repeat").agg(F.sum("lost").alias("lost"))
    # A repeat in which a feature changed no row has no row here and has lost nothing.
    share = F.col("lost") / F.lit(float(n))
    summed = found.groupBy("slot").agg(F.sum(share).alias("s"), F.sum(share * share).alias("q"))
    mean = F.coalesce("s", F.lit(0.0)) / F.lit(float(repeats))
    variance = F.coalesce("q", F.lit(0.0)) / F.lit(float(repeats)) - mean * mean
    return (
        fitted.features.join(summed, "slot", "left")
        .select("feature", mean.alias("importance_mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one block at a time; a block's rows come together but may run over several batches."""
    number, held = None, []
    for batch in batches:
        names = batch.column(0).to_pylist()
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(names)]):
            if names[start] != number and held:
                yield number, pa.Table.from_batches(held)
                held = []
            number = names[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield number, pa.Table.from_batches(held)


def _filled(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, slot, value)`` of all filled places of a block's vectors."""
    slots, values = block["slots"].combine_chunks(), block["slot_values"].combine_chunks()
    row = np.repeat(np.arange(len(block)), np.diff(slots.offsets.to_numpy()))
    return row, slots.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()


def _distance(block: int, repeat: int, size: int) -> int:
    return 1 + zlib.crc32(f"{SEED}|{repeat}|{block}".encode()) % (size - 1) if size > 1 else 0


def _regression_changes(weights: np.ndarray, intercept: float, repeats: int) -> Callable:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(weights))
        for number, block in _blocks(batches):
            size = len(block)
            row, slot, value = _filled(block)
            part = weights[slot] * value
            margin = intercept + np.bincount(row, part, minlength=size)
            positive = block["label"].to_numpy() == 1
            right = (margin > 0) == positive
            for repeat in range(repeats):
                # what each row has goes, and comes to the row that takes it
                taker = (row - _distance(number, repeat, size)) % size
                places, at = np.unique(np.concatenate([row, taker]) * width + np.concatenate([slot, slot]), return_inverse=True)
                move = np.bincount(at, np.concatenate([-part, part]))
                who, which = places // width, places % width
                lost = right[who].astype(np.int64) - ((margin[who] + move > 0) == positive[who])
                slots, at = np.unique(which, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slots), repeat, np.int32)), pa.array(slots),
                     pa.array(np.bincount(at, lost, minlength=len(slots)).astype(np.int64))], names=["repeat", "slot", "lost"])

    return fold


def _changed_rows(width: int, repeats: int) -> Callable:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            size = len(block)
            row, slot, value = _filled(block)
            own = np.zeros((size, width))
            own[row, slot] = value
            label, right = block["label"].to_numpy(), block["right"].to_numpy()
            for repeat in range(repeats):
                donor = (np.arange(size) + _distance(number, repeat, size)) % size
                for j in range(width):
                    who = np.flatnonzero(own[donor, j] != own[:, j])
                    if not len(who):
                        continue
                    changed = own[who]
                    changed[:, j] = own[donor[who], j]
                    offsets = pa.array(np.arange(len(who) + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), repeat, np.int32)), pa.array(np.full(len(who), j, np.int64)), pa.array(label[who]),
                         pa.array(right[who]), pa.ListArray.from_arrays(offsets, pa.array(changed.ravel()))],
                        names=["repeat", "slot", "label", "right", "own"])

    return fold
