"""Outcome audit: how well predictions serve each group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.functions.columns import as_text, clean, ref, require, rows_of, safe_div

Metric = Callable[[Column, Column, Column, Column], Column]


def _f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return safe_div(2 * tp, 2 * tp + fp + fn)


# Each metric is an expression over the four confusion counts of a group.
METRICS: dict[str, Metric] = {
    "accuracy": lambda tp, fp, fn, tn: safe_div(tp + tn, tp + fp + fn + tn),
    "precision": lambda tp, fp, fn, tn: safe_div(tp, tp + fp),
    "recall": lambda tp, fp, fn, tn: safe_div(tp, tp + fn),
    "f1": _f1,
    "selection_rate": lambda tp, fp, fn, tn: safe_div(tp + fp, tp + fp + fn + tn),
}
COUNTS = ("tp", "fp", "fn", "tn")


def confusion_counts(
    df: DataFrame, label: str, prediction: str, attributes: Sequence[str], positive=1
) -> DataFrame:
    """``(attribute, group, tp, fp, fn, tn, left_out)`` for all attributes in one aggregation.

    Rows without a label or a prediction are in none of the four counts; ``left_out`` is their number.
    """
    require(df, label, prediction, *attributes)
    frame = clean(df)
    types = {f.name: f.dataType for f in frame.schema.fields}
    truth = ref(label) == F.lit(positive)
    said = ref(prediction) == F.lit(positive)
    # unpivoting before the count keeps the shuffle to a few rows per attribute and task,
    # however many attributes there are
    long = frame.select(truth.alias("t"), said.alias("s"), rows_of([
        {"attribute": F.lit(a), "group": as_text(a, types[a])} for a in attributes
    ]))
    known = F.col("t").isNotNull() & F.col("s").isNotNull()
    t, s = F.when(known, F.col("t")), F.when(known, F.col("s"))
    return long.groupBy("attribute", "group").agg(
        F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"),
        F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"),
        F.count_if(t.isNull() | s.isNull()).alias("left_out"),
    )


def output_fairness(
    df: DataFrame, label: str, prediction: str, attributes: str | Sequence[str],
    metrics: dict[str, Metric] | None = None, positive=1,
) -> DataFrame:
    """Accuracy, precision, recall, F1 and selection rate per group.

    Undefined ratios are 0.  A missing attribute value is a group of its own.  Rows whose label or
    prediction is missing count only in ``left_out``.
    ``metrics`` maps further names to expressions of ``(tp, fp, fn, tn)``.
    """
    attributes = [attributes] if isinstance(attributes, str) else list(attributes)
    counts = confusion_counts(df, label, prediction, attributes, positive)
    cols = [F.col(c) for c in COUNTS]
    return counts.select(
        "attribute", "group", sum(cols[1:], cols[0]).alias("n"), *COUNTS, "left_out",
        *[m(*cols).alias(name) for name, m in (metrics or METRICS).items()],
    )


def _gap(values: Column) -> Column:
    return F.max(values) - F.min(values)


def parity_odds(by_group: DataFrame) -> DataFrame:
    """Demographic parity and equalised odds differences per attribute."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return by_group.groupBy("attribute").agg(
        _gap(safe_div(tp + fp, tp + fp + fn + tn)).alias("demographic_parity_difference"),
        F.greatest(_gap(safe_div(tp, tp + fn)), _gap(safe_div(fp, fp + tn)))
        .alias("equalized_odds_difference"),
    )


def disparities(by_group: DataFrame) -> DataFrame:
    """Long ``(attribute, metric, plain_name, statistic, value)``, largest first.

    Each metric has its spread over groups and its highest-to-lowest ratio (infinite
    when the lowest is 0); the two parity differences follow the same form.
    """
    named = [m for m in by_group.columns if m not in ("attribute", "group", "n", *COUNTS, "left_out")]
    spread = by_group.groupBy("attribute").agg(*[
        a for m in named for a in (F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min"))
    ])
    rows = []
    for m in named:
        high, low = F.col(f"{m}_max"), F.col(f"{m}_min")
        plain = F.lit(X.PLAIN_METRIC_NAMES.get(m, m))
        rows.append({"metric": F.lit(m), "plain_name": plain, "statistic": F.lit("difference"),
                     "value": high - low})
        rows.append({"metric": F.lit(m), "plain_name": plain, "statistic": F.lit("ratio"),
                     "value": F.when(low > 0, high / F.nullif(low, F.lit(0.0))).otherwise(float("inf"))})
    parity = parity_odds(by_group).select("attribute", rows_of([
        {"metric": F.lit("demographic_parity"), "plain_name": F.lit("Demographic Parity Difference"),
         "statistic": F.lit("difference"), "value": F.col("demographic_parity_difference")},
        {"metric": F.lit("equalized_odds"), "plain_name": F.lit("Equalized Odds Difference"),
         "statistic": F.lit("difference"), "value": F.col("equalized_odds_difference")},
    ]))
    return (
        spread.select("attribute", rows_of(rows)).unionByName(parity)
        .orderBy("attribute", F.abs("value").desc(), "metric", "statistic")
    )
