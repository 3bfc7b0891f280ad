"""Whole audits: several operators over one table, each result a frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiframe.functions.columns import clean, is_numeric, require, rows_of
from equiframe.functions.scale import evaluated
from equiframe.functions.scan import Scan
from equiframe.operators import findings as say
from equiframe.operators.charts import distributions
from equiframe.operators.model import (
    Baseline, classification_report, permutation_importance, roc_auc, train_baseline,
)
from equiframe.operators.outcome import COUNTS, disparities, output_fairness
from equiframe.operators.prepare import recommend
from equiframe.operators.profile import distinct_counts, profile_of
from equiframe.operators.representation import fairness_summary, input_fairness
from equiframe.operators.significance import anova, chi_square, group_moments
from equiframe.sources.benchmark import benchmark_from_json

CATEGORICAL_UP_TO = 10
TOP_IMPORTANCE = 10


def fairness_audit(
    df: DataFrame, group_col: str, label: str | None = None, prediction: str | None = None,
    benchmark=None,
) -> dict[str, DataFrame]:
    """Representation audit, and outcome audit when predictions are given."""
    result = evaluated(input_fairness(df, group_col, benchmark), "audit").orderBy(F.desc("observed_share"), "group")
    out = {"input_fairness": result, "summary": fairness_summary(result)}
    if label is not None and prediction is not None:
        by_group = evaluated(output_fairness(df, label, prediction, group_col), "outcome")
        out["output_fairness"] = by_group
        out["disparities"] = disparities(by_group)
    return out


def interactive_audit(
    df: DataFrame, group_col: str, benchmark_text: str | None = None
) -> dict[str, DataFrame]:
    """Audit against a benchmark typed as JSON, or the observed shares without one."""
    return fairness_audit(df, group_col, benchmark=benchmark_from_json(df, group_col, benchmark_text))


def long_audit(audit: dict[str, DataFrame]) -> DataFrame:
    """The numbers of an audit as one table ``(section, item, metric, value)``."""
    def numbers(frame: DataFrame, section: str, item, metrics: Sequence[str]) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), item.alias("item"), rows_of([
            {"metric": F.lit(m), "value": F.col(m).cast("double")} for m in metrics
        ]))

    group = F.coalesce(F.col("group"), F.lit("(missing)"))
    parts = [
        numbers(audit["input_fairness"], "input_fairness", group,
                ("observed_share", "expected_share", "disparity_ratio", "abs_difference")),
        numbers(audit["summary"], "summary", F.lit("all"),
                ("total_groups", "unfair_groups", "fairness_rate", "kl_divergence",
                 "wasserstein_distance", "total_variation")),
    ]
    if "output_fairness" in audit:
        metrics = [m for m in audit["output_fairness"].columns
                   if m not in ("attribute", "group", "n", *COUNTS, "left_out")]
        parts.append(numbers(audit["output_fairness"], "output_fairness", group, metrics))
        parts.append(audit["disparities"].select(
            F.lit("disparities").alias("section"), F.col("statistic").alias("item"), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def model_fairness(
    df: DataFrame, target: str, attributes: Sequence[str], features: Sequence[str] | None = None,
    key: Sequence[str] | None = None, repeats: int = 10, **options,
) -> tuple[Baseline, dict[str, DataFrame]]:
    """Train a baseline, then audit its test predictions for every attribute at once."""
    fitted = train_baseline(df, target, features, key, **options)
    by_group = evaluated(output_fairness(fitted.scored, "label", "prediction", list(attributes)), "outcome")
    out = {
        "report": classification_report(fitted.scored),
        "importance": permutation_importance(fitted, repeats).limit(TOP_IMPORTANCE),
        "output_fairness": by_group,
        "disparities": disparities(by_group),
    }
    if len(fitted.classes) == 2:
        out["auc"] = roc_auc(fitted.scored, "label", "probability_1")
    return fitted, out


def report_findings(
    df: DataFrame, audit_cols: Sequence[str], group_col: str = "race", scan: Scan | None = None,
) -> DataFrame:
    """One statistical finding per audited column.

    Columns with up to ten values get a chi-square test, other numbers ANOVA.  Distinct values (which a ``scan`` of
    the same table may have counted), group moments and chi-square cells are a pass each, for all columns.
    """
    require(df, group_col, *audit_cols)
    df = clean(df)
    if scan is None:
        counted = {r["column"]: r["n_unique"] for r in distinct_counts(df, audit_cols).collect()}
    else:
        counted = scan.sizes
    few = [c for c in audit_cols if counted.get(c, 0) <= CATEGORICAL_UP_TO]
    many = [c for c in audit_cols if c not in few and is_numeric(df, c)]
    columns = ("feature", "test", "stat", "p_value")
    untested = [
        ("test", c, None, "warning", f"{c}: text with over {CATEGORICAL_UP_TO} values has no group test.")
        for c in audit_cols if c not in few and c not in many
    ]
    out = df.sparkSession.createDataFrame(untested, ", ".join(f"`{c}` string" for c in say.COLUMNS))
    if not few and not many:
        return out
    moments = evaluated(group_moments(df, few + many, group_col), "moments")
    tests = []
    if few:
        tests.append(chi_square(df, few, group_col).select(*columns))
    if many:
        tests.append(anova(df, many, group_col, moments).select(*columns))
    found = say.significance_findings(evaluated(reduce(DataFrame.unionByName, tests), "tests"), moments)
    return found.unionByName(out) if untested else found


def audit_report(
    df: DataFrame, audit_cols: Sequence[str], group_col: str = "race", plan: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Recommendations, one statistical finding per audited column, and distributions, all from one scan."""
    numbers = [c for c in df.columns if is_numeric(df, c)]
    listed = df.columns if plan is None else audit_cols
    scan = Scan(df, [c for c in numbers if c in listed], listed, [c for c in numbers if c in audit_cols])
    plan = recommend(df, profile_of(scan)) if plan is None else plan
    return {
        "recommendations": plan.select("column", "recommendation"),
        "findings": report_findings(df, audit_cols, group_col, scan),
        "distributions": distributions(df, audit_cols, scan),
    }


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each frame of a report under ``path`` as Parquet or JSON."""
    if fmt not in ("parquet", "json"):
        raise ValueError("a report is written as parquet or json")
    for name, frame in report.items():
        frame.write.format(fmt).save(f"{path}/{name}")
