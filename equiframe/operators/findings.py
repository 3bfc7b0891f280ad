"""Findings: result tables turned into one table of readable messages.

Every function returns ``(section, feature, group, severity, message)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.functions.scale import materialise

COLUMNS = ("section", "feature", "group", "severity", "message")
SIGNIFICANT = 0.05
HIGH_MISSING = 0.3
GAP_LIMIT = 0.1


def _rows(
    df: DataFrame, section: str, message: Column, feature: Column | None = None,
    group: Column | None = None, severity: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(section).alias("section"),
        (none if feature is None else feature).cast("string").alias("feature"),
        (none if group is None else group).cast("string").alias("group"),
        (F.lit("info") if severity is None else severity).alias("severity"),
        message.alias("message"),
    )


def _percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def encoding_findings(plan: DataFrame) -> DataFrame:
    text = plan.filter(F.array_contains("steps", X.ONE_HOT) | F.array_contains("steps", X.LABEL))
    return _rows(text, "encoding", F.format_string(
        "%s holds distinct groups; encode it with %s before modelling.", "column",
        F.when(F.array_contains("steps", X.ONE_HOT), X.ONE_HOT).otherwise(X.LABEL)), F.col("column"))


def scaling_findings(plan: DataFrame) -> DataFrame:
    numbers = plan.filter(F.arrays_overlap("steps", F.array(F.lit(X.MIN_MAX), F.lit(X.LOG1P), F.lit(X.POWER))))
    return _rows(numbers, "scaling", F.format_string(
        "%s is a continuous measure; scale it so that its range does not dominate a model.", "column"),
        F.col("column"))


def missing_findings(plan: DataFrame) -> DataFrame:
    share = F.col("null_ratio")
    high = share > HIGH_MISSING
    advice = F.when(high, "too many to rely on it, consider removing the column").otherwise(
        "fill the gaps or leave the rows out")
    return _rows(
        plan.filter(share > 0), "missing",
        F.format_string("%s lacks %s of its values: %s.", "column", _percent(share), advice),
        F.col("column"), severity=F.when(high, "warning").otherwise("info"))


def group_missing_findings(rates: DataFrame, column: str) -> DataFrame:
    """One message per group, a warning where a group lacks more than the table does."""
    overall = rates.agg(F.sum(F.col("missing_rate") * F.col("rows")) / F.sum("rows")).scalar()
    more = F.col("missing_rate") > overall
    message = F.format_string(
        "%s lacks %s of its values in group %s%s.", F.lit(column), _percent(F.col("missing_rate")), "group",
        F.when(more, ", more than overall, so results for that group may be biased").otherwise(""))
    return _rows(rates, "group missing", message, F.lit(column), F.col("group"),
                 F.when(more, "warning").otherwise("info"))


def significance_findings(tests: DataFrame, moments: DataFrame) -> DataFrame:
    """Verdict of each chi-square or ANOVA row, with the groups of highest and lowest mean."""
    known = moments.filter(F.col("mean").isNotNull())
    ends = known.groupBy("feature").agg(
        F.max_by(F.struct("group", "mean"), F.struct("mean", "group")).alias("top"),
        F.min_by(F.struct("group", "mean"), F.struct("mean", "group")).alias("bottom"),
    )
    significant = F.col("p_value") < SIGNIFICANT
    spread = F.when(F.col("top").isNotNull(), F.format_string(
        " Group %s is highest (%.2f), group %s lowest (%.2f).",
        "top.group", "top.mean", "bottom.group", "bottom.mean")).otherwise("")
    p = F.coalesce(F.format_string("%.4f", "p_value"), F.lit("undefined"))
    message = F.when(significant, F.concat(
        F.format_string("%s: the groups differ significantly (%s, p = %s).", "feature", "test", p), spread,
    )).otherwise(F.format_string("%s: no significant difference between groups (%s, p = %s).",
                                 "feature", "test", p))
    return _rows(tests.join(ends, "feature", "left"), "test", message, F.col("feature"),
                 severity=F.when(significant, "warning").otherwise("info"))


def distribution_findings(ks: DataFrame) -> DataFrame:
    differing = ks.filter(F.col("p_value") < SIGNIFICANT)
    return _rows(differing, "distribution", F.format_string(
        "%s is distributed differently in groups %s and %s (p = %.3f).",
        "feature", "group1", "group2", "p_value"),
        F.col("feature"), F.concat_ws(" / ", "group1", "group2"), F.lit("warning"))


def outcome_findings(by_group: DataFrame, gaps: DataFrame, limit: float = GAP_LIMIT) -> DataFrame:
    """Best and worst served group per metric, and a warning for each gap over ``limit``."""
    named = [m for m in X.PLAIN_METRIC_NAMES if m in by_group.columns]
    long = by_group.select("attribute", "group", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in named
    ])))
    ends = long.groupBy("attribute", "metric").agg(
        F.max_by(F.struct("group", "score"), F.struct("score", "group")).alias("top"),
        F.min_by(F.struct("group", "score"), F.struct("score", "group")).alias("bottom"),
    )
    pair = F.concat_ws(" / ", "top.group", "bottom.group")
    values = ("top.group", "top.score", "bottom.group", "bottom.score")
    message = F.when(F.col("metric") == "selection_rate", F.format_string(
        "Group %s is selected at a rate of %.2f and group %s at %.2f: chances may be unequal.", *values,
    )).otherwise(F.format_string(
        "%s is %.2f in group %s but %.2f in group %s: the model serves the second less well.",
        "metric", "top.score", "top.group", "bottom.score", "bottom.group"))
    over = gaps.filter((F.col("statistic") == "difference") & (F.col("value") > limit))
    apart = F.when(F.col("top.score") - F.col("bottom.score") > limit, "warning").otherwise("info")
    return _rows(ends, "outcome", message, F.col("attribute"), pair, apart).unionByName(_rows(
        over, "outcome gap", F.format_string(
            "%s differs by %.2f between groups of %s, over the limit of %s.",
            "plain_name", "value", "attribute", F.lit(str(limit))),
        F.col("attribute"), severity=F.lit("warning")))


def importance_findings(importance: DataFrame, n: int = 10) -> DataFrame:
    top = importance.filter(F.col("importance_mean") > 0).orderBy(F.desc("importance_mean"), "feature").limit(n)
    return _rows(top, "importance", F.format_string(
        "%s drives predictions: shuffling it costs %.4f of accuracy.", "feature", "importance_mean"),
        F.col("feature"))


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overall_finding(findings: DataFrame, n_columns: int) -> DataFrame:
    """One summary row: columns audited and flagged, leading features, and the pair of groups
    that the most outcome warnings name."""
    flagged = findings.filter((F.col("severity") == "warning") & F.col("feature").isNotNull())
    by_feature = flagged.filter(F.col("section") != "outcome gap").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"))
    counted = by_feature.agg(
        F.count(F.lit(1)).alias("flagged"),
        F.max_by("feature", F.struct("n", "feature")).alias("first"),
    )
    first = counted.select("first").scalar()
    second = by_feature.filter(F.col("feature") != first).agg(
        F.max_by("feature", F.struct("n", "feature"))).scalar()
    pair = (
        flagged.filter(F.col("section") == "outcome").groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max_by("group", F.struct("n", "group"))).scalar()
    )
    return _rows(
        counted.withColumns({"second": second, "pair": pair}), "summary",
        F.concat(
            F.format_string("%s of %s columns show possible bias.", F.col("flagged"), F.lit(n_columns)),
            F.when(F.col("first").isNotNull(), F.concat(
                F.lit(" Look first at "), F.concat_ws(" and ", "first", "second"), F.lit("."))).otherwise(""),
            F.when(F.col("pair").isNotNull(), F.concat(
                F.lit(" Outcomes differ most often between "), F.col("pair"), F.lit("."))).otherwise(""),
        ),
        severity=F.when(F.col("flagged") > 0, "warning").otherwise("info"))


def with_summary(findings: DataFrame, n_columns: int) -> DataFrame:
    """Findings and their summary.  They are written once, as the summary reads them again."""
    findings = materialise(findings, "findings")
    return findings.unionByName(overall_finding(findings, n_columns))
