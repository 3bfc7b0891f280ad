"""Outcome audit and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.functions.columns import rows_of
from equiframe.operators import model
from equiframe.operators.outcome import disparities, output_fairness, parity_odds
from equiframe.plans.audit import fairness_audit, interactive_audit, long_audit, model_fairness
from workload.representation import DISTANCES, _audit_sql
from workload.views import PREDICTIONS, literal_rows, predictions, rounded

GROUP_SHARES = {"A": 0.5, "N": 0.3, "R": 0.2}
FEATURES = ["grp", "grp2", "l_quantity", "l_tax"]
KEY = ["l_orderkey", "l_linenumber"]


def _by_group(s, d, attributes="grp"):
    return output_fairness(predictions(s, d), "label", "prediction", attributes)


def _fit(s, d):
    """A target that quantity alone decides, so a model has to learn it."""
    frame = predictions(s, d).withColumn("target", F.when(F.col("l_quantity") > 25, "yes").otherwise("no"))
    return model.train_baseline(frame, "target", FEATURES, KEY)


def _report(report):
    """Supports as they are; scores as 1 where they reach 0.9."""
    return report.select(F.lit("report").alias("section"), F.col("class").alias("item"), rows_of([
        {"metric": F.lit("support"), "value": F.col("support").cast("double")},
        *[{"metric": F.lit(f"{m} >= 0.9"), "value": (F.col(m) >= 0.9).cast("double")} for m in ("precision", "recall", "f1")]]))


def _scores(s, d):
    """Test rows and their mean label, and whether the probabilities stand on the right side."""
    return _fit(s, d).scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("label") == F.col("prediction")).cast("double")) >= 0.9).alias("learned"),
        ((F.avg("probability_1") > 0.5) == (F.col("label") == 1)).alias("right_side"))


def _forest(s, d):
    """Three bands of quantity, which a forest of default size has to tell apart."""
    frame = predictions(s, d).withColumn("band", F.floor((F.col("l_quantity") - 1) / 17).cast("int"))
    fitted = model.train_baseline(frame, "band", ["grp", "l_quantity", "l_tax"], KEY)
    return _report(model.classification_report(fitted.scored))


def _importance(s, d):
    return model.permutation_importance(_fit(s, d)).select(
        "feature", (F.col("importance_mean") > 0.2).alias("important"), (F.abs("importance_mean") < 0.02).alias("idle"))


def _model_fairness(s, d):
    """All five results: counts as they are, scores as 1 where they lie where they have to."""
    _, found = model_fairness(predictions(s, d), "prediction", ["grp", "grp2"], FEATURES, KEY)
    by_group = F.concat_ws(":", "attribute", F.coalesce("group", F.lit("(missing)")))
    scores = ("accuracy", "precision", "recall", "f1")
    difference = F.col("statistic") == "difference"
    return (
        _report(found["report"])
        .unionByName(found["importance"].filter("importance_mean > 0.2").select(
            F.lit("importance").alias("section"), F.col("feature").alias("item"), F.lit("over 0.2").alias("metric"), F.lit(1.0).alias("value")))
        .unionByName(found["output_fairness"].select(F.lit("output_fairness").alias("section"), by_group.alias("item"), rows_of([
            {"metric": F.lit("n"), "value": F.col("n").cast("double")},
            *[{"metric": F.lit(f"{m} >= 0.85"), "value": (F.col(m) >= 0.85).cast("double")} for m in scores]])))
        .unionByName(found["disparities"].select(
            F.lit("disparities").alias("section"), F.concat_ws(":", "attribute", "metric").alias("item"), F.col("statistic").alias("metric"),
            F.when(difference, F.col("value").between(0, 1)).otherwise(F.col("value") >= 1).cast("double").alias("value")))
        .unionByName(found["auc"].select(F.lit("auc").alias("section"), F.lit("all").alias("item"), rows_of([
            {"metric": F.lit("auc >= 0.95"), "value": (F.col("auc") >= 0.95).cast("double")},
            {"metric": F.lit("positives"), "value": F.col("positives").cast("double")},
            {"metric": F.lit("negatives"), "value": F.col("negatives").cast("double")}])))
    )


def _interactive(s, d):
    """Both results: the numbers of the audit and its summary, and the verdict on each group."""
    audit = interactive_audit(predictions(s, d), "grp", '{"A": 0.5, "N": 0.3, "R": 0.2}')
    verdict = audit["input_fairness"].select(
        F.lit("input_fairness").alias("section"), F.col("group").alias("item"), F.lit("fair").alias("metric"),
        (F.col("fair") == "Fair").cast("double").alias("value"))
    return rounded(long_audit(audit).unionByName(verdict))


def _double_predictions(s, d):
    """The class as a double, as models predict it."""
    return predictions(s, d).withColumn("prediction", F.col("prediction").cast("double"))


def _gappy(s, d):
    """Labels missing where the tax is highest."""
    return predictions(s, d).withColumn("label", F.when(F.col("l_tax") < 0.08, F.col("label")))


def _odd_predictions(s, d):
    """Predictions as doubles, some missing, some beyond a long, some no class."""
    line = F.col("l_linenumber")
    return predictions(s, d).withColumn("prediction", F.when(line == 7, float("nan")).when(line == 6, 1e300).when(
        line == 5, 0.5).otherwise(F.col("prediction").cast("double")))


QUERIES = {
    "output_fairness": lambda s, d: rounded(_by_group(s, d)),
    "output_fairness_attributes": lambda s, d: rounded(_by_group(s, d, ["grp", "grp2"])),
    "disparities": lambda s, d: rounded(disparities(_by_group(s, d, ["grp", "grp2"]))),
    "parity_odds": lambda s, d: rounded(parity_odds(_by_group(s, d, ["grp", "grp2"]))),
    "fairness_audit": lambda s, d: rounded(long_audit(fairness_audit(
        predictions(s, d), "grp", "label", "prediction", GROUP_SHARES))),
    "interactive_audit": _interactive,
    "classification_report_double": lambda s, d: rounded(model.classification_report(_double_predictions(s, d))),
    "output_fairness_missing": lambda s, d: rounded(output_fairness(_gappy(s, d), "label", "prediction", "grp")),
    "roc_auc_missing": lambda s, d: rounded(model.roc_auc(_gappy(s, d), "label", "l_quantity")),
    "confusion_matrix": lambda s, d: model.confusion_matrix(predictions(s, d)),
    "confusion_matrix_odd_numbers": lambda s, d: model.confusion_matrix(_odd_predictions(s, d)),
    "classification_report": lambda s, d: rounded(model.classification_report(predictions(s, d))),
    "roc_curve": lambda s, d: rounded(model.roc_curve(predictions(s, d), "label", "l_quantity")),
    "roc_auc": lambda s, d: rounded(model.roc_auc(predictions(s, d), "label", "l_quantity")),
    "train_baseline": _scores,
    "train_forest": _forest,
    "permutation_importance": _importance,
    "model_fairness": _model_fairness,
}


def _metrics_sql(attributes: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {a} AS grp, label, prediction FROM v" for a in attributes)
    return f"""v AS ({PREDICTIONS}), long AS ({parts}),
    m AS (SELECT attribute, grp, count(*) FILTER (label IS NOT NULL AND prediction IS NOT NULL) AS n, count(*) AS n_all,
            count(*) FILTER (label = 1 AND prediction = 1) AS tp,
            count(*) FILTER (label = 0 AND prediction = 1) AS fp,
            count(*) FILTER (label = 1 AND prediction = 0) AS fn,
            count(*) FILTER (label = 0 AND prediction = 0) AS tn
          FROM long GROUP BY 1, 2),
    metrics AS (SELECT *, (tp + tn) / CAST(n AS DOUBLE) AS accuracy,
            coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision,
            coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
            coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1,
            (tp + fp) / CAST(n AS DOUBLE) AS selection_rate,
            coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0) AS fpr
          FROM m)"""


_PER_GROUP = """SELECT attribute, grp AS "group", n, tp, fp, fn, tn, CAST(n_all - n AS BIGINT) AS left_out, round(accuracy, 6) AS accuracy,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    round(selection_rate, 6) AS selection_rate FROM metrics"""
_GAPS = " UNION ALL ".join(
    f"""SELECT attribute, '{m}' AS metric, '{p}' AS plain_name, 'difference' AS statistic,
        max({m}) - min({m}) AS value FROM metrics GROUP BY 1
        UNION ALL SELECT attribute, '{m}', '{p}', 'ratio',
        CASE WHEN min({m}) > 0 THEN max({m}) / min({m}) ELSE CAST('Infinity' AS DOUBLE) END
        FROM metrics GROUP BY 1"""
    for m, p in X.PLAIN_METRIC_NAMES.items()
) + """ UNION ALL SELECT attribute, 'demographic_parity', 'Demographic Parity Difference', 'difference',
        max(selection_rate) - min(selection_rate) FROM metrics GROUP BY 1
        UNION ALL SELECT attribute, 'equalized_odds', 'Equalized Odds Difference', 'difference',
        greatest(max(recall) - min(recall), max(fpr) - min(fpr)) FROM metrics GROUP BY 1"""
_AUDIT = _audit_sql("SELECT grp FROM v", "grp", literal_rows(GROUP_SHARES))

ORACLES = {
    "confusion_matrix_odd_numbers": f"""SELECT CAST(label AS VARCHAR) AS label, CASE l_linenumber WHEN 6 THEN '1.0E300' WHEN 5 THEN '0.5'
            ELSE CAST(prediction AS VARCHAR) END AS prediction, count(*) AS n
        FROM ({PREDICTIONS}) WHERE l_linenumber <> 7 GROUP BY 1, 2""",
    "output_fairness": f"WITH {_metrics_sql(['grp'])} {_PER_GROUP}",
    "output_fairness_attributes": f"WITH {_metrics_sql(['grp', 'grp2'])} {_PER_GROUP}",
    "disparities": f"""WITH {_metrics_sql(['grp', 'grp2'])}
        SELECT attribute, metric, plain_name, statistic, round(value, 6) AS value FROM ({_GAPS})""",
    "parity_odds": f"""WITH {_metrics_sql(['grp', 'grp2'])}
        SELECT attribute, round(max(selection_rate) - min(selection_rate), 6) AS demographic_parity_difference,
               round(greatest(max(recall) - min(recall), max(fpr) - min(fpr)), 6) AS equalized_odds_difference
        FROM metrics GROUP BY 1""",
    "fairness_audit": f"""WITH {_metrics_sql(['grp'])}, {_AUDIT}, {DISTANCES},
        totals AS (SELECT count(*) AS t, count(*) FILTER (r BETWEEN 0.8 AND 1.25) AS f FROM audit),
        everything AS (
        SELECT 'input_fairness' AS section, grp AS item, 'observed_share' AS metric, o AS value FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'expected_share', e FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'disparity_ratio', r FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'abs_difference', a FROM audit
        UNION ALL SELECT 'summary', 'all', 'total_groups', t FROM totals
        UNION ALL SELECT 'summary', 'all', 'unfair_groups', t - f FROM totals
        UNION ALL SELECT 'summary', 'all', 'fairness_rate', f / CAST(t AS DOUBLE) FROM totals
        UNION ALL SELECT 'summary', 'all', 'kl_divergence', kl FROM named
        UNION ALL SELECT 'summary', 'all', 'wasserstein_distance', w FROM named
        UNION ALL SELECT 'summary', 'all', 'total_variation', tv FROM named
        UNION ALL SELECT 'output_fairness', grp, 'accuracy', accuracy FROM metrics
        UNION ALL SELECT 'output_fairness', grp, 'precision', precision FROM metrics
        UNION ALL SELECT 'output_fairness', grp, 'recall', recall FROM metrics
        UNION ALL SELECT 'output_fairness', grp, 'f1', f1 FROM metrics
        UNION ALL SELECT 'output_fairness', grp, 'selection_rate', selection_rate FROM metrics
        UNION ALL SELECT 'disparities', statistic, metric, value FROM ({_GAPS}))
        SELECT section, item, metric, round(CAST(value AS DOUBLE), 6) AS value FROM everything""",
    "interactive_audit": f"""WITH v AS ({PREDICTIONS}), {_AUDIT}, {DISTANCES},
        totals AS (SELECT count(*) AS t, count(*) FILTER (r BETWEEN 0.8 AND 1.25) AS f FROM audit),
        everything AS (
        SELECT 'input_fairness' AS section, grp AS item, 'observed_share' AS metric, o AS value FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'expected_share', e FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'disparity_ratio', r FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'abs_difference', a FROM audit
        UNION ALL SELECT 'input_fairness', grp, 'fair', CAST(r BETWEEN 0.8 AND 1.25 AS INT) FROM audit
        UNION ALL SELECT 'summary', 'all', 'total_groups', t FROM totals
        UNION ALL SELECT 'summary', 'all', 'unfair_groups', t - f FROM totals
        UNION ALL SELECT 'summary', 'all', 'fairness_rate', f / CAST(t AS DOUBLE) FROM totals
        UNION ALL SELECT 'summary', 'all', 'kl_divergence', kl FROM named
        UNION ALL SELECT 'summary', 'all', 'wasserstein_distance', w FROM named
        UNION ALL SELECT 'summary', 'all', 'total_variation', tv FROM named)
        SELECT section, item, metric, round(CAST(value AS DOUBLE), 6) AS value FROM everything""",
    "confusion_matrix": f"""SELECT CAST(label AS VARCHAR) AS label, CAST(prediction AS VARCHAR) AS prediction,
        count(*) AS n FROM ({PREDICTIONS}) GROUP BY 1, 2""",
    "classification_report": f"""WITH v AS ({PREDICTIONS}),
        c AS (SELECT k, count(*) FILTER (label = k AND prediction = k) AS tp,
                     count(*) FILTER (label = k) AS support, count(*) FILTER (prediction = k) AS predicted
              FROM v, (VALUES (0), (1)) AS classes(k) GROUP BY k),
        s AS (SELECT CAST(k AS VARCHAR) AS class, tp, support, tp / CAST(predicted AS DOUBLE) AS precision,
                     tp / CAST(support AS DOUBLE) AS recall,
                     2 * tp / CAST(support + predicted AS DOUBLE) AS f1 FROM c),
        a AS (SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS v, sum(support) AS support FROM s),
        everything AS (
        SELECT class, precision, recall, f1, support FROM s
        UNION ALL SELECT 'accuracy', v, v, v, support FROM a
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
            sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM everything""",
    "roc_curve": f"""WITH c AS (
            SELECT l_quantity AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
            FROM ({PREDICTIONS}) GROUP BY 1),
        r AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM c)
        SELECT s AS threshold, round(cn / CAST((SELECT sum(n) FROM c) AS DOUBLE), 6) AS fpr,
               round(cp / CAST((SELECT sum(p) FROM c) AS DOUBLE), 6) AS tpr FROM r
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0, 0""",
    "roc_auc": f"""WITH c AS (
            SELECT l_quantity AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
            FROM ({PREDICTIONS}) GROUP BY 1),
        r AS (SELECT p, n, sum(n) OVER (ORDER BY s) AS cn FROM c)
        SELECT round(sum(p * (cn - n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc,
               CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM r""",
}
_GAPPY = f"SELECT * REPLACE (CASE WHEN l_tax < 0.08 THEN label END AS label) FROM ({PREDICTIONS})"
ORACLES |= {
    "classification_report_double": ORACLES["classification_report"],
    "output_fairness_missing": ORACLES["output_fairness"].replace(PREDICTIONS, _GAPPY),
    "roc_auc_missing": ORACLES["roc_auc"].replace(PREDICTIONS, _GAPPY),
}

# The rows that are held out of training: the first eight hex digits of a digest of the key, modulo 1,000.
_TEST = f"""SELECT * FROM ({PREDICTIONS}) WHERE CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT)
    % 1000 < 200"""


def _report_sql(label: str) -> str:
    names = f"SELECT CAST({label} AS VARCHAR) AS item, count(*) AS n FROM t GROUP BY 1"
    every = " UNION ALL ".join(f"SELECT '{x}', (SELECT count(*) FROM t)" for x in ("accuracy", "macro avg", "weighted avg"))
    flags = " UNION ALL ".join(f"SELECT 'report', item, '{m} >= 0.9', 1.0 FROM c" for m in ("precision", "recall", "f1"))
    return f"""c AS ({names} UNION ALL {every}),
        report AS (SELECT 'report' AS section, item, 'support' AS metric, CAST(n AS DOUBLE) AS value FROM c UNION ALL {flags})"""


ORACLES |= {
    "train_baseline": f"""SELECT CAST(l_quantity > 25 AS DOUBLE) AS label, count(*) AS n, true AS learned, true AS right_side
        FROM ({_TEST}) GROUP BY 1""",
    "train_forest": f"""WITH t AS (SELECT CAST(floor((l_quantity - 1) / 17) AS INT) AS band FROM ({_TEST})), {_report_sql('band')}
        SELECT * FROM report""",
    "permutation_importance": """SELECT * FROM (VALUES ('grp_N', false, true), ('grp_R', false, true), ('grp2_O', false, true),
        ('l_quantity', true, false), ('l_tax', false, true)) v(feature, important, idle)""",
    "model_fairness": f"""WITH t AS ({_TEST}), {_report_sql('prediction')},
        g AS (SELECT 'grp:' || grp AS item, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT 'grp2:' || grp2, count(*) FROM t GROUP BY 1),
        d AS (SELECT a || ':' || m AS item, s AS metric FROM (VALUES ('grp'), ('grp2')) x(a), (VALUES
            {", ".join(f"('{m}', '{k}')" for m in X.PLAIN_METRIC_NAMES for k in ("difference", "ratio"))},
            ('demographic_parity', 'difference'), ('equalized_odds', 'difference')) y(m, s))
        SELECT * FROM report
        UNION ALL SELECT 'importance', 'l_quantity', 'over 0.2', 1.0
        UNION ALL SELECT 'output_fairness', item, 'n', CAST(n AS DOUBLE) FROM g
        UNION ALL SELECT 'output_fairness', item, m || ' >= 0.85', 1.0 FROM g, (VALUES ('accuracy'), ('precision'), ('recall'), ('f1')) z(m)
        UNION ALL SELECT 'disparities', item, metric, 1.0 FROM d
        UNION ALL SELECT 'auc', 'all', 'auc >= 0.95', 1.0
        UNION ALL SELECT 'auc', 'all', 'positives', CAST(count(*) FILTER (prediction = 1) AS DOUBLE) FROM t
        UNION ALL SELECT 'auc', 'all', 'negatives', CAST(count(*) FILTER (prediction = 0) AS DOUBLE) FROM t""",
}
