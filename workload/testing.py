"""Statistical test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.functions.columns import rows_of
from equiframe.functions.scale import shared_path
from equiframe.operators import findings as say
from equiframe.operators.outcome import disparities, output_fairness
from equiframe.operators.prepare import recommend
from equiframe.operators.profile import groupwise_missing
from equiframe.operators.significance import anova, chi_square, group_moments, ks_pairs, standardized_difference
from equiframe.plans.audit import audit_report, report_findings, write_report
from workload import outcome, preparation, profiling, visual
from workload.views import LABELLED, PREDICTIONS, labelled, ladder_sql, predictions, rounded, table


def _chi_two_dof(s, d):
    # three return flags against two-valued columns: two degrees of freedom
    return chi_square(predictions(s, d), ["grp2", "label", "prediction"], "grp")


def _losses(frame):
    """Accuracy lost when the rule behind the predictions may not use a column: one threshold for all groups, or no quantity."""
    def right(prediction):
        return F.avg((F.col("label") == prediction).cast("double"))

    base = right(F.col("prediction"))
    spread = F.lit(0.0)
    return frame.agg(
        (base - right((F.col("l_quantity") > 25).cast("int"))).alias("grp"), (base - right(F.lit(0))).alias("l_quantity"),
        (base - right(F.lit(1))).alias("l_quantity_high")).select(rows_of([
            {"feature": F.lit(c), "importance_mean": F.col(c), "importance_std": spread}
            for c in ("grp", "l_quantity", "l_quantity_high")]))


def _findings(s, d):
    frame, docs = predictions(s, d), labelled(s, d)
    plan = recommend(docs)
    by_group = output_fairness(frame, "label", "prediction", "grp")
    said = say.combine(
        say.encoding_findings(plan), say.scaling_findings(plan), say.missing_findings(plan),
        say.group_missing_findings(groupwise_missing(docs, "quality", "lang"), "quality"),
        say.significance_findings(
            chi_square(frame, ["label", "prediction"], "grp").select("feature", "test", "p_value"),
            group_moments(frame, ["label", "prediction"], "grp")),
        say.significance_findings(
            anova(frame, ["l_quantity"], "grp").select("feature", "test", "p_value"),
            group_moments(frame, ["l_quantity"], "grp")),
        say.distribution_findings(ks_pairs(frame, "l_tax", "grp")),
        say.outcome_findings(by_group, disparities(by_group)),
        say.importance_findings(_losses(frame)),
    )
    return say.with_summary(said, len(docs.columns) + len(frame.columns))


def _halves(s, d):
    """Suppliers in four groups of about equal size, by key."""
    return table(s, d, "supplier").select("s_acctbal", (F.col("s_suppkey") % 4).alias("half"))


def _audited(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")


def _written_report(s, d):
    """A report written to the shared folder and read back, all rows of its sections in one form."""
    report = audit_report(_audited(s, d), AUDITED, "l_returnflag")
    path = shared_path(s, "report")
    write_report(report, path)
    read = {name: s.read.parquet(f"{path}/{name}") for name in report}
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return rounded(
        read["recommendations"].select(
            F.lit("recommendations").alias("section"), F.col("column").alias("item"), no_text.alias("statistic"),
            no_text.alias("place"), F.col("recommendation").alias("text"), no_number.alias("value"))
        .unionByName(read["findings"].select(
            F.lit("findings").alias("section"), F.col("feature").alias("item"), F.col("severity").alias("statistic"),
            F.col("group").alias("place"), F.col("message").alias("text"), no_number.alias("value")))
        .unionByName(read["distributions"].select(
            F.lit("distributions").alias("section"), F.col("attribute").alias("item"), "statistic",
            F.col("group").alias("place"), F.col("category").alias("text"), "value")))


AUDITED = ["l_linestatus", "l_tax", "l_discount", "l_quantity"]


QUERIES = {
    "standardized_difference": lambda s, d: rounded(
        standardized_difference(table(s, d, "orders"), "o_totalprice", "o_orderpriority")
        .withColumns({c: F.col(c) / 1000 for c in ("mean1", "mean2", "pooled_sd")})),
    "chi_square": lambda s, d: rounded(_chi_two_dof(s, d)),
    "chi_square_corrected": lambda s, d: rounded(
        chi_square(predictions(s, d), ["label", "prediction"], "grp2").drop("p_value")),
    "chi_square_many_cells": lambda s, d: rounded(
        chi_square(table(s, d, "part"), "p_size", "p_brand")),
    "anova": lambda s, d: rounded(anova(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")),
    "anova_many_groups": lambda s, d: rounded(
        anova(table(s, d, "orders"), "o_totalprice", "o_orderpriority")),
    "group_moments": lambda s, d: rounded(group_moments(
        table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")),
    "ks_pairs": lambda s, d: rounded(ks_pairs(table(s, d, "lineitem"), "l_quantity", "l_returnflag").drop("p_value")),
    "ks_pairs_large_integers": lambda s, d: rounded(ks_pairs(
        table(s, d, "orders").select((F.col("o_orderkey") + (1 << 53)).alias("v"), "o_orderstatus"), "v", "o_orderstatus")),
    "ks_pairs_continuous": lambda s, d: rounded(
        ks_pairs(table(s, d, "orders"), "o_totalprice", "o_orderpriority").drop("p_value")),
    "p_values": lambda s, d: rounded(
        ks_pairs(table(s, d, "orders"), "o_totalprice", "o_orderpriority")
        .select("feature", "test", "group1", "group2", "p_value")
        .unionByName(
            anova(table(s, d, "orders"), "o_totalprice", "o_orderpriority").select("feature", "test", "p_value"),
            allowMissingColumns=True)
        .unionByName(
            chi_square(table(s, d, "part"), "p_size", "p_brand").select("feature", "test", "p_value"),
            allowMissingColumns=True)),
    "findings": _findings,
    "report_findings": lambda s, d: report_findings(_audited(s, d), AUDITED, "l_returnflag"),
    "ks_p_values": lambda s, d: rounded(
        ks_pairs(table(s, d, "lineitem"), "l_quantity", "l_returnflag").select("group1", "group2", "p_value")),
    "ks_p_values_equal_sizes": lambda s, d: rounded(ks_pairs(_halves(s, d), "s_acctbal", "half")),
    "audit_report": _written_report,
}


def _chi_sql(source: str, columns: list[str], group: str, corrected: bool, p_value: bool, places: int = 6) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS r, CAST({group} AS VARCHAR) AS c FROM src" for c in columns)
    gap = "greatest(abs(o - e) - 0.5, 0)" if corrected else "(o - e)"
    # for an even number of degrees of freedom the tail is a finite Poisson sum
    tail = f""", round((SELECT sum(exp(i * ln(stat / 2) - stat / 2 - lgamma(i + 1)))
            FROM range(0, 2000) t(i) WHERE i < dof // 2), {places}) AS p_value""" if p_value else ""
    return f"""WITH src AS ({source}), long AS ({long}),
        o AS (SELECT feature, r, c, count(*) AS o FROM long WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2, 3),
        rt AS (SELECT feature, r, sum(o) AS t FROM o GROUP BY 1, 2),
        ct AS (SELECT feature, c, sum(o) AS t FROM o GROUP BY 1, 2),
        n AS (SELECT feature, sum(o) AS n FROM o GROUP BY 1),
        cells AS (SELECT rt.feature, coalesce(o.o, 0) AS o, CAST(rt.t AS DOUBLE) * ct.t / n.n AS e
            FROM rt JOIN ct ON rt.feature = ct.feature JOIN n ON n.feature = rt.feature
            LEFT JOIN o ON o.feature = rt.feature AND o.r = rt.r AND o.c = ct.c),
        sums AS (SELECT feature, sum({gap} * {gap} / e) AS stat FROM cells GROUP BY 1),
        stats AS (SELECT *, ((SELECT count(*) FROM rt WHERE rt.feature = sums.feature) - 1)
            * ((SELECT count(*) FROM ct WHERE ct.feature = sums.feature) - 1) AS dof FROM sums)
        SELECT s.feature, 'chi-square' AS test, round(stat, 6) AS stat, dof{tail}, CAST(n.n AS BIGINT) AS n
        FROM stats s JOIN n ON n.feature = s.feature"""


def _anova_sql(source: str, columns: list[str], group: str, p_value: bool, places: int = 6) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {group} AS g, CAST({c} AS DOUBLE) AS x FROM {source}" for c in columns)
    # with df1 = 2 and df1 = 4 the tail of F has a closed form
    tail = f""", round(CASE df1 WHEN 2 THEN pow(1 + 2 * stat / df2, -df2 / 2.0)
        WHEN 4 THEN pow(df2 / (df2 + 4 * stat), df2 / 2.0)
            * (1 + df2 / 2.0 * (4 * stat / (df2 + 4 * stat))) END, {places}) AS p_value""" if p_value else ""
    return f"""WITH long AS ({long}),
        g AS (SELECT feature, g, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM long GROUP BY 1, 2),
        c AS (SELECT feature, avg(x) AS centre FROM long GROUP BY 1),
        f AS (SELECT g.feature, (sum(n * pow(m - centre, 2)) / (count(*) - 1))
                / (sum((n - 1) * v) / (sum(n) - count(*))) AS stat,
                count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2
              FROM g JOIN c ON g.feature = c.feature GROUP BY 1)
        SELECT feature, 'anova' AS test, round(stat, 6) AS stat, df1, df2{tail} FROM f"""


def _ks_sql(source: str, value: str, group: str, places: int = 6) -> str:
    return f"""WITH c AS (SELECT CAST({group} AS VARCHAR) AS g, {value} AS v, count(*) AS n FROM {source} GROUP BY 1, 2),
        t AS (SELECT g, sum(n) AS n FROM c GROUP BY 1),
        p AS (SELECT a.g AS g1, b.g AS g2, a.n AS n1, b.n AS n2 FROM t a JOIN t b ON a.g < b.g),
        e AS (SELECT p.*, c.v, CASE WHEN c.g = g1 THEN c.n ELSE 0 END AS x1, CASE WHEN c.g = g2 THEN c.n ELSE 0 END AS x2
              FROM p JOIN c ON c.g = g1 OR c.g = g2),
        r AS (SELECT g1, g2, n1, n2, sum(x1) OVER w AS c1, sum(x2) OVER w AS c2 FROM e
              WINDOW w AS (PARTITION BY g1, g2 ORDER BY v))
        SELECT '{value}' AS feature, 'ks' AS test, g1 AS group1, g2 AS group2,
               CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
               round(max(abs(c1 / CAST(n1 AS DOUBLE) - c2 / CAST(n2 AS DOUBLE))), {places}) AS stat
        FROM r GROUP BY 3, 4, 5, 6"""


def _ks_p_sql(source: str, value: str, group: str) -> str:
    """Exact up to 10,000 rows in the smaller group: the chance that a path stays in the band is carried from step to step.

    Beyond that, the reflected sum for equal sizes and the corrected series for others.
    """
    return f"""WITH RECURSIVE d AS (SELECT *, round(stat * n1 * n2) AS limit_ FROM (
            {_ks_sql(source, value, group, places=15)}) t(feature, test, group1, group2, n1, n2, stat)),
        walk AS (
            SELECT group1, group2, n1, n2, limit_, CAST(0 AS BIGINT) AS took, CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS p
            FROM d WHERE least(n1, n2) <= 10000 AND limit_ > 0
            UNION ALL
            SELECT group1, group2, n1, n2, limit_, took + 1, i + x AS i,
                   sum(p * CASE x WHEN 1 THEN n1 - i ELSE n2 - (took - i) END / CAST(n1 + n2 - took AS DOUBLE))
            FROM walk, (VALUES (0), (1)) moves(x)
            WHERE took < n1 + n2 AND i + x <= n1 AND took + 1 - (i + x) <= n2
              AND abs((i + x) * n2 - (took + 1 - (i + x)) * n1) < limit_
            GROUP BY group1, group2, n1, n2, limit_, took, i + x),
        exact AS (SELECT group1, group2, 1 - coalesce(max(p) FILTER (took = n1 + n2), 0) AS p FROM walk GROUP BY 1, 2),
        z AS (SELECT *, sqrt(n1 * CAST(n2 AS DOUBLE) / (n1 + n2)) * (stat - 0.5 / lcm(n1, n2)) AS z,
              (greatest(n1, n2) + 2 * least(n1, n2)) / (3 * sqrt(CAST(n1 AS DOUBLE) * n2 * (n1 + n2))) AS lean FROM d)
        SELECT z.feature, z.test, z.group1, z.group2, z.n1, z.n2, round(stat, 6) AS stat, round(CASE
            WHEN stat <= 0 THEN 1
            WHEN exact.p IS NOT NULL THEN exact.p
            WHEN n1 = n2 THEN least(1, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(
                2 * lgamma(n1 + 1) - lgamma(n1 - k * round(stat * n1) + 1) - lgamma(n1 + k * round(stat * n1) + 1)))
                FROM range(1, 101) r(k) WHERE k * round(stat * n1) <= n1))
            WHEN z <= 0.2 THEN 1
            ELSE least(1, greatest(0, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END
                * exp(-2 * pow(k * z, 2) - 2 * k * z * lean)) FROM range(1, 101) r(k)))) END, 6) AS p_value
        FROM z LEFT JOIN exact ON exact.group1 = z.group1 AND exact.group2 = z.group2"""


def _moments_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, l_returnflag AS "group", count({c}) AS n, round(avg({c}), 6) AS mean,
            round(var_samp({c}), 6) AS variance FROM lineitem GROUP BY 2"""
        for c in ("l_quantity", "l_discount", "l_tax"))


def _findings_sql() -> str:
    """Messages of chi-square and ANOVA verdicts, with the groups of highest and lowest mean."""
    means = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, l_returnflag AS g, avg({c}) AS m FROM lineitem GROUP BY 2"
        for c in ("l_tax", "l_discount", "l_quantity"))
    chi = _chi_sql("SELECT * FROM lineitem", ["l_linestatus", "l_tax"], "l_returnflag", False, True, places=12)
    f = _anova_sql("lineitem", ["l_discount", "l_quantity"], "l_returnflag", True, places=12)
    return f"""WITH tests AS (SELECT feature, test, p_value FROM ({chi})
            UNION ALL SELECT feature, test, p_value FROM ({f})),
        ends AS (SELECT feature, arg_max(g, m) AS top, max(m) AS high, arg_min(g, m) AS bottom, min(m) AS low
                 FROM ({means}) GROUP BY 1)
        SELECT 'test' AS section, t.feature, CAST(NULL AS VARCHAR) AS "group",
            CASE WHEN p_value < 0.05 THEN 'warning' ELSE 'info' END AS severity,
            CASE WHEN p_value < 0.05 THEN
                printf('%s: the groups differ significantly (%s, p = %.4f).', t.feature, test, p_value)
                || CASE WHEN top IS NULL THEN '' ELSE printf(
                    ' Group %s is highest (%.2f), group %s lowest (%.2f).', top, high, bottom, low) END
            ELSE printf('%s: no significant difference between groups (%s, p = %.4f).', t.feature, test, p_value)
            END AS message
        FROM tests t LEFT JOIN ends e ON t.feature = e.feature"""


_DETAILS = """
    encoding AS (SELECT 'encoding' AS section, "column" AS feature, CAST(NULL AS VARCHAR) AS "group", 'info' AS severity,
        printf('%s holds distinct groups; encode it with %s before modelling.', "column",
            CASE WHEN contains(recommendation, 'OneHotEncoder') THEN 'OneHotEncoder' ELSE 'LabelEncoder' END) AS message
        FROM plan WHERE contains(recommendation, 'OneHotEncoder') OR contains(recommendation, 'LabelEncoder')),
    scaling AS (SELECT 'scaling', "column", NULL, 'info',
        printf('%s is a continuous measure; scale it so that its range does not dominate a model.', "column")
        FROM plan WHERE regexp_matches(recommendation, 'MinMaxScaler|Log1pTransform|PowerTransform')),
    missing AS (SELECT 'missing', "column", NULL, CASE WHEN null_ratio > 0.3 THEN 'warning' ELSE 'info' END,
        printf('%s lacks %.1f%% of its values: %s.', "column", null_ratio * 100, CASE WHEN null_ratio > 0.3
            THEN 'too many to rely on it, consider removing the column' ELSE 'fill the gaps or leave the rows out' END)
        FROM plan WHERE null_ratio > 0),
    rates AS (SELECT lang AS g, avg(CAST(quality IS NULL AS INT)) AS rate, count(*) AS n FROM src WHERE lang IS NOT NULL GROUP BY 1),
    overall AS (SELECT sum(rate * n) / sum(n) AS o FROM rates),
    lacking AS (SELECT 'group missing', 'quality', g, CASE WHEN rate > o THEN 'warning' ELSE 'info' END,
        printf('quality lacks %.1f%% of its values in group %s%s.', rate * 100, g, CASE WHEN rate > o
            THEN ', more than overall, so results for that group may be biased' ELSE '' END) FROM rates, overall),
    verdicts AS (SELECT 'test', t.feature, NULL, CASE WHEN p_value < 0.05 THEN 'warning' ELSE 'info' END,
        CASE WHEN p_value < 0.05 THEN printf('%s: the groups differ significantly (%s, p = %.4f).', t.feature, test, p_value)
                || printf(' Group %s is highest (%.2f), group %s lowest (%.2f).', top, high, bottom, low)
            ELSE printf('%s: no significant difference between groups (%s, p = %.4f).', t.feature, test, p_value) END
        FROM tests t JOIN (SELECT feature, arg_max(g, m) AS top, max(m) AS high, arg_min(g, m) AS bottom, min(m) AS low
                           FROM means GROUP BY 1) e ON t.feature = e.feature),
    spread AS (SELECT 'distribution', feature, group1 || ' / ' || group2, 'warning', printf(
        '%s is distributed differently in groups %s and %s (p = %.3f).', feature, group1, group2, p_value)
        FROM ks WHERE p_value < 0.05),
    scores AS (SELECT attribute, metric, grp, score, row_number() OVER (PARTITION BY attribute, metric ORDER BY score DESC, grp DESC) AS down,
            row_number() OVER (PARTITION BY attribute, metric ORDER BY score, grp) AS up
        FROM (UNPIVOT (SELECT attribute, grp, accuracy, precision, recall, f1, selection_rate FROM metrics)
              ON accuracy, precision, recall, f1, selection_rate INTO NAME metric VALUE score)),
    served AS (SELECT 'outcome', t.attribute, t.grp || ' / ' || b.grp, CASE WHEN t.score - b.score > 0.1 THEN 'warning' ELSE 'info' END,
        CASE WHEN t.metric = 'selection_rate' THEN printf(
                'Group %s is selected at a rate of %.2f and group %s at %.2f: chances may be unequal.', t.grp, t.score, b.grp, b.score)
            ELSE printf('%s is %.2f in group %s but %.2f in group %s: the model serves the second less well.',
                t.metric, t.score, t.grp, b.score, b.grp) END
        FROM scores t JOIN scores b ON t.attribute = b.attribute AND t.metric = b.metric AND t.down = 1 AND b.up = 1),
    wide AS (SELECT 'outcome gap', attribute, NULL, 'warning',
        printf('%s differs by %.2f between groups of %s, over the limit of 0.1.', plain_name, value, attribute)
        FROM gaps WHERE statistic = 'difference' AND value > 0.1),
    driving AS (SELECT 'importance', feature, NULL, 'info',
        printf('%s drives predictions: shuffling it costs %.4f of accuracy.', feature, loss) FROM losses WHERE loss > 0),
    said AS (SELECT * FROM encoding UNION ALL SELECT * FROM scaling UNION ALL SELECT * FROM missing UNION ALL SELECT * FROM lacking
        UNION ALL SELECT * FROM verdicts UNION ALL SELECT * FROM spread UNION ALL SELECT * FROM served UNION ALL SELECT * FROM wide
        UNION ALL SELECT * FROM driving),
    flagged AS (SELECT * FROM said WHERE severity = 'warning' AND feature IS NOT NULL),
    foremost AS (SELECT feature, row_number() OVER (ORDER BY count(*) DESC, feature DESC) AS place
        FROM flagged WHERE section <> 'outcome gap' GROUP BY feature),
    pair AS (SELECT "group" AS g FROM flagged WHERE section = 'outcome' GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
    summary AS (SELECT 'summary', NULL, NULL, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'info' END,
        printf('%d of {columns} columns show possible bias.', count(*))
        || CASE WHEN count(*) > 0 THEN ' Look first at ' || string_agg(feature, ' and ' ORDER BY place) FILTER (place <= 2) || '.' ELSE '' END
        || coalesce((SELECT ' Outcomes differ most often between ' || g || '.' FROM pair), '') FROM foremost)
    SELECT * FROM said UNION ALL SELECT * FROM summary"""


def _all_findings_sql() -> str:
    """Every message of the ``findings`` query, from the tables up."""
    means = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, grp AS g, avg({c}) AS m FROM v GROUP BY 2" for c in ("label", "prediction", "l_quantity"))
    chi = _chi_sql(PREDICTIONS, ["label", "prediction"], "grp", False, True, places=12)
    f = _anova_sql(f"({PREDICTIONS})", ["l_quantity"], "grp", True, places=12)
    right = "avg(CAST(label = {} AS INT))"
    base = right.format("prediction")
    losses = " UNION ALL ".join(f"SELECT '{n}' AS feature, {base} - {right.format(x)} AS loss FROM v" for n, x in (
        ("grp", "CAST(l_quantity > 25 AS INT)"), ("l_quantity", "0"), ("l_quantity_high", "1")))
    return f"""WITH {profiling.profile_rows(LABELLED, profiling._DOCS)}, {preparation.LADDER},
        {outcome._metrics_sql(['grp'])}, gaps AS ({outcome._GAPS}), means AS ({means}), losses AS ({losses}),
        tests AS (SELECT feature, test, p_value FROM ({chi}) UNION ALL SELECT feature, test, p_value FROM ({f})),
        ks AS (SELECT * FROM ({_ks_p_sql(f"({PREDICTIONS})", "l_tax", "grp")})),
        {_DETAILS.replace("{columns}", "14")}"""


def _report_sql() -> str:
    """Recommendations, findings and distributions of the report, as one long table."""
    kinds = [("l_returnflag", "categorical"), ("l_linestatus", "categorical"),
             ("l_quantity", "float"), ("l_discount", "float"), ("l_tax", "float")]
    source = "SELECT " + ", ".join(c for c, _ in kinds) + " FROM lineitem"
    none = "CAST(NULL AS VARCHAR)"
    return f"""SELECT 'recommendations' AS section, "column" AS item, {none} AS statistic, {none} AS place, recommendation AS text,
            CAST(NULL AS DOUBLE) AS value FROM (WITH {profiling.profile_rows(source, kinds)}, {preparation.LADDER} SELECT * FROM plan)
        UNION ALL SELECT 'findings', feature, severity, "group", message, NULL FROM ({_findings_sql()})
        UNION ALL SELECT 'distributions', attribute, statistic, "group", category, value FROM ({visual.ORACLES["report_distributions"]})"""


ORACLES = {
    "report_findings": _findings_sql(),
    "findings": _all_findings_sql(),
    "audit_report": _report_sql(),
    "standardized_difference": f"""WITH g AS (
            SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
            FROM orders GROUP BY 1),
        p AS (SELECT a.g AS group1, b.g AS group2, a.m AS m1, b.m AS m2, a.n AS n1, b.n AS n2,
                sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sd
              FROM g a JOIN g b ON a.g < b.g),
        d AS (SELECT *, (m1 - m2) / sd AS d FROM p)
        SELECT group1, group2, round(d, 6) AS d,
               {ladder_sql("abs(d)", X.EFFECT_SIZE)} AS effect_size,
               round(m1 / 1000, 6) AS mean1, round(m2 / 1000, 6) AS mean2, n1, n2, round(sd / 1000, 6) AS pooled_sd
        FROM d""",
    "chi_square": _chi_sql(PREDICTIONS, ["grp2", "label", "prediction"], "grp", False, True),
    "chi_square_corrected": _chi_sql(PREDICTIONS, ["label", "prediction"], "grp2", True, False),
    "chi_square_many_cells": _chi_sql("SELECT p_size, p_brand FROM part", ["p_size"], "p_brand", False, True),
    "anova": _anova_sql("lineitem", ["l_quantity", "l_discount", "l_tax"], "l_returnflag", True),
    "anova_many_groups": _anova_sql("orders", ["o_totalprice"], "o_orderpriority", True),
    "group_moments": _moments_sql(),
    "ks_pairs": _ks_sql("lineitem", "l_quantity", "l_returnflag"),
    "ks_pairs_continuous": _ks_sql("orders", "o_totalprice", "o_orderpriority"),
    "ks_p_values": f"SELECT group1, group2, p_value FROM ({_ks_p_sql('lineitem', 'l_quantity', 'l_returnflag')})",
    "ks_p_values_equal_sizes": _ks_p_sql("(SELECT s_acctbal, s_suppkey % 4 AS half FROM supplier)", "s_acctbal", "half"),
    "ks_pairs_large_integers": _ks_p_sql(
        "(SELECT o_orderkey + 9007199254740992 AS v, o_orderstatus FROM orders)", "v", "o_orderstatus"),
    "p_values": f"""SELECT feature, test, group1, group2, p_value FROM ({_ks_p_sql('orders', 'o_totalprice', 'o_orderpriority')})
        UNION ALL SELECT feature, test, NULL, NULL, p_value
            FROM ({_anova_sql("orders", ["o_totalprice"], "o_orderpriority", True)})
        UNION ALL SELECT feature, test, NULL, NULL, p_value
            FROM ({_chi_sql("SELECT p_size, p_brand FROM part", ["p_size"], "p_brand", False, True)})""",
}
