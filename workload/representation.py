"""Representation audit queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.operators import representation as rep
from equiframe.sources.benchmark import benchmark_from_json, observed_benchmark
from workload.views import LABELLED, labelled, ladder_sql, literal_rows, rounded, table

# HOUSEHOLD is missing on purpose.
SHARES = {"AUTOMOBILE": 0.25, "BUILDING": 0.2, "FURNITURE": 0.15, "MACHINERY": 0.4}
TYPED = {"1-URGENT": 0.3, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.1}
RACES = {"AUTOMOBILE": "Black", "BUILDING": "White", "FURNITURE": "Hispanic", "MACHINERY": "Asian"}


def _segments(spark, sf):
    return rep.input_fairness(table(spark, sf, "customer"), "c_mktsegment", SHARES)


def _races(spark, sf):
    c = F.col("c_mktsegment")
    race = F.lit("Other")
    for segment, name in RACES.items():
        race = F.when(c == segment, name).otherwise(race)
    return table(spark, sf, "customer").select(race.alias("race"))


def _quality(spark, sf):
    return rep.input_fairness(labelled(spark, sf), "quality", {"0": 0.2, "1": 0.8})


QUERIES = {
    "input_fairness": lambda s, d: rounded(_segments(s, d)),
    "input_fairness_default_benchmark": lambda s, d: rounded(rep.input_fairness(_races(s, d), "race")),
    "input_fairness_missing_group": lambda s, d: rounded(_quality(s, d)),
    "distribution_distance": lambda s, d: rounded(rep.distribution_distance(_segments(s, d))),
    "severity_labels": lambda s, d: rounded(rep.severity_labels(rep.distribution_distance(_segments(s, d)))),
    "fairness_summary": lambda s, d: rounded(rep.fairness_summary(_quality(s, d))),
    "observed_benchmark": lambda s, d: observed_benchmark(table(s, d, "orders"), "o_orderpriority"),
    "benchmark_from_json": lambda s, d: rounded(rep.input_fairness(
        table(s, d, "orders"), "o_orderpriority",
        benchmark_from_json(table(s, d, "orders"), "o_orderpriority", json.dumps(TYPED)))),
    "benchmark_from_bad_json": lambda s, d: rounded(rep.input_fairness(
        table(s, d, "orders"), "o_orderpriority",
        benchmark_from_json(table(s, d, "orders"), "o_orderpriority", "{not json"))),
    "top_disparity": lambda s, d: rounded(rep.top_disparity(_segments(s, d), 3)),
    "observed_vs_expected": lambda s, d: rounded(rep.observed_vs_expected(_segments(s, d), 4)),
}


def _audit_sql(source: str, group: str, bench: str) -> str:
    """Body of a WITH clause that ends in ``audit``, unrounded."""
    return f"""
    bench(grp, expected) AS ({bench}),
    counts AS (SELECT CAST({group} AS VARCHAR) AS grp, count(*) AS n FROM ({source}) GROUP BY 1),
    shares AS (SELECT c.grp, c.n, c.n / CAST((SELECT sum(n) FROM counts) AS DOUBLE) AS o,
                      coalesce(b.expected, 0.0001) AS e
               FROM counts c LEFT JOIN bench b ON c.grp = b.grp),
    audit AS (SELECT grp, n, o, e, o / e AS r, abs(o - e) AS a FROM shares)"""


AUDIT_COLUMNS = """
    SELECT grp AS "group", n AS observed_count, round(o, 6) AS observed_share,
           round(CAST(e AS DOUBLE), 6) AS expected_share, round(r, 6) AS disparity_ratio,
           round(a, 6) AS abs_difference,
           CASE WHEN r BETWEEN 0.8 AND 1.25 THEN 'Fair' ELSE 'Not Fair' END AS fair,
           CASE WHEN r < 0.8 THEN 'Under-represented' WHEN r > 1.25 THEN 'Over-represented'
                ELSE 'Within bounds' END AS deviation_type
    FROM audit"""

DISTANCES = f"""
    clamped AS (SELECT greatest(o, 1e-8) AS p, greatest(e, 1e-8) AS q FROM audit),
    normal AS (SELECT p / (SELECT sum(p) FROM clamped) AS p, q / (SELECT sum(q) FROM clamped) AS q FROM clamped),
    ranked AS (SELECT row_number() OVER (ORDER BY o) AS i, o / (SELECT sum(o) FROM audit) AS v FROM audit),
    ranked2 AS (SELECT row_number() OVER (ORDER BY e) AS i, e / (SELECT sum(e) FROM audit) AS v FROM audit),
    distances AS (SELECT (SELECT sum(p * ln(p / q)) FROM normal) AS kl,
        (SELECT avg(abs(a.v - b.v)) FROM ranked a JOIN ranked2 b ON a.i = b.i) AS w,
        (SELECT sum(a) / 2 FROM audit) AS tv),
    named AS (SELECT kl, w, tv,
        {ladder_sql("kl", X.SEVERITY["kl_divergence"])} AS kl_s,
        {ladder_sql("w", X.SEVERITY["wasserstein_distance"])} AS w_s,
        {ladder_sql("tv", X.SEVERITY["total_variation"])} AS tv_s
        FROM distances)"""

SEGMENT_SQL = _audit_sql("SELECT c_mktsegment FROM customer", "c_mktsegment", literal_rows(SHARES))
RACE_SOURCE = (
    "SELECT CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RACES.items())
    + " ELSE 'Other' END AS race FROM customer"
)
QUALITY_SQL = _audit_sql(LABELLED, "quality", literal_rows({"0": 0.2, "1": 0.8}))
OBSERVED = """
    SELECT o_orderpriority AS grp, round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 3) AS expected
    FROM orders GROUP BY 1"""

ORACLES = {
    "input_fairness": f"WITH {SEGMENT_SQL} {AUDIT_COLUMNS}",
    "input_fairness_default_benchmark":
        f"WITH {_audit_sql(RACE_SOURCE, 'race', literal_rows(X.DEFAULT_BENCHMARK))} {AUDIT_COLUMNS}",
    "input_fairness_missing_group": f"WITH {QUALITY_SQL} {AUDIT_COLUMNS}",
    "distribution_distance": f"""WITH {SEGMENT_SQL}, {DISTANCES}
        SELECT round(kl, 6) AS kl_divergence, round(w, 6) AS wasserstein_distance,
               round(tv, 6) AS total_variation FROM named""",
    "severity_labels": f"""WITH {SEGMENT_SQL}, {DISTANCES}
        SELECT 'kl_divergence' AS metric, round(kl, 6) AS value, kl_s AS severity FROM named
        UNION ALL SELECT 'wasserstein_distance', round(w, 6), w_s FROM named
        UNION ALL SELECT 'total_variation', round(tv, 6), tv_s FROM named""",
    "fairness_summary": f"""WITH {QUALITY_SQL}, {DISTANCES},
        totals AS (SELECT count(*) AS t, count(*) FILTER (r BETWEEN 0.8 AND 1.25) AS f FROM audit)
        SELECT t AS total_groups, f AS fair_groups, t - f AS unfair_groups,
               round(f / CAST(t AS DOUBLE), 6) AS fairness_rate,
               round(kl, 6) AS kl_divergence, round(w, 6) AS wasserstein_distance,
               round(tv, 6) AS total_variation, kl_s AS kl_divergence_severity,
               w_s AS wasserstein_distance_severity, tv_s AS total_variation_severity
        FROM totals, named""",
    "observed_benchmark": f'SELECT grp AS "group", expected FROM ({OBSERVED})',
    "benchmark_from_json": f"""WITH {_audit_sql("SELECT o_orderpriority FROM orders", "o_orderpriority",
                                               literal_rows(TYPED))} {AUDIT_COLUMNS}""",
    "benchmark_from_bad_json": f"""WITH {_audit_sql("SELECT o_orderpriority FROM orders", "o_orderpriority",
                                                   OBSERVED)} {AUDIT_COLUMNS}""",
    "top_disparity": f"""WITH {SEGMENT_SQL}
        SELECT grp AS "group", round(r, 6) AS disparity_ratio,
               CASE WHEN r BETWEEN 0.8 AND 1.25 THEN 'Fair' ELSE 'Not Fair' END AS fair,
               r > 2 OR r < 0.5 AS extreme
        FROM audit ORDER BY r DESC, grp LIMIT 3""",
    "observed_vs_expected": f"""WITH {SEGMENT_SQL},
        top AS (SELECT * FROM audit ORDER BY o DESC, grp LIMIT 4)
        SELECT grp AS "group", 'observed' AS kind, round(o, 6) AS share FROM top
        UNION ALL SELECT grp, 'expected', round(CAST(e AS DOUBLE), 6) FROM top""",
}
