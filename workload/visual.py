"""Chart data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiframe.operators import charts
from workload.views import AGES, ages, labelled, rounded, table


def _people(s, d):
    """Orders as people: two demographic columns, a numeric and a categorical outcome."""
    return table(s, d, "orders").select(
        F.col("o_orderpriority").alias("demographic.race"), F.col("o_orderstatus").alias("gender"),
        (F.col("o_totalprice") / 1000).alias("charge"), F.col("o_orderstatus").alias("outcome"))


def _stretched(s, d):
    """Charges of which some are infinite, to either side, and some are NaN."""
    key = F.col("o_orderkey") % 97
    return table(s, d, "orders").select(F.when(key == 0, float("inf")).when(key == 1, float("-inf")).when(
        key == 2, float("nan")).otherwise(F.round(F.col("o_totalprice") / 1000)).alias("charge"))


AUDITED = ["l_linestatus", "l_tax", "l_discount", "l_quantity"]

QUERIES = {
    "report_distributions": lambda s, d: rounded(charts.distributions(table(s, d, "lineitem"), AUDITED)),
    "group_proportions": lambda s, d: rounded(
        charts.group_proportions(table(s, d, "orders"), "o_orderpriority", "o_orderstatus")),
    "box_stats": lambda s, d: rounded(charts.box_stats(_people(s, d), "charge", "demographic.race")),
    "box_stats_outliers": lambda s, d: rounded(charts.box_stats(labelled(s, d), "n_chars", "lang")),
    "histogram": lambda s, d: rounded(charts.histogram(table(s, d, "lineitem"), "l_quantity")),
    "histogram_auto": lambda s, d: rounded(charts.histogram(_people(s, d), "charge", "auto")),
    "histogram_infinite": lambda s, d: rounded(charts.histogram(_stretched(s, d), "charge", "auto")),
    "density_infinite": lambda s, d: rounded(charts.density(_stretched(s, d), "charge")),
    "density": lambda s, d: rounded(charts.density(table(s, d, "lineitem"), "l_quantity")),
    "demographic_counts": lambda s, d: charts.demographic_counts(
        labelled(s, d).select(F.col("lang").alias("demographic.language"), F.col("quality").alias("demographic.q")),
        ["demographic.language", "demographic.q"]),
    "groupwise_numeric": lambda s, d: rounded(
        charts.groupwise(_people(s, d), ["demographic.race", "gender"], "charge")),
    "groupwise_categorical": lambda s, d: rounded(
        charts.groupwise(_people(s, d), ["demographic.race"], "outcome")),
    "groupwise_counts": lambda s, d: rounded(charts.groupwise(_people(s, d), ["demographic.race", "gender"])),
    "overview": lambda s, d: rounded(charts.overview(ages(s, d), ["age", "p_brand"])),
    "group_profile": lambda s, d: rounded(charts.group_profile(
        table(s, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"])),
}

_PEOPLE = """SELECT o_orderpriority AS race, o_orderstatus AS gender, o_totalprice / 1000 AS charge FROM orders"""


_STRETCHED = "SELECT round(o_totalprice / 1000) AS charge FROM orders WHERE o_orderkey % 97 > 2"


def _box_sql(source: str, value: str, group: str) -> str:
    return f"""src AS (SELECT CAST({group} AS VARCHAR) AS g, CAST({value} AS DOUBLE) AS v FROM ({source})
                       WHERE {group} IS NOT NULL AND {value} IS NOT NULL),
        box AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3
                FROM src GROUP BY 1),
        stats AS (SELECT b.g, count(*) AS n, q1, q2, q3,
            min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo,
            max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi,
            count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
            FROM src s JOIN box b ON s.g = b.g GROUP BY b.g, q1, q2, q3)"""


def _box_wide(column: str, group: str) -> str:
    return f"""SELECT '{column}' AS "column", g AS "{group}", n, round(lo, 6) AS whisker_low, round(q1, 6) AS q1,
        round(q2, 6) AS median, round(q3, 6) AS q3, round(hi, 6) AS whisker_high, outliers FROM stats"""


def _box_long(attribute: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{attribute}' AS attribute, '{name}' AS statistic, g AS "group",
            CAST(NULL AS VARCHAR) AS category, round(CAST({c} AS DOUBLE), 6) AS value FROM stats"""
        for name, c in (("n", "n"), ("whisker_low", "lo"), ("q1", "q1"), ("median", "q2"), ("q3", "q3"),
                        ("whisker_high", "hi"), ("outliers", "outliers")))


def _hist_sql(source: str, value: str, bins: str) -> str:
    """CTE ``hist(bin, low, high, n)``; ``bins`` is a number or ``auto``."""
    count = bins if bins != "auto" else f"""(SELECT CAST(ceil((b - a) / least((b - a) / (log2(n) + 1),
        2 * (q3 - q1) / pow(n, 1.0 / 3))) AS INT) FROM ends)"""
    return f"""hsrc AS (SELECT CAST({value} AS DOUBLE) AS v FROM ({source}) WHERE {value} IS NOT NULL),
        ends AS (SELECT min(v) AS a, max(v) AS b, count(*) AS n, quantile_cont(v, 0.25) AS q1,
                        quantile_cont(v, 0.75) AS q3 FROM hsrc),
        bins AS (SELECT {count} AS k),
        hist AS (SELECT CAST(least(floor((v - a) / ((b - a) / k)), k - 1) AS INT) AS bin,
                        min(a + least(floor((v - a) / ((b - a) / k)), k - 1) * ((b - a) / k)) AS low,
                        min(a + (least(floor((v - a) / ((b - a) / k)), k - 1) + 1) * ((b - a) / k)) AS high,
                        count(*) AS n
                 FROM hsrc, ends, bins GROUP BY 1)"""


def _density_sql(source: str, value: str) -> str:
    return f"""dsrc AS (SELECT CAST({value} AS DOUBLE) AS v FROM ({source}) WHERE {value} IS NOT NULL),
        dends AS (SELECT min(v) AS a, max(v) AS b, count(*) AS n,
                         stddev_samp(v) * pow(count(*), -0.2) AS w FROM dsrc),
        grid AS (SELECT CAST(i AS INT) AS point, a + i * ((b - a) / 199) AS x FROM dends, range(200) t(i)),
        vals AS (SELECT v, count(*) AS c FROM dsrc GROUP BY 1),
        dens AS (SELECT point, x, sum(c * exp(-0.5 * pow((x - v) / w, 2))) / min(n * w * sqrt(2 * pi())) AS density
                 FROM grid, vals, dends GROUP BY 1, 2)"""


def _hist_wide(column: str) -> str:
    return f"""SELECT '{column}' AS "column", bin, round(low, 6) AS low, round(high, 6) AS high, n FROM hist"""


_AGE_BOX = _box_sql(f"SELECT *, 'all' AS g1 FROM ({AGES})", "age", "g1")


def _long(attribute: str, statistic: str, group: str, value: str, source: str) -> str:
    return f"""SELECT '{attribute}' AS attribute, '{statistic}' AS statistic, CAST({group} AS VARCHAR) AS "group",
        CAST(NULL AS VARCHAR) AS category, round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"""


def _number_long(source: str, column: str) -> str:
    return f"""SELECT * FROM (WITH {_hist_sql(source, column, 'auto')}, {_density_sql(source, column)}
        {_long(column, 'low', 'bin', 'low', 'hist')} UNION ALL {_long(column, 'high', 'bin', 'high', 'hist')}
        UNION ALL {_long(column, 'bin_count', 'bin', 'n', 'hist')}
        UNION ALL {_long(column, 'x', 'point', 'x', 'dens')}
        UNION ALL {_long(column, 'density', 'point', 'density', 'dens')})"""


ORACLES = {
    "report_distributions": " UNION ALL ".join(
        [_number_long(f"SELECT {c} FROM lineitem", c) for c in AUDITED[1:]]
        + [_long("l_linestatus", "count", "g", "n",
                 "(SELECT l_linestatus AS g, count(*) AS n FROM lineitem GROUP BY 1)")]),
    "group_proportions": """WITH c AS (SELECT o_orderpriority AS g, o_orderstatus AS t, count(*) AS n
                                       FROM orders GROUP BY 1, 2)
        SELECT g AS "group", t AS category, n, round(n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE), 6) AS proportion
        FROM c""",
    "box_stats": f"WITH {_box_sql(_PEOPLE, 'charge', 'race')} {_box_wide('charge', 'demographic.race')}",
    "box_stats_outliers": f"""WITH {_box_sql('SELECT lang, n_chars FROM documents', 'n_chars', 'lang')}
        {_box_wide('n_chars', 'lang')}""",
    "histogram": f"WITH {_hist_sql('SELECT l_quantity FROM lineitem', 'l_quantity', '20')} {_hist_wide('l_quantity')}",
    "histogram_auto": f"WITH {_hist_sql(_PEOPLE, 'charge', 'auto')} {_hist_wide('charge')}",
    "histogram_infinite": f"""WITH {_hist_sql(_STRETCHED, 'charge', 'auto')} {_hist_wide('charge')}
        UNION ALL SELECT 'charge', NULL, e, e, n FROM (SELECT CASE o_orderkey % 97 WHEN 0 THEN CAST('inf' AS DOUBLE)
            ELSE CAST('-inf' AS DOUBLE) END AS e, count(*) AS n FROM orders WHERE o_orderkey % 97 < 2 GROUP BY 1)""",
    "density_infinite": f"""WITH {_density_sql(_STRETCHED, 'charge')}
        SELECT 'charge' AS "column", point, round(x, 6) AS x, round(density, 6) AS density FROM dens""",
    "density": f"""WITH {_density_sql('SELECT l_quantity FROM lineitem', 'l_quantity')}
        SELECT 'l_quantity' AS "column", point, round(x, 6) AS x, round(density, 6) AS density FROM dens""",
    "demographic_counts": """SELECT 'demographic.language' AS attribute, lang AS category, count(*) AS n
        FROM documents GROUP BY 2
        UNION ALL SELECT 'demographic.q', coalesce(CAST(quality AS VARCHAR), 'None'), count(*)
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 2""",
    "groupwise_numeric": f"""SELECT * FROM (WITH {_box_sql(_PEOPLE, 'charge', 'race')} {_box_long('demographic.race')})
        UNION ALL SELECT * FROM (WITH {_box_sql(_PEOPLE, 'charge', 'gender')} {_box_long('gender')})""",
    "groupwise_categorical": """WITH c AS (SELECT o_orderpriority AS g, o_orderstatus AS t, count(*) AS n
                                           FROM orders GROUP BY 1, 2)
        SELECT 'demographic.race' AS attribute, 'proportion' AS statistic, g AS "group", t AS category,
               round(n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE), 6) AS value FROM c""",
    "groupwise_counts": f"""{_long('demographic.race', 'count', 'g', 'n',
        '(SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1)')}
        UNION ALL {_long('gender', 'count', 'g', 'n',
        '(SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1)')}""",
    "overview": f"""WITH {_hist_sql(AGES, 'age', 'auto')}, {_density_sql(AGES, 'age')}, {_AGE_BOX}
        {_long('age', 'low', 'bin', 'low', 'hist')} UNION ALL {_long('age', 'high', 'bin', 'high', 'hist')}
        UNION ALL {_long('age', 'bin_count', 'bin', 'n', 'hist')}
        UNION ALL {_long('age', 'x', 'point', 'x', 'dens')}
        UNION ALL {_long('age', 'density', 'point', 'density', 'dens')} UNION ALL {_box_long('age')}
        UNION ALL {_long('p_brand', 'count', 'g', 'n', '(SELECT p_brand AS g, count(*) AS n FROM part GROUP BY 1)')}""",
    "group_profile": " UNION ALL ".join(
        f"""SELECT l_returnflag AS "group", '{m}' AS metric,
            round((avg({m}) - (SELECT min({m}) FROM lineitem)) /
                  (SELECT max({m}) - min({m}) FROM lineitem), 6) AS value FROM lineitem GROUP BY 1"""
        for m in ("l_quantity", "l_discount", "l_tax")),
}
