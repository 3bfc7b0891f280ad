"""Profile and summary queries."""

from __future__ import annotations

from equiframe.operators import profile as prof
from workload.views import LABELLED, labelled, rounded, table

QUERIES = {
    "profile": lambda s, d: rounded(prof.profile(labelled(s, d))),
    "profile_thresholds": lambda s, d: rounded(
        prof.profile(labelled(s, d)).drop("position")),
    "missing_top": lambda s, d: rounded(prof.missing_top(labelled(s, d), 30)),
    "table_summary": lambda s, d: rounded(prof.table_summary(table(s, d, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")), 8),
    "table_summary_missing": lambda s, d: rounded(prof.table_summary(labelled(s, d).select(
        "lang", "n_chars", "quality"))),
    "column_rules": lambda s, d: prof.column_rules(table(s, d, "customer")),
    "target_candidates": lambda s, d: rounded(prof.target_candidates(table(s, d, "orders"))),
    "groupwise_missing": lambda s, d: rounded(prof.groupwise_missing(labelled(s, d), "quality", "lang")),
    "low_variance": lambda s, d: rounded(prof.low_variance(table(s, d, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag"))),
    "low_variance_of_texts": lambda s, d: prof.low_variance(labelled(s, d).select("lang", "source")),
    "contingency": lambda s, d: prof.contingency(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
    "contingency_wide": lambda s, d: prof.contingency_wide(
        table(s, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]),
    "group_mean": lambda s, d: rounded(prof.group_mean(table(s, d, "lineitem"), "l_discount", "l_returnflag")),
    "value_counts": lambda s, d: rounded(prof.value_counts(labelled(s, d), "quality")),
    "value_counts_known": lambda s, d: rounded(prof.value_counts(labelled(s, d), "quality", keep_null=False)),
}

_DOCS = (("doc_id", "integer"), ("lang", "categorical"), ("source", "categorical"),
         ("n_chars", "integer"), ("quality", "integer"), ("toxic", "integer"))


def profile_rows(source: str, columns) -> str:
    """One row per column: position, column, kind, rows, non_null, null_ratio, n_unique, is_binary, skewness."""
    parts = []
    for i, (c, kind) in enumerate(columns):
        number = kind != "categorical"
        skew = (f"(avg(pow({c} - m, 3)) / nullif(pow(avg(pow({c} - m, 2)), 1.5), 0))" if number
                else "CAST(NULL AS DOUBLE)")
        binary = f"coalesce(bool_and({c} IN (0, 1)), false)" if number else "false"
        mean = f"(SELECT avg({c}) FROM src)" if number else "0"
        parts.append(f"""SELECT CAST({i} AS INT) AS position, '{c}' AS "column", '{kind}' AS kind,
            count(*) AS rows, count({c}) AS non_null, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS null_ratio,
            count(DISTINCT {c}) AS n_unique, {binary} AS is_binary, {skew} AS skewness
            FROM (SELECT *, {mean} AS m FROM src)""")
    return f"src AS ({source}), prof AS ({' UNION ALL '.join(parts)})"


_PROFILE = """SELECT position, "column", kind, rows, non_null, round(null_ratio, 6) AS null_ratio, n_unique,
    is_binary, round(skewness, 6) AS skewness FROM prof"""


def _summary(source: str, numbers, texts, types: dict[str, str], places: int = 6) -> str:
    parts = []
    for c in numbers:
        for name, expr in (
            ("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
            ("min", f"CAST(min({c}) AS DOUBLE)"), ("25%", f"quantile_cont(CAST({c} AS DOUBLE), 0.25)"),
            ("50%", f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"),
            ("75%", f"quantile_cont(CAST({c} AS DOUBLE), 0.75)"), ("max", f"CAST(max({c}) AS DOUBLE)"),
        ):
            parts.append(f"""SELECT '{c}' AS "column", '{name}' AS statistic, round({expr}, {places}) AS number,
                CAST(NULL AS VARCHAR) AS text FROM src""")
    for c in texts:
        top = f"(SELECT {c} AS v, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"
        parts += [
            f"SELECT '{c}', 'count', CAST(count({c}) AS DOUBLE), NULL FROM src",
            f"SELECT '{c}', 'unique', CAST(count(DISTINCT {c}) AS DOUBLE), NULL FROM src",
            f"SELECT '{c}', 'top', NULL, v FROM {top}",
            f"SELECT '{c}', 'freq', CAST(n AS DOUBLE), NULL FROM {top}",
        ]
    parts += [f"SELECT '{c}', 'type', NULL, '{t}'" for c, t in types.items()]
    return f"WITH src AS ({source}) {' UNION ALL '.join(parts)}"


_CUSTOMER = (("c_custkey", "integer"), ("c_name", "categorical"), ("c_nationkey", "integer"),
             ("c_acctbal", "float"), ("c_mktsegment", "categorical"))

ORACLES = {
    "profile": f"WITH {profile_rows(LABELLED, _DOCS)} {_PROFILE}",
    "profile_thresholds": f"""WITH {profile_rows(LABELLED, _DOCS)}
        SELECT * EXCLUDE (position) FROM ({_PROFILE})""",
    "missing_top": f"""WITH {profile_rows(LABELLED, _DOCS)}
        SELECT "column", round(null_ratio, 6) AS null_ratio FROM prof ORDER BY 2 DESC, 1 LIMIT 30""",
    "table_summary": _summary("SELECT * FROM lineitem", ("l_linenumber", "l_quantity", "l_discount", "l_tax"),
                              ("l_returnflag", "l_linestatus"),
                              {"l_linenumber": "int", "l_quantity": "double", "l_discount": "double", "l_tax": "double",
                               "l_returnflag": "string", "l_linestatus": "string"}, 8),
    "table_summary_missing": _summary(LABELLED, ("n_chars", "quality"), ("lang",),
                                      {"lang": "string", "n_chars": "bigint", "quality": "int"}),
    "low_variance_of_texts": """SELECT CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS DOUBLE) AS variance WHERE false""",
    "column_rules": f"""WITH {profile_rows("SELECT * FROM customer", _CUSTOMER)}
        SELECT "column", kind, n_unique,
            kind = 'categorical' OR (n_unique = 2 AND is_binary) OR (n_unique <= 15 AND kind = 'integer')
                AS group_eligible,
            kind = 'categorical' AND n_unique >= 0.9 * rows AS id_like,
            n_unique <= 10 OR kind = 'categorical' AS categorical,
            NOT (kind = 'categorical' AND n_unique >= 0.9 * rows)
                AND NOT (contains(lower("column"), 'id') OR contains(lower("column"), 'case')
                         OR contains(lower("column"), 'patient') OR contains(lower("column"), 'subject'))
                AS valid_target
        FROM prof""",
    "target_candidates": """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_unique,
        round(count(o_orderstatus) / CAST(count(*) AS DOUBLE), 6) AS non_null_ratio FROM orders""",
    "groupwise_missing": f"""SELECT lang AS "group", count(*) AS rows,
        round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM ({LABELLED}) GROUP BY 1""",
    "low_variance": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(var_samp({c}), 6) AS variance FROM lineitem HAVING var_samp({c}) < 0.01"""
        for c in ("l_quantity", "l_discount", "l_tax")),
    "contingency": """SELECT l_returnflag AS "row", l_linestatus AS col, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "contingency_wide": """SELECT l_returnflag AS "row", count(*) FILTER (l_linestatus = 'F') AS "F",
        count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""",
    "group_mean": """SELECT l_returnflag AS "group", round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1""",
    "value_counts": f"""WITH v AS ({LABELLED}) SELECT CAST(quality AS VARCHAR) AS value, count(*) AS n,
        round(count(*) / CAST((SELECT count(*) FROM v) AS DOUBLE), 6) AS share FROM v GROUP BY 1""",
    "value_counts_known": f"""WITH v AS (SELECT * FROM ({LABELLED}) WHERE quality IS NOT NULL)
        SELECT CAST(quality AS VARCHAR) AS value, count(*) AS n,
        round(count(*) / CAST((SELECT count(*) FROM v) AS DOUBLE), 6) AS share FROM v GROUP BY 1""",
}
