"""Demographic handling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiframe.functions import fixed as X
from equiframe.operators import demographics as demo
from equiframe.operators.charts import column_labels, demographic_counts
from equiframe.operators.profile import profile
from workload.views import AGES, FLAGS, LABELLED, SEGMENTS, ages, bins_sql, flags, labelled, rounded, table

FAMILY = [f"demographic.{k}" for k in SEGMENTS]


def _collided(s, d):
    """The one-hot view with a second flag set where the balance is negative."""
    frame = flags(s, d)
    return frame.withColumn("demographic.race_machinery", F.when(
        F.col("`lab.value`") < 0, 1).otherwise(F.col("`demographic.race_machinery`")))


QUERIES = {
    "filter_valid_age": lambda s, d: demo.filter_valid_age(ages(s, d), "age"),
    "bin_age": lambda s, d: demo.bin_age(ages(s, d)),
    "process_age_columns": lambda s, d: demo.process_age_columns(ages(s, d)),
    "age_chart_bins": lambda s, d: demographic_counts(
        ages(s, d).select(F.col("age").alias("demographic.age_at_index")), ["demographic.age_at_index"]),
    "bin_right_closed": lambda s, d: demo.bin_column(ages(s, d), "age", new_col="age_bin"),
    "top_groups": lambda s, d: demo.top_groups(table(s, d, "part").select("p_partkey", "p_size"), "p_size"),
    "merge_onehot": lambda s, d: rounded(demo.merge_onehot(flags(s, d))[0]),
    "merge_onehot_report": lambda s, d: demo.merge_onehot(_collided(s, d))[2],
    "restore_group": lambda s, d: rounded(
        demo.restore_group(flags(s, d), "demographic.race_", "race_group").drop(*FAMILY)),
    "onehot_prefixes": lambda s, d: demo.onehot_prefixes(flags(s, d)),
    "onehot_totals": lambda s, d: demo.onehot_totals(flags(s, d), FAMILY),
    "recommend_demographic": lambda s, d: rounded(demo.recommend_demographic(flags(s, d))[1]),
    "demographic_columns": lambda s, d: rounded(
        profile(flags(s, d), demo.demographic_columns(flags(s, d)))
        .select("column", "kind", "rows", "n_unique", "null_ratio")),
    "column_labels": lambda s, d: column_labels(flags(s, d)).join(
        profile(flags(s, d)).select("column", "rows"), "column"),
    "existing_columns": lambda s, d: labelled(s, d).select(
        "doc_id", *demo.existing_columns([("lang", "Language"), "source", "absent"], labelled(s, d).columns)),
}

_CASE = " ".join(f"WHEN \"demographic.{k}\" = 1 THEN '{k[len('race_'):]}'" for k in SEGMENTS)
_AGE_GROUP = bins_sql("age", X.AGE_EDGES, X.AGE_LABELS) + " AS age_group"
_LABELS = {"case.id": "Id", "demographic.race_auto": "Race Auto", "demographic.race_building": "Race Building",
           "demographic.race_furniture": "Race Furniture", "demographic.race_machinery": "Race Machinery",
           "lab.value": "Value"}

ORACLES = {
    "filter_valid_age": f"SELECT * FROM ({AGES}) WHERE age IS NULL OR age BETWEEN 0 AND 120",
    "bin_age": f"SELECT *, {_AGE_GROUP} FROM ({AGES})",
    "process_age_columns": f"SELECT *, {_AGE_GROUP} FROM ({AGES}) WHERE age IS NULL OR age BETWEEN 0 AND 120",
    "age_chart_bins": f"""SELECT 'demographic.age_at_index' AS attribute,
        coalesce({bins_sql('age', X.CHART_AGE_EDGES, X.CHART_AGE_LABELS)}, 'Unknown') AS category,
        count(*) AS n FROM ({AGES}) GROUP BY 2""",
    "bin_right_closed": f"SELECT *, {bins_sql('age', X.NUMERIC_EDGES, X.NUMERIC_LABELS, True)} AS age_bin FROM ({AGES})",
    "top_groups": """SELECT p_partkey, p_size FROM part WHERE p_size IN (
        SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, p_size LIMIT 20)""",
    "merge_onehot": f"""SELECT "case.id", round("lab.value", 6) AS "lab.value",
        CASE {_CASE} ELSE 'unknown' END AS "demographic.race_mapped" FROM ({FLAGS})""",
    "merge_onehot_report": """SELECT 'demographic.race' AS family, 'demographic.race_mapped' AS merged,
        CAST(4 AS INT) AS members,
        count(*) FILTER (c_acctbal < 0 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')) AS collisions,
        true AS dropped FROM customer""",
    "restore_group": f"""SELECT "case.id", round("lab.value", 6) AS "lab.value",
        CASE {_CASE} ELSE 'Unknown' END AS race_group FROM ({FLAGS})""",
    "onehot_prefixes": """SELECT 'demographic.race' AS prefix, CAST(count(*) AS BIGINT) AS members FROM (
        SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')""",
    "onehot_totals": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(sum(\"{c}\") AS BIGINT) AS total FROM ({FLAGS})" for c in FAMILY),
    "recommend_demographic": f"""SELECT 'demographic.race_mapped' AS "column",
        count(DISTINCT CASE {_CASE} ELSE 'unknown' END) AS n_unique, 0.0::DOUBLE AS null_ratio FROM ({FLAGS})""",
    "demographic_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'integer' AS kind, count(*) AS rows, count(DISTINCT "{c}") AS n_unique,
            0.0::DOUBLE AS null_ratio FROM ({FLAGS})""" for c in FAMILY),
    "existing_columns": f"SELECT doc_id, lang, source FROM ({LABELLED})",
    "column_labels": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS label, count(*) AS rows FROM customer" for c, t in _LABELS.items()),
}
