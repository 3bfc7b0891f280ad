"""Preprocessing queries and CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiframe.functions.fixed import CATEGORY_HEADINGS
from equiframe.functions.scale import shared_path
from equiframe.operators import prepare as prep
from equiframe.operators.profile import profile
from equiframe.sources.csv import read_csv, write_csv
from workload.profiling import _DOCS, profile_rows
from workload.views import FLAGS, LABELLED, flags, labelled, rounded, table


def _plan_text(plan):
    return plan.select("position", "column", "kind", "n_unique", "null_ratio", "skewness", "recommendation")


def _pass_through(s, d):
    """Steps that are advice only leave their columns as they are."""
    docs = labelled(s, d)
    advice = F.when(F.col("column") == "n_chars", F.array(F.lit("PowerTransform"))).when(
        F.col("column") == "doc_id", F.array(F.lit("UnknownType"))).otherwise(F.array(F.lit("DropColumn")))
    return prep.apply_plan(docs, prep.recommend(docs).withColumn("steps", advice))


def _csv_roundtrip(s, d):
    """Write documents with several kinds of missing-value text, read them back typed."""
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.coalesce(F.col("quality").cast("string"), F.lit("--")).alias("quality"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("N/A")).alias("toxic"),
        (F.col("n_chars") / 7).alias("ratio"), (F.col("n_chars") > 1000).alias("long"),
    )
    path = shared_path(s, "csv")
    write_csv(docs, path)
    return rounded(read_csv(s, path))


def _csv_lines(s, d):
    """Fields with quotes, commas and line breaks, written and read back split by split."""
    note = F.concat(F.col("lang"), F.lit('\n"'), F.col("source"), F.lit('",\n\n'), F.col("doc_id").cast("string"), F.lit(' "'))
    path = shared_path(s, "csv")
    write_csv(table(s, d, "documents").select("doc_id", note.alias("note"), "n_chars"), path)
    return read_csv(s, path)


def _gaps(s, d):
    """Truth values and dates with gaps."""
    docs = labelled(s, d)
    seen = F.col("quality").isNotNull()
    return docs.select("doc_id", F.when(seen, F.col("n_chars") > 1500).alias("large"), F.when(
        seen, F.date_from_unix_date((F.col("doc_id") % 997).cast("int"))).alias("day"))


def _plan_edited(s, d):
    """A plan with one step overridden by the user and scaling switched off."""
    docs = labelled(s, d)
    plan = prep.recommend(docs).withColumn(
        "steps", F.when(F.col("column") == "source", F.array(F.lit("DropColumn"))).otherwise(F.col("steps")))
    return prep.apply_plan(docs, plan, scaling=False)


QUERIES = {
    "recommend": lambda s, d: rounded(_plan_text(prep.recommend(labelled(s, d)))),
    "recommend_from_profile": lambda s, d: rounded(_plan_text(
        prep.recommend(labelled(s, d), profile(labelled(s, d))))),
    "summarize_categories": lambda s, d: prep.summarize_categories(prep.recommend(flags(s, d))),
    "summarize_categories_prefix": lambda s, d: prep.summarize_categories(prep.recommend(flags(s, d)), "prefix"),
    "summarize_categories_missing": lambda s, d: prep.summarize_categories(prep.recommend(labelled(s, d))),
    "dedupe": lambda s, d: prep.dedupe(labelled(s, d).drop("doc_id", "n_chars")),
    "impute": lambda s, d: prep.impute(
        labelled(s, d).withColumn("lang", F.when(F.col("quality").isNotNull(), F.col("lang"))),
        ["lang", "quality", "toxic"]),
    "impute_truths_and_dates": lambda s, d: prep.impute(_gaps(s, d), ["large", "day"]),
    "min_max_scale": lambda s, d: rounded(prep.min_max_scale(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"),
        ["l_quantity", "l_tax"])),
    "log1p_transform": lambda s, d: rounded(prep.log1p_transform(
        table(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])),
    "one_hot": lambda s, d: prep.one_hot(
        table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), ["c_mktsegment", "c_name"]),
    "label_encode": lambda s, d: prep.label_encode(
        table(s, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"]),
    "label_encode_many": lambda s, d: prep.label_encode(
        table(s, d, "customer").select("c_custkey", "c_name"), ["c_name"]),
    "label_encode_two_large": lambda s, d: prep.label_encode(
        table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("key")), ["key", "o_custkey"]),
    "label_codes": lambda s, d: prep.label_codes(table(s, d, "lineitem").select("l_partkey"), "l_partkey"),
    "apply_plan": lambda s, d: rounded(prep.apply_plan(labelled(s, d))),
    "apply_plan_edited": _plan_edited,
    "apply_plan_pass_through": _pass_through,
    "apply_plan_no_encoding": lambda s, d: rounded(prep.apply_plan(labelled(s, d), encoding=False)),
    "apply_plan_keep_missing": lambda s, d: rounded(prep.apply_plan(labelled(s, d), missing=False)),
    "summarize_categories_readable": lambda s, d: prep.summarize_categories(prep.recommend(flags(s, d)), readable=True),
    "shape_change": lambda s, d: prep.shape_change(labelled(s, d), prep.apply_plan(labelled(s, d))),
    "csv_roundtrip": _csv_roundtrip,
    "csv_records_over_lines": _csv_lines,
}

# The recommendation ladder over a profile.
LADDER = """
    plan AS (SELECT *, CASE WHEN non_null = 0 THEN 'DropColumn' ELSE
        CASE WHEN kind = 'categorical' AND n_unique <= 10 THEN 'OneHotEncoder'
             WHEN kind = 'categorical' AND n_unique <= 50 THEN 'LabelEncoder'
             WHEN kind = 'categorical' THEN 'LabelEncoder + ⚠️ HighCardinality'
             WHEN n_unique <= 5 THEN 'LabelEncoder' WHEN skewness > 1 THEN 'Log1pTransform'
             WHEN skewness < -1 THEN 'PowerTransform' ELSE 'MinMaxScaler' END ||
        CASE WHEN null_ratio >= 0.7 THEN ' + DropHighNaNs'
             WHEN null_ratio > 0.5 THEN ' + ImputeMissing + ⚠️ ConsiderDropping'
             WHEN null_ratio > 0.3 THEN ' + ImputeMissing + ⚠️ HighMissingRate'
             WHEN null_ratio > 0 THEN ' + ImputeMissing' ELSE '' END END AS recommendation
        FROM prof)"""
_PLAN = """SELECT position, "column", kind, n_unique, round(null_ratio, 6) AS null_ratio,
    round(skewness, 6) AS skewness, recommendation FROM plan"""
# Plain names for the dotted columns of the one-hot view.
_FLAG_COLUMNS = ("case.id", "demographic.race_auto", "demographic.race_building", "demographic.race_furniture",
                 "demographic.race_machinery", "lab.value")


def _flag_profile() -> str:
    plain = ", ".join(f'"{c}" AS c{i}' for i, c in enumerate(_FLAG_COLUMNS))
    kinds = [(f"c{i}", "float" if c == "lab.value" else "integer") for i, c in enumerate(_FLAG_COLUMNS)]
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_FLAG_COLUMNS))
    return f"""{profile_rows(f'SELECT {plain} FROM ({FLAGS})', kinds)}, {LADDER},
        named AS (SELECT * REPLACE (CASE position {names} END AS "column") FROM plan)"""


_TOTALS = """count(*) AS columns, count(*) FILTER (contains(recommendation, 'DropColumn')) AS drop_recommended,
    printf('%.1f%%', avg(null_ratio) * 100) AS avg_missing,
    count(*) FILTER (contains(recommendation, 'OneHotEncoder')) AS onehot_recommended,
    count(*) FILTER (contains(recommendation, 'MinMaxScaler') OR contains(recommendation, 'Log1p'))
        AS numeric_transform"""

ORACLES = {
    "csv_records_over_lines": """SELECT doc_id, lang || chr(10) || '"' || source || '",' || chr(10) || chr(10) || doc_id || ' "' AS note,
        n_chars FROM documents""",
    "recommend": f"WITH {profile_rows(LABELLED, _DOCS)}, {LADDER} {_PLAN}",
    "recommend_from_profile": f"WITH {profile_rows(LABELLED, _DOCS)}, {LADDER} {_PLAN}",
    "summarize_categories": f"""WITH {_flag_profile()}
        SELECT split_part("column", '.', 1) AS category, {_TOTALS} FROM named GROUP BY 1""",
    "summarize_categories_prefix": f"""WITH {_flag_profile()},
        c AS (SELECT DISTINCT split_part("column", '.', 1) AS category FROM named)
        SELECT category, {_TOTALS} FROM c JOIN named ON starts_with(named."column", c.category) GROUP BY 1""",
    "summarize_categories_missing": f"""WITH {profile_rows(LABELLED, _DOCS)}, {LADDER}
        SELECT 'project' AS category, {_TOTALS} FROM plan""",
    "dedupe": f"SELECT DISTINCT lang, source, quality, toxic FROM ({LABELLED})",
    "impute": f"""WITH v AS (SELECT * REPLACE (CASE WHEN quality IS NOT NULL THEN lang END AS lang) FROM ({LABELLED}))
        SELECT doc_id, coalesce(lang, (SELECT lang FROM v WHERE lang IS NOT NULL GROUP BY 1
                                       ORDER BY count(*) DESC, 1 LIMIT 1)) AS lang, source, n_chars,
               CAST(coalesce(quality, (SELECT median(quality) FROM v)) AS INT) AS quality,
               CAST(coalesce(toxic, (SELECT median(toxic) FROM v)) AS INT) AS toxic FROM v""",
    "impute_truths_and_dates": f"""WITH v AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN n_chars > 1500 END AS large,
            CASE WHEN quality IS NOT NULL THEN doc_id % 997 END AS days FROM ({LABELLED}))
        SELECT doc_id, coalesce(large, (SELECT large FROM v WHERE large IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
            AS large, DATE '1970-01-01' + CAST(floor(coalesce(days, (SELECT median(days) FROM v))) AS INT) AS day FROM v""",
    "min_max_scale": """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS e
                                   FROM lineitem)
        SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity,
               round((l_tax - c) / (e - c), 6) AS l_tax FROM lineitem, r""",
    "log1p_transform": """SELECT c_custkey,
        round(CASE WHEN (SELECT min(c_acctbal) FROM customer) > -1 THEN ln(1 + c_acctbal) ELSE c_acctbal END, 6)
            AS c_acctbal,
        round(ln(1 + CAST(c_nationkey AS DOUBLE)), 6) AS c_nationkey FROM customer""",
    "one_hot": "SELECT c_custkey, c_name, " + ", ".join(
        f"c_mktsegment = '{v}' AS \"c_mktsegment_{v}\""
        for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
    "label_encode": """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
        dense_rank() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS p_size FROM part""",
    "label_encode_many": """SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer""",
    "label_encode_two_large": """SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS o_custkey,
        dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS "key" FROM orders""",
    "label_codes": """SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS code FROM (
        SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY 1)""",
    "apply_plan": f"""WITH v AS (SELECT DISTINCT * FROM ({LABELLED}))
        SELECT round((doc_id - (SELECT min(doc_id) FROM v))
                     / CAST((SELECT max(doc_id) - min(doc_id) FROM v) AS DOUBLE), 6) AS doc_id,
               dense_rank() OVER (ORDER BY source) - 1 AS source, round(ln(1 + n_chars), 6) AS n_chars,
               dense_rank() OVER (ORDER BY coalesce(quality, (SELECT median(quality) FROM v))) - 1 AS quality,
               dense_rank() OVER (ORDER BY coalesce(toxic, (SELECT median(toxic) FROM v))) - 1 AS toxic,
               lang = 'de' AS lang_de, lang = 'en' AS lang_en, lang = 'es' AS lang_es, lang = 'fr' AS lang_fr
        FROM v""",
    "apply_plan_edited": f"""WITH v AS (SELECT DISTINCT * FROM ({LABELLED}))
        SELECT doc_id, n_chars,
               dense_rank() OVER (ORDER BY coalesce(quality, (SELECT median(quality) FROM v))) - 1 AS quality,
               dense_rank() OVER (ORDER BY coalesce(toxic, (SELECT median(toxic) FROM v))) - 1 AS toxic,
               lang = 'de' AS lang_de, lang = 'en' AS lang_en, lang = 'es' AS lang_es, lang = 'fr' AS lang_fr
        FROM v""",
    "apply_plan_pass_through": f"SELECT doc_id, n_chars FROM (SELECT DISTINCT * FROM ({LABELLED}))",
    "apply_plan_no_encoding": f"""WITH v AS (SELECT DISTINCT * FROM ({LABELLED}))
        SELECT round((doc_id - (SELECT min(doc_id) FROM v))
                     / CAST((SELECT max(doc_id) - min(doc_id) FROM v) AS DOUBLE), 6) AS doc_id,
               lang, source, round(ln(1 + n_chars), 6) AS n_chars,
               CAST(coalesce(quality, (SELECT median(quality) FROM v)) AS INT) AS quality,
               CAST(coalesce(toxic, (SELECT median(toxic) FROM v)) AS INT) AS toxic FROM v""",
    "apply_plan_keep_missing": f"""WITH v AS (SELECT DISTINCT * FROM ({LABELLED}))
        SELECT round((doc_id - (SELECT min(doc_id) FROM v))
                     / CAST((SELECT max(doc_id) - min(doc_id) FROM v) AS DOUBLE), 6) AS doc_id,
               dense_rank() OVER (ORDER BY source) - 1 AS source, round(ln(1 + n_chars), 6) AS n_chars,
               dense_rank() OVER (ORDER BY coalesce(CAST(quality AS VARCHAR), 'missing_label')) - 1 AS quality,
               dense_rank() OVER (ORDER BY coalesce(CAST(toxic AS VARCHAR), 'missing_label')) - 1 AS toxic,
               lang = 'de' AS lang_de, lang = 'en' AS lang_en, lang = 'es' AS lang_es, lang = 'fr' AS lang_fr
        FROM v""",
    "shape_change": f"""SELECT 'before' AS stage, count(*) AS rows, CAST(6 AS INT) AS columns FROM ({LABELLED})
        UNION ALL SELECT 'after', count(*), 9 FROM (SELECT DISTINCT * FROM ({LABELLED}))""",
    "csv_roundtrip": """SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.quality AS BIGINT) AS quality,
        CAST(l.toxic AS BIGINT) AS toxic, round(d.n_chars / 7.0, 6) AS ratio, d.n_chars > 1000 AS long
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
ORACLES["summarize_categories_readable"] = "SELECT " + ", ".join(
    f'{plain} AS "{shown}"' for plain, shown in CATEGORY_HEADINGS.items()) + f" FROM ({ORACLES['summarize_categories']})"
