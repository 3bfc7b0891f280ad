"""Inputs of the queries, as Spark frames and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round floating-point results, so that summation order does not show."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# Labelled predictions with a gap between groups.
PREDICTIONS = """
    SELECT l_orderkey, l_linenumber, l_returnflag AS grp, l_linestatus AS grp2, l_quantity, l_tax,
           CAST(l_discount >= 0.05 AS INT) AS label,
           CAST(l_quantity > CASE l_returnflag WHEN 'A' THEN 20 WHEN 'N' THEN 25 ELSE 30 END AS INT)
               AS prediction
    FROM lineitem"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    threshold = F.when(F.col("l_returnflag") == "A", 20).when(F.col("l_returnflag") == "N", 25).otherwise(30)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("grp2"),
        "l_quantity", "l_tax", (F.col("l_discount") >= 0.05).cast("int").alias("label"),
        (F.col("l_quantity") > threshold).cast("int").alias("prediction"),
    )


# Natural missingness: most documents have no label.
LABELLED = """
    SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
    )


# A dotted one-hot family in which one segment has no flag.
SEGMENTS = {
    "race_auto": "AUTOMOBILE", "race_building": "BUILDING",
    "race_furniture": "FURNITURE", "race_machinery": "MACHINERY",
}
FLAGS = (
    'SELECT c_custkey AS "case.id", '
    + ", ".join(f"CAST(c_mktsegment = '{v}' AS INT) AS \"demographic.{k}\"" for k, v in SEGMENTS.items())
    + ', c_acctbal AS "lab.value" FROM customer'
)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case.id"),
        *[(F.col("c_mktsegment") == v).cast("int").alias(f"demographic.{k}") for k, v in SEGMENTS.items()],
        F.col("c_acctbal").alias("lab.value"),
    )


# Ages with invalid values, -7 to 140.
AGES = "SELECT p_partkey, p_size * 3 - 10 AS age, p_brand FROM part"


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3 - 10).alias("age"), "p_brand")


def literal_rows(values: dict[str, float]) -> str:
    return "VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in values.items())


def ladder_sql(value: str, steps) -> str:
    """SQL of a ladder of ``(upper bound, label)``; the last label has no bound."""
    cases = " ".join(f"WHEN {value} < {bound} THEN '{label}'" for bound, label in steps if bound is not None)
    return f"CASE {cases} ELSE '{steps[-1][1]}' END"


def bins_sql(value: str, edges, labels, right: bool = False) -> str:
    """SQL of bins, closed on the left unless ``right``; NULL outside."""
    first, second = (">", "<=") if right else (">=", "<")
    return "CASE " + " ".join(
        f"WHEN {value} {first} {low}" + ("" if high == float("inf") else f" AND {value} {second} {high}") + f" THEN '{label}'"
        for low, high, label in zip(edges, edges[1:], labels)) + " END"
