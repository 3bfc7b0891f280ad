"""Benchmark distributions: frames of ``(group string, expected double)``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiframe.functions.columns import clean, ref, require
from equiframe.functions.fixed import DEFAULT_BENCHMARK

SCHEMA = "group string, expected double"


def benchmark_from_dict(spark: SparkSession, shares: dict) -> DataFrame:
    if not isinstance(shares, dict):
        raise ValueError("a benchmark is a mapping from group to expected share")
    rows = [(None if k is None else str(k), float(v)) for k, v in shares.items()]
    return spark.createDataFrame(rows, SCHEMA)


def default_benchmark(spark: SparkSession) -> DataFrame:
    return benchmark_from_dict(spark, DEFAULT_BENCHMARK)


def observed_benchmark(df: DataFrame, group_col: str) -> DataFrame:
    """Observed shares of the known groups, rounded to three places."""
    require(df, group_col)
    counts = (
        clean(df.select(ref(group_col).alias("group"))).select(F.col("group").cast("string").alias("group"))
        .filter(F.col("group") != "unknown")  # also leaves NULL out
        .groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select("group", F.round(F.col("n") / total, 3).alias("expected"))


def benchmark_from_json(
    df: DataFrame, group_col: str, text: str | None = None
) -> DataFrame:
    """Benchmark typed as a JSON object; the observed shares when it cannot be read."""
    spark = df.sparkSession
    if text is not None:
        try:
            if isinstance(json.loads(text), dict):
                parsed = spark.createDataFrame([(text,)], "text string").select(
                    F.explode(F.from_json("text", "map<string,double>")).alias("group", "expected")
                )
                return parsed
        except json.JSONDecodeError:
            pass
    return observed_benchmark(df, group_col)
