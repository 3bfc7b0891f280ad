"""A training corpus from raw documents, stage by stage.

Each stage works on all rows that the stage before has kept, and is written and read again before the
next one starts.  ``run`` returns the rows of the last.  Stages keep the columns of ``documents``; others are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiframe.llm import decontaminate, language, mixing, secret_scan, simhash
from equiframe.llm.shared import Stored, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_FIT = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those of whose letters under half lie in a span of a language that is written so.

    A text in several known languages stays.  Rows stay as they are; ``lang`` is not rewritten.
    """
    labelled = language.identify(docs, language.train(docs))
    return labelled.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("fits") >= LEAST_FIT)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose fingerprints of three-word shingles link at 3 bits the smallest ``doc_id`` stays."""
    return simhash.drop_near_copies(docs).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that contain an item of ``benchmark`` go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every row stays, ``n_chars`` follows the new text."""
    scanned = secret_scan.scan_secrets(docs)
    return scanned.withColumn("text", F.col("redacted")).withColumn(
        "n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.emit(docs.select(*COLUMNS)).select(*COLUMNS)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]

# Span labelling, fingerprints, edit distances and a forest have no SQL; the tests hold each
# stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-")).frame
    return docs
