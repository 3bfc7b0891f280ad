"""CSV scan with type inference after null-token cleaning, and CSV sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.functions.columns import q, ref
from equiframe.functions.fixed import NULL_TOKENS
from equiframe.sources.csv_records import column_names, csv_records

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_BOOLEAN = r"^(True|False|TRUE|FALSE|true|false)$"


OPTIONS = {"quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}


def _whole_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**OPTIONS).option("header", True).csv(path)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The same of files whose records run over lines: records are found split by split, then parsed one by one."""
    records = csv_records(spark, path)
    header = records.filter("is_header").orderBy("file").select("record").first()
    if header is None:
        return _whole_lines(spark, path)
    names = column_names(header["record"])
    fields = F.from_csv("record", ", ".join(f"{q(n)} string" for n in names), {**OPTIONS, "multiLine": "true"})
    return records.filter(~F.col("is_header")).select(fields.alias("r")).select(*[F.col("r").getField(n).alias(n) for n in names])


def has_multiline_records(spark: SparkSession, path: str) -> bool:
    """True when some line leaves a quote open, so a record runs over several lines."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER) | c.rlike(_INFINITY), F.trim(c).try_cast("double"))


def read_csv(
    spark: SparkSession,
    path: str,
    null_tokens: Sequence[str] = NULL_TOKENS,
    multiline: bool | None = None,
) -> DataFrame:
    """Read a CSV with a header; types are inferred once null tokens are gone.

    One aggregation over the text decides every column's type: integer, number,
    boolean (only without missing values) or string.  ``multiline=None`` looks for
    records that run over several lines; files with some are read split by split all the same.
    """
    if multiline is None:
        multiline = has_multiline_records(spark, path)
    raw = _records(spark, path) if multiline else _whole_lines(spark, path)
    tokens = list(null_tokens)
    text = raw.select(*[
        F.when(~ref(c).isin(tokens), ref(c)).alias(c) for c in raw.columns
    ])
    tests = []
    for i, c in enumerate(text.columns):
        v = ref(c)
        whole = F.when(v.rlike(_INTEGER), F.trim(v).try_cast("bigint"))
        tests += [
            F.count(v).alias(f"n{i}"),
            F.count(whole).alias(f"i{i}"),
            F.count(_number(v)).alias(f"d{i}"),
            F.count_if(v.rlike(_BOOLEAN)).alias(f"b{i}"),
        ]
    found = text.agg(F.count(F.lit(1)).alias("rows"), *tests).first().asDict()
    out = []
    for i, c in enumerate(text.columns):
        v, n = ref(c), found[f"n{i}"]
        if n and found[f"i{i}"] == n:
            v = F.trim(v).cast("bigint")
        elif n and found[f"d{i}"] == n:
            v = _number(v)
        elif n and n == found["rows"] == found[f"b{i}"]:
            v = v.cast("boolean")
        out.append(v.alias(c))
    return text.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Write UTF-8 CSV part files with a header and no row index."""
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))  # True / False, as a dataframe writes them
        out.append(c.alias(f.name))
    (
        df.select(*out).write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8").csv(path)
    )
