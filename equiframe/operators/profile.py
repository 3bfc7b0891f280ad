"""Column profile, table summary and rules that read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiframe.functions.columns import as_text, clean, kinds, melt_typed, ref, require, rows_of
from equiframe.functions.fixed import NOT_TARGET_KEYWORDS, TARGET_KEYWORDS
from equiframe.functions.scan import Scan

ID_SHARE = 0.9


def _missing_share() -> Column:
    # the missing count is divided, as 1 - present / rows can round over a threshold
    return (F.col("rows") - F.col("non_null")) / F.greatest(F.col("rows"), F.lit(1))


def _stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column from a single aggregation over the table."""
    kind = kinds(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = ref(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if kind[c] in ("integer", "float"):
            aggs.append(F.skewness(v.cast("double")).alias(f"s{i}"))
            aggs.append(F.bool_and(v.isin(0, 1)).alias(f"b{i}"))
        elif types[c].simpleString() == "boolean":
            aggs.append((F.count(v) > 0).alias(f"b{i}"))
    row = df.agg(*aggs)
    have = set(row.columns)
    return row.select("rows", rows_of([
        {
            "position": F.lit(i),
            "column": F.lit(c),
            "kind": F.lit(kind[c]),
            "non_null": F.col(f"n{i}"),
            "is_binary": F.coalesce(F.col(f"b{i}"), F.lit(False)) if f"b{i}" in have else F.lit(False),
            "skewness": F.col(f"s{i}") if f"s{i}" in have else F.lit(None).cast("double"),
        }
        for i, c in enumerate(columns)
    ]))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column, ``(column, n_unique)``.

    Two partial aggregations over the long form.  A multi-column ``countDistinct``
    would expand rows just the same but hold every value set in one final task.
    """
    return (
        melt_typed(df, columns)
        .groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count("one").alias("n_unique"))
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: kind, missing share, distinct values (all counted), skewness."""
    columns = list(columns or df.columns)
    require(df, *columns)
    df = clean(df)
    return (
        _stats(df, columns)
        .join(distinct_counts(df, columns), "column", "left")
        .select("position", "column", "kind", "rows", "non_null", _missing_share().alias("null_ratio"),
                F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "is_binary", "skewness")
    )


def profile_of(scan: Scan) -> DataFrame:
    """:func:`profile` of a scan's columns; without ``n_unique`` where it counts no values, skewness of its numbers only."""
    kind = kinds(scan.df)
    rows = [
        (i, c, kind[c], scan.rows, f.non_null, scan.sizes[c] if c in scan.values else None, bool(f.is_binary), f.skewness)
        for i, (c, f) in enumerate(scan.facts.items())
    ]
    frame = scan.df.sparkSession.createDataFrame(
        rows, "position int, column string, kind string, rows bigint, non_null bigint, n_unique bigint, "
              "is_binary boolean, skewness double")
    return frame.select("position", "column", "kind", "rows", "non_null", _missing_share().alias("null_ratio"),
                        "n_unique", "is_binary", "skewness")


def missing_top(df: DataFrame, n: int = 30) -> DataFrame:
    """Columns with the largest missing share."""
    df = clean(df)
    rows = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    return (
        rows.select("rows", rows_of(
            [{"column": F.lit(c), "non_null": F.col(f"n{i}")} for i, c in enumerate(df.columns)]
        ))
        .select("column", _missing_share().alias("null_ratio"))
        .orderBy(F.desc("null_ratio"), "column").limit(n)
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent text per column, the smallest one on a tie: ``(column, top, freq)``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(*[as_text(c, types[c]).alias(c) for c in columns])
    tops = Scan(texts, tops=dict.fromkeys(columns, 1)).top_values()
    found = [(c, value, n) for c, top in tops.items() for value, n in top]
    return df.sparkSession.createDataFrame(found, "column string, top string, freq bigint")


def most_frequent(counts: DataFrame) -> DataFrame:
    """Most frequent text per column, the smallest one on a tie, ``(column, top, freq)``, of counted texts ``(column, value, n)``."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"))


def table_summary(df: DataFrame) -> DataFrame:
    """Describe every column: long ``(column, statistic, number, text)``.

    Numbers: count, mean, std, min, quartiles, max.  Others: count, unique, top, freq.
    Every column has its type; ``top`` and ``type`` are texts.  One scan reads the table three times:
    moments, counts of values and buckets, and the buckets that hold a quartile.
    """
    kind = kinds(df)
    numeric = [c for c in df.columns if kind[c] in ("integer", "float")]
    others = [c for c in df.columns if c not in numeric]
    scan = Scan(df, numeric, others)
    known = [(f.name, "type", None, f.dataType.simpleString()) for f in df.schema.fields]
    for c in scan.columns:
        f = scan.facts[c]
        known.append((c, "count", float(f.non_null), None))
        if c in numeric:
            known += [(c, "mean", f.mean, None), (c, "std", f.std, None), (c, "min", f.least, None), (c, "max", f.largest, None)]
        else:
            known.append((c, "unique", float(scan.sizes[c]), None))
    out = df.sparkSession.createDataFrame(known, "column string, statistic string, number double, text string")
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if numeric:
        out = out.unionByName(scan.quantiles(numeric, (0.25, 0.5, 0.75)).select(
            "column", F.concat(F.round(F.col("q") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
            F.col("value").alias("number"), no_text.alias("text")))
    if others:
        names = df.sparkSession.createDataFrame([(c,) for c in others], "column string")
        out = out.unionByName(
            names.join(most_frequent(scan.counts(others)), "column", "left").select("column", rows_of([
                {"statistic": F.lit("top"), "number": no_number, "text": F.col("top")},
                {"statistic": F.lit("freq"), "number": F.col("freq").cast("double"), "text": no_text},
            ])))
    return out


# --- rules over the profile -------------------------------------------------

def group_eligible() -> Column:
    """Usable as a grouping column: text, a 0/1 column, or an integer with few values."""
    return (
        (F.col("kind") == "categorical")
        | ((F.col("n_unique") == 2) & F.col("is_binary"))
        | ((F.col("n_unique") <= 15) & (F.col("kind") == "integer"))
    )


def id_like() -> Column:
    return (F.col("kind") == "categorical") & (F.col("n_unique") >= ID_SHARE * F.col("rows"))


def categorical(threshold: int = 10) -> Column:
    return (F.col("n_unique") <= threshold) | (F.col("kind") == "categorical")


def _name_has(words: Sequence[str]) -> Column:
    lowered = F.lower(F.col("column"))
    out = F.lit(False)
    for w in words:
        out = out | lowered.contains(w)
    return out


def valid_target() -> Column:
    return ~id_like() & ~_name_has(NOT_TARGET_KEYWORDS)


def column_rules(df: DataFrame) -> DataFrame:
    """Every rule's verdict per column."""
    return profile(df).select(
        "column", "kind", "n_unique",
        group_eligible().alias("group_eligible"), id_like().alias("id_like"),
        categorical().alias("categorical"), valid_target().alias("valid_target"),
    )


def target_candidates(
    df: DataFrame, min_ratio: float = 0.01, max_unique: int = 10
) -> DataFrame:
    """Columns whose name and make-up suggest a prediction target."""
    named = [c for c in df.columns if any(w in c.lower() for w in TARGET_KEYWORDS)]
    schema = "column string, n_unique bigint, non_null_ratio double"
    if not named:
        return df.sparkSession.createDataFrame([], schema)
    return (
        profile(df, named)
        .withColumn("non_null_ratio", 1 - F.col("null_ratio"))
        .filter(F.col("kind").isin("categorical", "integer")
                & (F.col("n_unique") <= max_unique) & (F.col("non_null_ratio") >= min_ratio))
        .select("column", "n_unique", "non_null_ratio")
    )


def low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Numeric columns whose sample variance is under ``threshold``."""
    df = clean(df)
    kind = kinds(df)
    numeric = [c for c in df.columns if kind[c] in ("integer", "float")]
    if not numeric:
        return df.sparkSession.createDataFrame([], "column string, variance double")
    row = df.agg(*[F.var_samp(ref(c)).alias(f"v{i}") for i, c in enumerate(numeric)])
    return row.select(
        rows_of([{"column": F.lit(c), "variance": F.col(f"v{i}")} for i, c in enumerate(numeric)])
    ).filter(F.col("variance") < threshold)


def groupwise_missing(df: DataFrame, column: str, group_col: str) -> DataFrame:
    """Missing share of ``column`` in each group."""
    require(df, column, group_col)
    df = clean(df)
    return (
        df.filter(ref(group_col).isNotNull())
        .groupBy(ref(group_col).alias("group"))
        .agg(F.count(F.lit(1)).alias("rows"),
             F.avg(ref(column).isNull().cast("double")).alias("missing_rate"))
    )


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cell counts of two columns, missing values left out."""
    require(df, row, column)
    return (
        clean(df).filter(ref(row).isNotNull() & ref(column).isNotNull())
        .groupBy(ref(row).alias("row"), ref(column).alias("col"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def contingency_wide(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """The same with one column per listed value and 0 for empty cells."""
    long = contingency(df, row, column)
    return long.groupBy("row").pivot("col", list(values)).agg(F.sum("n")).na.fill(0)


def group_mean(df: DataFrame, column: str, group_col: str) -> DataFrame:
    require(df, column, group_col)
    return (
        clean(df).filter(ref(group_col).isNotNull())
        .groupBy(ref(group_col).alias("group"))
        .agg(F.avg(ref(column).cast("double")).alias("mean"))
    )


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Counts and shares per value; NULL is a value unless ``keep_null`` is off."""
    require(df, column)
    frame = clean(df)
    if not keep_null:
        frame = frame.filter(ref(column).isNotNull())
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = frame.groupBy(as_text(column, types[column]).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)
