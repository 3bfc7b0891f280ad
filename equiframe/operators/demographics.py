"""Find demographic columns, rebuild them from one-hot families, bin ages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.functions import fixed as X
from equiframe.functions.columns import (
    as_text, bin_of, clean, is_numeric, kinds, ref, require, rows_of,
)
from equiframe.functions.scale import salted_join
from equiframe.functions.scan import Scan
from equiframe.operators.profile import group_eligible, profile

TOP_GROUPS = 20
FEW_GROUPS = 1_000


def demographic_columns(names: DataFrame | Iterable[str], exact_token: bool = False) -> list[str]:
    """Names that look demographic.  No job runs.

    A keyword matches anywhere in a name (``age`` in ``language``);
    ``exact_token=True`` asks for it as a whole word between separators.
    """
    names = names.columns if isinstance(names, DataFrame) else list(names)

    def matches(name: str) -> bool:
        lowered = name.lower()
        if exact_token:
            parts = lowered.replace(".", "_").replace(" ", "_").replace("-", "_").split("_")
            return any(k in parts for k in X.DEMOGRAPHIC_KEYWORDS)
        return any(k in lowered for k in X.DEMOGRAPHIC_KEYWORDS)

    return [n for n in names if n.startswith(X.DEMOGRAPHIC_PREFIX) or matches(n)]


def existing_columns(wanted: Iterable, names: Sequence[str]) -> list[str]:
    """Wanted columns that exist; an entry is a name or a tuple led by one."""
    picked = [w if isinstance(w, str) else w[0] for w in wanted]
    return [p for p in picked if p in names]


def split_charted(names: Iterable[str]) -> tuple[list[str], list[str]]:
    """Demographic and other columns of a chart request."""
    names = list(names)
    demo = [n for n in names if n in X.CHARTED_ONEHOT_COLUMNS or "demographic" in n]
    return demo, [n for n in names if n not in demo]


# --- ages ------------------------------------------------------------------------

def filter_valid_age(df: DataFrame, age_col: str) -> DataFrame:
    """Drop rows with an age outside 0 to 120; a missing age stays."""
    if age_col not in df.columns:
        return df
    low, high = X.VALID_AGE
    c = ref(age_col)
    return df.filter(c.isNull() | F.isnan(c.cast("double")) | c.between(low, high))


def bin_age(df: DataFrame, age_col: str = "age", new_col: str = "age_group") -> DataFrame:
    if age_col not in df.columns:
        return df
    return df.withColumn(new_col, bin_of(ref(age_col), X.AGE_EDGES, X.AGE_LABELS))


def bin_column(
    df: DataFrame, column: str, edges: Sequence[float] = X.NUMERIC_EDGES,
    labels: Sequence[str] = X.NUMERIC_LABELS, new_col: str | None = None, right: bool = True,
) -> DataFrame:
    require(df, column)
    return df.withColumn(new_col or f"{column}_binned", bin_of(ref(column), edges, labels, right))


def chart_age_group(column: str) -> Column:
    return F.coalesce(bin_of(ref(column), X.CHART_AGE_EDGES, X.CHART_AGE_LABELS), F.lit("Unknown"))


def is_chart_age(df: DataFrame, column: str) -> bool:
    return "age_at_index" in column.lower() and is_numeric(df, column)


def process_age_columns(df: DataFrame, exact_token: bool = False) -> DataFrame:
    """Validate and bin every numeric age column into ``{column}_group``."""
    ages = [
        c for c in demographic_columns(df, exact_token) if "age" in c.lower() and is_numeric(df, c)
    ]
    for c in ages:
        df = filter_valid_age(df, c)
    return df.withColumns(
        {f"{c}_group": bin_of(ref(c), X.AGE_EDGES, X.AGE_LABELS) for c in ages}
    ) if ages else df


def top_groups(df: DataFrame, column: str, n: int = TOP_GROUPS) -> DataFrame:
    """Rows of the ``n`` most frequent values, ties by value.

    Up to ``FEW_GROUPS`` values are found by a sketch and an exact recount and filter the table where it is read;
    for more, and for values that have no text, all are counted and joined.
    """
    require(df, column)
    frame = clean(df)
    kind, data_type = kinds(df)[column], df.schema[column].dataType
    if n <= FEW_GROUPS and not isinstance(data_type, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        found = [value for value, _ in Scan(frame, tops={column: n}).top_values()[column]]
        if kind == "integer":
            return frame.filter(ref(column).isin(found))
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            return frame.filter((ref(column).cast("double") + 0.0).isin(found))  # -0.0 is 0.0
        return frame.filter(ref(column).cast("string").isin(found))
    kept = (
        frame.filter(ref(column).isNotNull())
        .groupBy(ref(column).alias("_top")).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_top").limit(n).select("_top")
    )
    return salted_join(frame.withColumn("_top", ref(column)), kept, ["_top"], F.struct(*[ref(c) for c in df.columns]),
                       "left_semi").drop("_top")


# --- one-hot families --------------------------------------------------------------

def _family(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def _first_flag(flags: Sequence[str], prefix: str, otherwise: str) -> Column:
    return F.coalesce(
        *[F.when(ref(c).cast("double") == 1, F.lit(c.replace(prefix, ""))) for c in flags],
        F.lit(otherwise),
    )


def merge_onehot(
    df: DataFrame, prefixes: Sequence[str] = X.ONEHOT_FAMILIES, drop: bool = True
) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """Merge one-hot families into ``{prefix}_mapped``.

    Returns the new frame, the mapping from prefix to merged column, and a report
    ``(family, merged, members, collisions, dropped)``.  One aggregation
    over all families decides which dummies go (merged column has more than one
    value) and counts rows with several flags set.
    """
    df = clean(df)
    families = {}
    for p in prefixes:
        members = _family(df, p + "_")
        if members:
            families[p] = members
    schema = "family string, merged string, members int, collisions bigint, dropped boolean"
    spark = df.sparkSession
    if not families:
        return df, {}, spark.createDataFrame([], schema)
    merged = {}
    for p, members in families.items():
        if len(members) > 1:
            merged[p] = _first_flag(members, f"{p}_", "unknown")
        else:
            only = as_text(members[0], df.schema[members[0]].dataType)
            merged[p] = F.coalesce(only, F.lit("unknown"))
    aggs = []
    for i, (p, members) in enumerate(families.items()):
        flags = sum((F.coalesce((ref(c).cast("double") == 1).cast("int"), F.lit(0)) for c in members[1:]),
                    F.coalesce((ref(members[0]).cast("double") == 1).cast("int"), F.lit(0)))
        aggs += [F.min(merged[p]).alias(f"lo{i}"), F.max(merged[p]).alias(f"hi{i}"),
                 F.count_if(flags > 1).alias(f"x{i}")]
    found = df.agg(*aggs).first()
    gone, report = set(), []
    for i, (p, members) in enumerate(families.items()):
        varied = found[f"lo{i}"] is not None and found[f"lo{i}"] != found[f"hi{i}"]
        if drop and varied:
            gone.update(members)
        report.append((p, f"{p}_mapped", len(members), found[f"x{i}"], drop and varied))
    out = df.select(
        *[ref(c) for c in df.columns if c not in gone],
        *[merged[p].alias(f"{p}_mapped") for p in families],
    )
    mapping = {p: f"{p}_mapped" for p in families}
    return out, mapping, spark.createDataFrame(report, schema)


def restore_group(df: DataFrame, prefix: str, new_col: str) -> DataFrame:
    """Rebuild one family: the first flag set names the group, else ``Unknown``."""
    members = _family(df, prefix)
    if not members:
        raise ValueError(f"no columns with prefix {prefix}")
    return df.withColumn(new_col, _first_flag(members, prefix, "Unknown"))


def onehot_prefixes(df: DataFrame) -> DataFrame:
    """Name prefixes shared by two or more 0/1 columns, ``(prefix, members)``."""
    flags = [c for c in df.columns if "_" in c]
    schema = "prefix string, members bigint"
    if not flags:
        return df.sparkSession.createDataFrame([], schema)
    return (
        profile(df.select(*[ref(c) for c in flags]))
        .filter("is_binary")
        .groupBy(F.regexp_replace("column", r"_[^_]*$", "").alias("prefix"))
        .agg(F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") >= 2)
        .orderBy("prefix")
    )


def onehot_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows flagged in each one-hot column, ``(column, total)``."""
    require(df, *columns)
    row = clean(df).agg(*[F.sum(ref(c).cast("bigint")).alias(f"t{i}") for i, c in enumerate(columns)])
    return row.select(rows_of([
        {"column": F.lit(c), "total": F.col(f"t{i}")} for i, c in enumerate(columns)
    ]))


def recommend_demographic(
    df: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Demographic columns fit for grouping, after one-hot families are merged.

    Returns the merged frame and ``(column, n_unique, null_ratio)`` of the columns
    with 2 to 15 values, an eligible type, and at most half the values missing.
    """
    merged, mapping, _ = merge_onehot(df)
    names = demographic_columns(merged) if columns is None else columns
    names = [mapping.get(n, n) for n in names]
    names = list(dict.fromkeys(n for n in names if n in merged.columns))
    if not names:
        return merged, df.sparkSession.createDataFrame(
            [], "column string, n_unique bigint, null_ratio double")
    fit = (
        profile(merged, names)
        .filter(F.col("n_unique").between(2, 15) & group_eligible() & (F.col("null_ratio") <= 0.5))
        .orderBy("position")
        .select("column", "n_unique", "null_ratio")
    )
    return merged, fit
