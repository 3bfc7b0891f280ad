"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType, T.DecimalType)


def q(name: str) -> str:
    """Back-tick a flat column name, which may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(q(name))


def kind_of(data_type: T.DataType) -> str:
    """Type family that the audit rules look at."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(data_type, _INTEGER):
        return "integer"
    if isinstance(data_type, _FLOAT):
        return "float"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def is_numeric(df: DataFrame, name: str) -> bool:
    return kinds(df)[name] in ("integer", "float")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def clean(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, so that a missing value is one thing everywhere."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema):
        return df
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def as_text(name: str, data_type: T.DataType) -> Column:
    """Text form of a value; equal values have equal text."""
    c = ref(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(data_type)  # -0.0 and 0.0 are one value
    return c.cast("string")


def safe_div(num: Column, den: Column, otherwise: float | None = 0.0) -> Column:
    """``num / den`` with a stated result where the divisor is zero."""
    out = F.when(den != 0, num.cast("double") / den.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def ladder(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """First label whose upper bound lies above ``value``; NULL stays NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, text in steps:
        if bound is None:
            return out.otherwise(F.lit(text))
        out = out.when(value < bound, F.lit(text))
    return out


def label_of(name: Column) -> Column:
    """Display label of a dotted name: last part, spaces, title case."""
    last = F.element_at(F.split(name, r"\."), -1)
    return F.initcap(F.replace(last, F.lit("_"), F.lit(" ")))


def bin_of(
    value: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False
) -> Column:
    """Label of the bin that holds ``value``; NULL outside the edges.

    Bins are left-closed, or right-closed with ``right=True``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("one label is needed per bin")
    out = None
    for low, high, text in zip(edges, edges[1:], labels):
        if right:
            inside = (value > low) & (value <= high)
        else:
            inside = value >= low
            # NaN sorts above every number, so an open last bin needs the test spelled out
            inside = inside & ((value < high) if high != float("inf") else ~F.isnan(value))
        out = F.when(inside, text) if out is None else out.when(inside, text)
    return out


def melt(df: DataFrame, columns: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(*keep, column, value)`` with every value as text, one pass."""
    columns = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), as_text(c, types[c]).alias("value"))
        for c in columns
    ])
    return df.select(*[ref(k) for k in keep], F.inline(cells))


def typed_value(name: str, data_type: T.DataType) -> Column:
    """A value of any type as one struct that can be compared and grouped; NULL if missing.

    Numbers stay numbers, so that counting values of many columns at once does not
    format them as text.
    """
    c, kind = ref(name), kind_of(data_type)
    whole, number, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if kind == "integer":
        whole = c.cast("bigint")
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        number = c.cast("double")
    else:
        text = c.cast("string")
    return F.when(c.isNotNull(), F.struct(
        whole.alias("whole"), number.alias("number"), text.alias("text")))


def melt_typed(df: DataFrame, columns: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(*keep, column, value)`` with :func:`typed_value` values, missing ones left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[ref(k) for k in keep], rows_of([
        {"column": F.lit(c), "value": typed_value(c, types[c])} for c in columns
    ])).filter(F.col("value").isNotNull())


def rows_of(rows: Iterable[dict[str, Column]]) -> Column:
    """Generator of one output row per mapping, all with the same keys."""
    return F.inline(F.array(*[
        F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows
    ]))


def one_row(df: DataFrame) -> Column:
    """A one-row summary as a struct-valued scalar subquery."""
    return df.select(F.struct(*[ref(c).alias(c) for c in df.columns])).scalar()
