"""One reading of a table for several operators.

A :class:`Scan` is told what is wanted of a table before anything is read:

* ``facts``  counts, moments, ends and bucket edges of all columns from one aggregate;
* ``cells``  the counts of all distinct values, and the totals of all buckets, from one grouped pass
  that is written to the shared folder;
* ``top_values`` are the most frequent values of columns of which only those are wanted: a sketch in the first
  aggregate tells which values the grouped pass counts;
* ``quantiles`` and ``boxes`` then read rows of the few buckets that hold a wanted rank or a whisker's end.

A number column whose values are counted and repeat is not read from the table again: its counts stand for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.functions.columns import clean, kinds, melt_typed, ref, require, rows_of, typed_value
from equiframe.functions.frequent import Heavy, heavy_hashes, most_counted, sketch
from equiframe.functions.scale import (
    as_splits, bucketed_rows, edges_of, materialise, opened, quantile_buckets, ranked_values, take_buckets,
)

INF = float("inf")


@dataclass
class Facts:
    """What one aggregate tells of a column; the numbers are missing for other kinds."""

    non_null: int
    mean: float | None = None
    std: float | None = None
    least: float | None = None
    largest: float | None = None
    skewness: float | None = None
    is_binary: bool = False
    finite: int = 0
    low: float | None = None        # ends and deviation of the finite values
    high: float | None = None
    deviation: float | None = None
    below: int = 0                  # rows at either infinity
    above: int = 0
    splits: list[float] | None = None
    listed: list | None = None      # the sketch of the most frequent values


class Scan:
    """What is wanted of ``numbers`` (moments), ``ordered`` numbers (all of them by default), ``values`` (counts of all)
    and ``tops`` (how many of the most frequent values of a column)."""

    def __init__(self, df: DataFrame, numbers: Sequence[str] = (), values: Sequence[str] = (),
                 ordered: Sequence[str] | None = None, tops: Mapping[str, int] | None = None):
        self.tops = dict(tops or {})
        require(df, *numbers, *values, *self.tops)
        self.df = clean(df)
        self.numbers = list(dict.fromkeys(numbers))
        self.values = list(dict.fromkeys(values))
        self.ordered = [c for c in self.numbers if ordered is None or c in ordered]
        self.columns = [c for c in df.columns if c in {*self.numbers, *self.values, *self.tops}]
        self._quartiles: dict[str, tuple[float, float]] = {}
        self.types = {f.name: f.dataType for f in df.schema.fields}

    @cached_property
    def _facts(self) -> tuple[int, dict[str, Facts]]:
        names = list(Facts.__dataclass_fields__)
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(self.columns):
            v = ref(c).cast("double")
            found = {"non_null": F.count(ref(c))}
            if c in self.numbers:
                finite = F.when(F.abs(v) < INF, v)
                found |= {
                    "mean": F.avg(ref(c)).cast("double"), "std": F.stddev_samp(ref(c)), "least": F.min(v), "largest": F.max(v),
                    "skewness": F.skewness(v), "is_binary": F.coalesce(F.bool_and(ref(c).isin(0, 1)), F.lit(False)),
                    "finite": F.count(finite), "low": F.min(finite), "high": F.max(finite), "deviation": F.stddev_samp(finite),
                    "below": F.count_if(v == -INF), "above": F.count_if(v == INF),
                }
                if c in self.ordered:
                    found["splits"] = edges_of(self.df.sparkSession, v)
            elif isinstance(self.types[c], T.BooleanType):
                found["is_binary"] = F.count(ref(c)) > 0
            if c in self.tops and c not in self.values:
                found["listed"] = sketch(typed_value(c, self.types[c]))
            aggs += [e.alias(f"{name}{i}") for name, e in found.items()]
        row = self.df.agg(*aggs).first().asDict()
        out = {}
        for i, c in enumerate(self.columns):
            out[c] = Facts(**{name: row[f"{name}{i}"] for name in names if f"{name}{i}" in row})
            if c in self.ordered:
                out[c].splits = as_splits(out[c].splits)
        return row["rows"], out

    @property
    def rows(self) -> int:
        return self._facts[0]

    @property
    def facts(self) -> dict[str, Facts]:
        return self._facts[1]

    @cached_property
    def heavy(self) -> dict[str, Heavy | None]:
        """What the sketches tell of the columns whose most frequent values are wanted; None where all are counted."""
        return {c: None if c in self.values else heavy_hashes(self.facts[c].listed, n, self.facts[c].non_null)
                for c, n in self.tops.items()}

    @cached_property
    def cells(self) -> DataFrame:
        """``(column, bucket, value, n, low, high)``, written once if several jobs may read it.

        A value column has a row per distinct value, a missing one included; another ordered column has a row
        per bucket, with the ends of its values.  Of a column whose most frequent values are wanted, the others are one row.
        """
        df, bucket = self.df, {}
        if self.ordered:
            df = df.select("*", *[ref(c).cast("double").alias(f"_v{i}") for i, c in enumerate(self.ordered)])
            bucket = {c: i for i, c in enumerate(self.ordered)}
            df = Bucketizer(
                inputCols=[f"_v{i}" for i in bucket.values()], outputCols=[f"_b{i}" for i in bucket.values()],
                splitsArray=[self.facts[c].splits for c in self.ordered], handleInvalid="keep",
            ).transform(df)
        no_value = F.lit(None).cast("struct<whole:bigint,number:double,text:string>")

        def value_of(c: str) -> Column:
            value = typed_value(c, self.types[c])
            if c in self.tops and self.heavy[c]:
                return F.when(F.xxhash64(value).isin(self.heavy[c].keys), value)
            return value if c in self.values or c in self.tops else no_value

        long = df.select(rows_of([{
            "column": F.lit(c),
            "bucket": F.col(f"_b{bucket[c]}").cast("int") if c in bucket else F.lit(None).cast("int"),
            "value": value_of(c),
            "x": F.col(f"_v{bucket[c]}") if c in bucket else F.lit(None).cast("double"),
        } for c in self.columns if c in bucket or c in self.values or c in self.tops]))
        found = long.groupBy("column", "bucket", "value").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        return materialise(found, "cells") if bucket or self.values else found  # the most frequent values alone are one job

    def top_values(self) -> dict[str, list[tuple]]:
        """The most frequent values of each column of ``tops`` as ``(value, n)``, ties by value; a column without a value has none.

        Counts are exact.  Columns in which the candidates' counts do not clear the sketch's bound are read once more.
        """
        counted = self.cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").alias("n"))
        best = self._best(counted, list(self.tops))
        unproven = [c for c, heavy in self.heavy.items() if heavy and not self._proven(heavy, c, *best[c])]
        if unproven:
            every = melt_typed(self.df, unproven).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            best |= self._best(every, unproven)
        return {c: [(next(v for v in r["value"] if v is not None), r["n"]) for r in rows] for c, (rows, _) in best.items()}

    def _proven(self, heavy: Heavy, column: str, rows: list, total: int) -> bool:
        nth = rows[-1]["n"] if len(rows) == self.tops[column] else None
        return heavy.proves(nth, total, self.facts[column].non_null)

    def _best(self, counted: DataFrame, columns: Sequence[str]) -> dict[str, tuple[list, int]]:
        """Per column its largest counts as rows, and the total of all."""
        counted = counted.filter(F.col("column").isin(list(columns)))
        sums = counted.groupBy("column").agg(F.sum("n").alias("n"), F.lit(0).alias("_rank"))
        found = most_counted(counted, max(self.tops.values(), default=0)).unionByName(sums, allowMissingColumns=True).collect()
        totals = {r["column"]: r["n"] for r in found if r["_rank"] == 0}
        rows: dict[str, list] = {c: [] for c in columns}
        for r in sorted((r for r in found if r["_rank"]), key=lambda r: r["_rank"]):
            if r["_rank"] <= self.tops[r["column"]]:
                rows[r["column"]].append(r)
        return {c: (rows[c], totals.get(c, 0)) for c in columns}

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Number of distinct values of each value column, counted exactly."""
        found = self.distinct().collect()
        return dict.fromkeys(self.values, 0) | {r["column"]: r["n_unique"] for r in found}

    def distinct(self) -> DataFrame:
        """``(column, n_unique)`` of the value columns that hold any."""
        return self.cells.filter(F.col("value").isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))

    def counts(self, columns: Sequence[str]) -> DataFrame:
        """``(column, value, n)`` of value columns, missing values left out, values as text."""
        typed = [F.when(F.col("column") == c, F.coalesce(
            # a number takes its own type again, so that its text is that of the column
            *([F.col("value.whole").cast(self.types[c]).cast("string")] if kinds(self.df)[c] == "integer" else []),
            *([(F.col("value.number").cast(self.types[c]) + F.lit(0.0).cast(self.types[c])).cast("string")]
              if isinstance(self.types[c], (T.FloatType, T.DoubleType)) else []),
            F.col("value.text"))) for c in columns]
        return self.cells.filter(F.col("column").isin(list(columns)) & F.col("value").isNotNull()).select(
            "column", F.coalesce(*typed).alias("value"), "n")

    @cached_property
    def compact(self) -> list[str]:
        """Ordered columns whose counted values are at most half the rows: their counts are read, not the table."""
        counted = [c for c in self.ordered if c in self.values]
        return [c for c in counted if 2 * self.sizes[c] <= self.rows] if counted else []

    def value_rows(self, columns: Sequence[str]) -> DataFrame:
        """``(column, value, bucket, n)`` of compact columns, values as doubles."""
        return self.cells.filter(F.col("column").isin(list(columns)) & F.col("low").isNotNull()).select(
            "column", F.col("low").alias("value"), "bucket", "n")

    def ordered_rows(self, columns: Sequence[str]) -> DataFrame:
        """The same of any ordered columns, from their counts or from the table."""
        counted = [c for c in columns if c in self.compact]
        others = [c for c in columns if c not in counted]
        parts = [self.value_rows(counted)] if counted else []
        if others:
            rows = bucketed_rows(self.df, others, splits={c: self.facts[c].splits for c in others})
            parts.append(rows.select("column", "value", "bucket", F.col("n").cast("bigint").alias("n")))
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]

    def totals(self, columns: Sequence[str]) -> DataFrame:
        """``(column, bucket, n, low, high)``, a row per bucket that holds any value."""
        return self.cells.filter(F.col("column").isin(list(columns)) & F.col("low").isNotNull()).groupBy(
            "column", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def quantiles(self, columns: Sequence[str], at: Sequence[float]) -> DataFrame:
        """Exact quantiles ``(column, q, value)``; one more read, of the buckets that hold a wanted rank."""
        targets = quantile_buckets(opened(self.totals(columns), ["column"], ["n"]), ["column"], at)
        return ranked_values(take_buckets(self.ordered_rows(columns), targets, ["column"]), ["column"])

    def quartiles(self, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
        """First and third quartile of each column that holds any value, looked up once."""
        new = [c for c in columns if c not in self._quartiles]
        found: dict[str, dict[float, float]] = {}
        for r in self.quantiles(new, (0.25, 0.75)).collect() if new else []:
            found.setdefault(r["column"], {})[r["q"]] = r["value"]
        self._quartiles |= {c: (at[0.25], at[0.75]) for c, at in found.items()}
        return {c: self._quartiles[c] for c in columns if c in self._quartiles}

    def note_quartiles(self, boxes: DataFrame) -> None:
        """Keep the quartiles of boxes ``(column, q1, q3)`` of this table."""
        self._quartiles |= {r["column"]: (r["q1"], r["q3"]) for r in boxes.select("column", "q1", "q3").collect()}
