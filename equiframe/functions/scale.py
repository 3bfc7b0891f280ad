"""Building blocks that keep ordered and grouped work distributed.

* ``materialise``     writes a frame to the cluster's shared checkpoint folder.
* ``salted_join``     equi-join against a summary, with hot keys spread out.
* ``lookup_join``     the same, broadcasting a summary whose size has been checked.
* ``unordered_pairs`` all pairs of a summary's rows by an equi-join on grid cells.
* ``bucketed_rows`` / ``running_totals`` / ``quantiles`` order a column of any size
  without ever putting it, or one of its groups, into a single task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiframe.functions.columns import ref, rows_of

LOOKUP_ROWS = 20_000
LOOKUP_BYTES = 16 << 20  # of texts; what is larger is not broadcast

_written: dict[str, list[str]] = {}  # by session


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_count(spark: SparkSession) -> int:
    """Parts a hot key is split into: with a third of the rows it keeps most tasks of a shuffle busy."""
    return max(2, math.ceil(partitions(spark) / 4))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`release` of this session deletes."""
    path = f"{shared_folder(spark)}/equiframe/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark._jsparkSession.sessionUUID(), []).append(path)
    return path


def materialise(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several jobs need one costly intermediate: the lineage is cut,
    later jobs prune columns, and a lost executor costs only a re-read.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this session has written; call it when its readers are done."""
    done, paths = 0, _written.pop(spark._jsparkSession.sessionUUID(), [])
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done += 1
    return done


def salted_join(
    big: DataFrame, summary: DataFrame, on: Sequence[str], spread: Column, how: str = "inner"
) -> DataFrame:
    """Equi-join of a big frame with a summary whose keys may be hot in ``big``.

    The summary is repeated once per salt and each big row takes the salt of
    its ``spread`` column, so a key that holds a third of the rows is spread over
    :func:`salt_count` tasks.  There is no broadcast hint: adaptive execution broadcasts the
    summary only when its measured size is under the session's threshold.
    """
    salts = salt_count(big.sparkSession)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


@dataclass
class Lookup:
    """A summary that has been evaluated: ``small`` if it is fit to broadcast."""

    frame: DataFrame
    small: bool


def _width(value) -> int:
    """Bytes of a value, about."""
    if isinstance(value, str):
        return 4 * len(value)
    if isinstance(value, (list, tuple)):
        return sum(map(_width, value))
    return len(value) if isinstance(value, (bytes, bytearray)) else 8


def settle(summary: DataFrame) -> Lookup:
    """Evaluate a summary and keep it as local rows when it has up to ``LOOKUP_ROWS`` and ``LOOKUP_BYTES``."""
    found = summary.limit(LOOKUP_ROWS + 1).collect()
    if len(found) > LOOKUP_ROWS or sum(_width(v) for row in found for v in row) > LOOKUP_BYTES:
        return Lookup(summary, False)
    return Lookup(summary.sparkSession.createDataFrame(found, summary.schema), True)


def evaluated(summary: DataFrame, name: str = "summary") -> DataFrame:
    """A summary whose rows are there: local up to ``LOOKUP_ROWS`` rows, else written to the shared folder.

    Steps that follow read these rows and not the table behind them.
    """
    lookup = settle(summary)
    return lookup.frame if lookup.small else materialise(summary, name)


def lookup_join(
    big: DataFrame, summary: DataFrame | Lookup, on: Sequence[str], spread: Column
) -> DataFrame:
    """Inner join of a table-sized frame with a summary, without moving the table if possible.

    The summary is evaluated first.  Up to ``LOOKUP_ROWS`` rows and ``LOOKUP_BYTES`` it is broadcast, a size
    known before the join is planned; the optimiser alone could not tell, as it sizes an
    aggregate by its input.  Beyond that the join is salted.
    """
    lookup = summary if isinstance(summary, Lookup) else settle(summary)
    if lookup.small:
        return big.join(F.broadcast(lookup.frame), list(on))
    return salted_join(big, lookup.frame, on, spread)


def unordered_pairs(summary: DataFrame, key: str, carry: Sequence[str]) -> DataFrame:
    """Every pair of rows with ``key`` 1 < ``key`` 2, as ``{name}1`` and ``{name}2`` columns.

    Rows are hashed onto a grid, each one is sent to its grid row and its
    grid column, and pairs meet in one cell: an equi-join spread over about as
    many cells as a shuffle has partitions, not a cross join.
    """
    names = [key, *carry]
    side = math.ceil(math.sqrt(partitions(summary.sparkSession)))
    cell = F.pmod(F.xxhash64(key), F.lit(side)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    first = summary.select(*[F.col(n).alias(f"{n}1") for n in names],
                           cell.alias("_row"), other.alias("_column"))
    second = summary.select(*[F.col(n).alias(f"{n}2") for n in names],
                            other.alias("_row"), cell.alias("_column"))
    return (
        first.join(second, ["_row", "_column"])
        .filter(F.col(f"{key}1") < F.col(f"{key}2"))
        .drop("_row", "_column")
    )


def bucket_count(spark: SparkSession) -> int:
    """Buckets for ordered work: one per shuffle partition of the session."""
    return max(2, partitions(spark))


def bucket_splits(
    df: DataFrame, columns: Sequence[str], buckets: int | None = None
) -> dict[str, list[float]]:
    """Approximate quantile edges of each column, collected as metadata.

    At most ``buckets`` numbers per column come back.  They decide only how even
    the buckets are; every result is exact whatever the edges.
    """
    row = df.agg(*[
        edges_of(df.sparkSession, ref(c).cast("double"), buckets).alias(f"e{i}") for i, c in enumerate(columns)
    ]).first()
    return {c: as_splits(edges) for c, edges in zip(columns, row)}


def edges_of(spark: SparkSession, value: Column, buckets: int | None = None) -> Column:
    """Aggregate of the approximate quantile edges of a double column, for :func:`as_splits`."""
    n = buckets or bucket_count(spark)
    return F.percentile_approx(value, [i / n for i in range(1, n)], max(1000, 10 * n))


def as_splits(edges: Sequence[float] | None) -> list[float]:
    """Bucket splits from quantile edges, open at both ends."""
    inf = float("inf")
    return [-inf, *(sorted({e for e in edges or [] if e not in (inf, -inf)}) or [0.0]), inf]


def bucketed_rows(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    buckets: int | None = None,
    exact: bool = False,
    splits: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Long rows ``(*by, column, value, bucket, *sums)``, missing values left out.

    ``sums`` are the amounts that later totals add up; 1 as ``n`` by default.  Values are doubles;
    with ``exact`` they keep the type of the one column there is, and the double only picks the bucket.
    ``splits`` that are known already save the pass that finds them.
    """
    if exact and len(columns) != 1:
        raise ValueError("only a single column keeps its type")
    sums = sums or {"n": F.lit(1)}
    splits = splits or bucket_splits(df, columns, buckets)
    picked = df.select(
        *[ref(b).alias(b) for b in by],
        *[ref(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)],
        *[ref(c).alias(f"x{i}") for i, c in enumerate(columns) if exact],
        *[e.cast("bigint").alias(k) for k, e in sums.items()],
    )
    cut = Bucketizer(
        inputCols=[f"v{i}" for i in range(len(columns))],
        outputCols=[f"b{i}" for i in range(len(columns))],
        splitsArray=[splits[c] for c in columns],
        handleInvalid="keep",
    ).transform(picked)
    return cut.select(
        *[ref(b) for b in by],
        *sums,
        rows_of([
            {"column": F.lit(c), "value": F.col(f"x{i}" if exact else f"v{i}"), "bucket": F.col(f"b{i}").cast("int")}
            for i, c in enumerate(columns)
        ]),
    ).filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def value_totals(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """One row per distinct value.  Equal values collapse map-side, so a value that
    holds a third of all rows is one row after it."""
    return rows.groupBy(*[ref(k) for k in keys], "bucket", "value").agg(
        *[F.sum(s).alias(s) for s in sums]
    )


def bucket_openings(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals before each bucket, ``(*keys, bucket, *sums, before_*, total_*)``.

    One scan and a shuffle of bucket totals; the windows see at most one row
    per bucket and key.
    """
    return opened(rows.groupBy(*[ref(k) for k in keys], "bucket").agg(*[F.sum(s).alias(s) for s in sums]), keys, sums)


def opened(totals: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The same from totals that have one row per bucket and key; other columns stay."""
    whole = Window.partitionBy(*[ref(k) for k in keys])
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "*",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"before_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
    )


def running_totals(
    values: DataFrame, openings: DataFrame, keys: Sequence[str], sums: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running totals ``cum_*`` of ``sums`` in value order within ``keys``.

    ``values`` has columns ``(*keys, bucket, value, *sums)`` and ``openings`` has
    ``(*keys, bucket, before_*)``.  Each bucket is sorted by itself and the total of
    the buckets before it enters as an opening row.  Equal values share a total.
    """
    names = [*keys, "bucket", "value", *sums, "_opening"]
    opening = openings.select(
        *[ref(k) for k in keys], "bucket", F.lit(None).cast(values.schema["value"].dataType).alias("value"),
        *[F.col(f"before_{s}").alias(s) for s in sums], F.lit(True).alias("_opening"),
    )
    tagged = values.withColumn("_opening", F.lit(False)).select(*[ref(n) for n in names])
    order = F.col("value").desc_nulls_first() if descending else F.col("value").asc_nulls_first()
    upto = (
        Window.partitionBy(*[ref(k) for k in keys], "bucket").orderBy(order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.unionByName(opening)
        .select("*", *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums])
        .filter(~F.col("_opening"))
        .drop("_opening")
    )


def quantile_buckets(openings: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """``(*keys, bucket, ranks)``: the buckets that hold a wanted rank, and the ranks inside them."""
    position = F.col("q") * (F.col("total_n") - 1)
    low, high = F.floor(position), F.ceil(position)
    return (
        openings
        .withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in at])))
        .withColumn("rank", F.explode(F.array_distinct(F.array(low, high))))
        .withColumn("weight", F.when(low == high, 1.0).otherwise(1 - F.abs(position - F.col("rank"))))
        .filter((F.col("rank") >= F.col("before_n"))
                & (F.col("rank") < F.col("before_n") + F.col("n")))
        .groupBy(*[ref(k) for k in keys], "bucket")
        .agg(F.collect_list(F.struct(  # at most two ranks per wanted quantile
            "q", "weight", (F.col("rank") - F.col("before_n")).alias("rank"))).alias("ranks"))
    )


def take_buckets(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, bucket, value, n, ranks)``: rows of the wanted buckets, equal values as one."""
    return (
        lookup_join(rows, wanted, [*keys, "bucket"], F.col("value"))
        .groupBy(*[ref(k) for k in keys], "bucket", "value")
        .agg(F.sum("n").alias("n"), F.first("ranks").alias("ranks"))
    )


def ranked_values(taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quantiles ``(*keys, q, value)`` from the rows of the buckets that hold them."""
    inside = (
        Window.partitionBy(*[ref(k) for k in keys], "bucket").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        taken.withColumn("upto", F.sum("n").over(inside))
        .select("*", F.inline("ranks"))
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .groupBy(*[ref(k) for k in keys], "q")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    )


def quantiles(
    df: DataFrame, columns: Sequence[str], at: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles ``(*by, column, q, value)``.

    Bucket totals tell which bucket holds each wanted rank, and only rows of
    those buckets are shuffled and sorted.
    """
    keys = [*by, "column"]
    rows = bucketed_rows(df, columns, by)
    targets = quantile_buckets(bucket_openings(rows, keys, ["n"]), keys, at)
    return ranked_values(take_buckets(rows, targets, keys), keys)
