import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from equiframe.functions import frequent
from equiframe.functions.scan import Scan
from equiframe.operators import demographics as demo
from equiframe.operators.profile import modes

SHAPES = {
    "hot": lambda r: "hot" if r.random() < 1 / 3 else f"v{r.randrange(4000)}",
    "steps": lambda r: f"s{int(r.paretovariate(0.6))}",
    "even": lambda r: f"e{r.randrange(6)}",
    "ties": lambda r: f"t{r.randrange(3000)}",
    "alone": lambda r: f"{r.random():.12f}",
    "gaps": lambda r: None if r.random() < 0.5 else f"g{int(r.paretovariate(1))}",
    "none": lambda r: None,
}


def table(spark, rows=6000, seed=1):
    r = random.Random(seed)
    data = [tuple(f(r) for f in SHAPES.values()) for _ in range(rows)]
    return data, spark.createDataFrame(data, ", ".join(f"{c} string" for c in SHAPES))


def brute(data, column, n):
    counts = Counter(row[column] for row in data if row[column] is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("n", [1, 5, 20])
@pytest.mark.parametrize("tracked", [10_000, 200])
def test_against_all_counts(spark, monkeypatch, n, tracked):
    """A sketch of 200 hashes errs, so most columns need the bound or the full count."""
    monkeypatch.setattr(frequent, "TRACKED", tracked)
    data, df = table(spark)
    found = Scan(df, tops=dict.fromkeys(df.columns, n)).top_values()
    assert found == {c: brute(data, i, n) for i, c in enumerate(df.columns)}


def test_only_candidates_are_counted(spark, monkeypatch):
    monkeypatch.setattr(frequent, "TRACKED", 200)
    _, df = table(spark)
    scan = Scan(df, tops={"hot": 1})
    assert scan.heavy["hot"] is not None
    assert scan.cells.filter("value is not null").count() == len(scan.heavy["hot"].keys) < 20


def test_with_buckets_and_counts(spark):
    """A column may be ordered, counted and ranked at once."""
    df = spark.range(300).select((F.col("id") % 7).alias("k"), (F.col("id") % 3 / 2).alias("x"), F.lit("c").alias("t"))
    scan = Scan(df, ["k", "x"], ["t"], tops={"k": 2, "x": 1, "t": 1})
    assert scan.top_values() == {"k": [(0, 43), (1, 43)], "x": [(0.0, 100)], "t": [("c", 300)]}
    assert {r["q"]: r["value"] for r in scan.quantiles(["k"], [0.5]).collect()} == {0.5: 3.0}
    assert Scan(df.limit(0), tops={"k": 2}).top_values() == {"k": []}


def test_bound():
    rows = [{"item": 1, "count": 50}, {"item": 2, "count": 30}, {"item": 3, "count": 10}]
    heavy = frequent.heavy_hashes(rows, 1, 1000)
    assert (heavy.keys, heavy.cut, heavy.least) == ([1], 45.0, 10)
    assert heavy.proves(46, 46, 1000) and not heavy.proves(44, 44, 1000) and not heavy.proves(None, 44, 1000)
    assert frequent.heavy_hashes(rows, 4, 1000) is None and frequent.heavy_hashes([], 1, 1000) is None
    assert frequent.heavy_hashes(rows, 4, 90).proves(None, 90, 90)


@pytest.mark.parametrize("column", ["k", "x", "d", "t", "b", "m"])
def test_top_groups_of_every_kind(spark, column):
    df = spark.range(200).select(
        (F.col("id") % 5 * (F.col("id") % 2)).alias("k"), (F.when(F.col("id") % 4 < 2, -0.0).otherwise(F.col("id") % 9) * 1.0).alias("x"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("d"), F.concat(F.lit("t"), F.col("id") % 6).alias("t"),
        F.encode(F.concat(F.lit("b"), F.col("id") % 4), "utf-8").alias("b"), (F.col("id") % 4).cast("decimal(6,2)").alias("m"))
    counts = Counter(r[0] for r in df.select(column).collect())
    want = sorted(counts, key=lambda v: (-counts[v], v))[:2]
    got = Counter(r[0] for r in demo.top_groups(df, column, 2).select(column).collect())
    assert got == {v: counts[v] for v in want}
    assert demo.top_groups(df, column, 2).columns == df.columns


def test_more_groups_than_a_filter_lists(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"), F.lit(1).alias("_one"))
    assert demo.top_groups(df, "k", 1200).agg(F.max("k"), F.count("*")).first() == (1199, 2400)


def test_modes_of_texts(spark):
    data, df = table(spark, 500)
    assert {(r["column"], r["top"], r["freq"]) for r in modes(df, df.columns).collect()} == {
        (c, *brute(data, i, 1)[0]) for i, c in enumerate(df.columns) if brute(data, i, 1)}
