"""Recommend preprocessing steps per column, summarise them, and apply them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.functions import fixed as X
from equiframe.functions.columns import as_text, clean, kinds, ref, require, rows_of
from equiframe.functions.scale import LOOKUP_BYTES, LOOKUP_ROWS, materialise, salt_count
from equiframe.functions.scan import Scan
from equiframe.operators.profile import profile

TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
ONE_HOT_LIMIT = 50
FEW_VALUES = 200   # value lists up to about this long are plan metadata
HOT_SHARE = 0.01


# --- recommend ---------------------------------------------------------------

def _encode_step() -> Column:
    n = F.col("n_unique")
    text = (
        F.when(n <= 10, F.array(F.lit(X.ONE_HOT)))
        .when(n <= 50, F.array(F.lit(X.LABEL)))
        .otherwise(F.array(F.lit(X.LABEL), F.lit(X.HIGH_CARDINALITY)))
    )
    number = (
        F.when(n <= 5, X.LABEL).when(F.col("skewness") > 1, X.LOG1P)
        .when(F.col("skewness") < -1, X.POWER).otherwise(X.MIN_MAX)
    )
    return (
        F.when(F.col("kind") == "categorical", text)
        .when(F.col("kind").isin("integer", "float"), F.array(number))
        .otherwise(F.array(F.lit(X.UNKNOWN_TYPE)))
    )


def _missing_step() -> Column:
    share = F.col("null_ratio")
    return (
        F.when(share >= 0.7, F.array(F.lit(X.DROP_HIGH_NANS)))
        .when(share > 0.5, F.array(F.lit(X.IMPUTE), F.lit(X.CONSIDER_DROPPING)))
        .when(share > 0.3, F.array(F.lit(X.IMPUTE), F.lit(X.HIGH_MISSING)))
        .when(share > 0, F.array(F.lit(X.IMPUTE)))
        .otherwise(F.array().cast("array<string>"))
    )


def recommend(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """Preprocessing plan, one row per column in table order.

    Pass the frame of :func:`profile` to reuse it.
    """
    profiled = profile(df) if profiled is None else profiled
    empty = (F.col("non_null") == 0) | (F.col("n_unique") == 0)
    steps = F.when(empty, F.array(F.lit(X.DROP_COLUMN))).otherwise(
        F.concat(_encode_step(), _missing_step())
    )
    return (
        profiled.withColumn("steps", steps)
        .withColumn("recommendation", F.array_join("steps", X.STEP_SEPARATOR))
        .select("position", "column", "kind", "n_unique", "null_ratio", "skewness",
                "steps", "recommendation")
    )


def _has(step: str) -> Column:
    return F.array_contains("steps", step)


def summarize_categories(plan: DataFrame, mode: str = "exact", readable: bool = False) -> DataFrame:
    """Plan totals per category, the part of a column name before its first dot.

    ``readable`` gives the columns the headings that the interface shows.

    ``mode="exact"`` files undotted names under ``project``.  ``mode="prefix"`` takes
    each name's first part and counts every column whose name starts with it,
    so categories may overlap.
    """
    first = F.element_at(F.split("column", r"\."), 1)
    if mode == "prefix":
        # a name starts with a category when one of its prefixes equals it: an equi-join
        categories = plan.select(first.alias("category")).distinct()
        prefixes = plan.withColumn("category", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("column")), lambda n: F.substr(F.col("column"), F.lit(1), n))))
        rows = prefixes.join(categories, "category", "left_semi")
    elif mode == "exact":
        rows = plan.withColumn(
            "category", F.when(F.contains("column", F.lit(".")), first).otherwise("project")
        )
    else:
        raise ValueError("mode is 'exact' or 'prefix'")
    totals = (
        rows.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("columns"),
            F.count_if(_has(X.DROP_COLUMN)).alias("drop_recommended"),
            F.format_string("%.1f%%", F.avg("null_ratio") * 100).alias("avg_missing"),
            F.count_if(_has(X.ONE_HOT)).alias("onehot_recommended"),
            F.count_if(_has(X.MIN_MAX) | _has(X.LOG1P)).alias("numeric_transform"),
        )
        .orderBy("category")
    )
    return totals.withColumnsRenamed(X.CATEGORY_HEADINGS) if readable else totals


# --- apply ---------------------------------------------------------------------

def dedupe(df: DataFrame) -> DataFrame:
    """Drop repeated rows; copies collapse map-side before the shuffle."""
    return df.dropDuplicates()


def _fills(df: DataFrame, columns: Sequence[str]) -> dict:
    """Fill value of each column: the mode of text and truth values, the median of numbers, the middle of times.

    One scan serves all columns: edges and sketches, counts of frequent values and buckets, and the buckets that hold a median.
    """
    kind = kinds(df)
    types = {c: df.schema[c].dataType for c in columns}
    out = {}
    text = [c for c in columns if kind[c] == "categorical"]
    truths = [c for c in columns if isinstance(types[c], T.BooleanType)]
    numbers = [c for c in columns if kind[c] in ("integer", "float")]
    times = [c for c in columns if isinstance(types[c], TIMES)]
    if not columns:
        return out
    ordered = [*numbers, *times]
    scan = Scan(df.withColumns({c: _ticks(df, c) for c in times}), ordered, tops=dict.fromkeys([*text, *truths], 1))
    if text or truths:
        found = {c: top[0][0] for c, top in scan.top_values().items() if top}
        out.update({c: found.get(c, X.MISSING_FALLBACK) for c in text})
        out.update({c: found[c] == "true" for c in truths if c in found})
    if ordered:
        found = {r["column"]: r["value"] for r in scan.quantiles(ordered, [0.5]).collect()}
        out.update({c: int(found[c] // 1) for c in times if c in found})
        out.update({c: found[c] for c in numbers if c in found})
    return out


def _ticks(df: DataFrame, name: str) -> Column:
    """Days of a date, microseconds of a timestamp, since 1970."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.unix_date(ref(name))
    return F.unix_micros(ref(name).cast("timestamp"))


def _filled(df: DataFrame, name: str, fill) -> Column:
    data_type = df.schema[name].dataType
    if fill is None:
        return ref(name)
    if isinstance(data_type, T.DateType):
        return F.coalesce(ref(name), F.date_from_unix_date(F.lit(fill)))
    if isinstance(data_type, TIMES):
        return F.coalesce(ref(name), F.timestamp_micros(F.lit(fill)).cast(data_type))
    if kinds(df)[name] == "integer" and float(fill) == int(fill):
        return F.coalesce(ref(name), F.lit(int(fill)).cast(data_type))
    if kinds(df)[name] in ("integer", "float"):
        return F.coalesce(ref(name).cast("double"), F.lit(float(fill)))
    return F.coalesce(ref(name), F.lit(fill))


def impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, *columns)
    df = clean(df)
    fills = _fills(df, columns)
    return df.withColumns({c: _filled(df, c, fills.get(c)) for c in columns})


@dataclass
class Fit:
    """What scalers and encoders need to know of a table, all of it metadata."""

    ranges: dict[str, tuple]        # smallest and largest value
    values: dict[str, list[str]]    # distinct texts in value order, for columns with few
    missing: dict[str, bool]


def _fit(df: DataFrame, ranged: Sequence[str] = (), coded: Sequence[str] = ()) -> Fit:
    """One aggregation for all columns, then the values of the columns that have few."""
    aggs = []
    for i, c in enumerate(ranged):
        aggs += [F.min(ref(c)).alias(f"lo{i}"), F.max(ref(c)).alias(f"hi{i}")]
    for i, c in enumerate(coded):
        aggs += [F.approx_count_distinct(ref(c)).alias(f"e{i}"), F.count_if(ref(c).isNull()).alias(f"m{i}")]
    if not aggs:
        return Fit({}, {}, {})
    row = df.agg(*aggs).first()
    few = [c for i, c in enumerate(coded) if row[f"e{i}"] <= FEW_VALUES]
    values = {}
    if few:
        types = {f.name: f.dataType for f in df.schema.fields}
        sets = df.agg(*[  # in value order, each value with its text
            F.array_sort(F.collect_set(F.when(ref(c).isNotNull(), F.struct(
                ref(c).alias("v"), as_text(c, types[c]).alias("text"))))).alias(f"s{i}")
            for i, c in enumerate(few)
        ]).first()
        values = {c: [v["text"] for v in found] for c, found in zip(few, sets)}
    return Fit(
        {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(ranged)},
        values,
        {c: row[f"m{i}"] > 0 for i, c in enumerate(coded)},
    )


def _dummies(df: DataFrame, name: str, values: Sequence[str]) -> list[Column]:
    text = as_text(name, df.schema[name].dataType)
    return [text.eqNullSafe(F.lit(v)).alias(f"{name}_{v}") for v in values]


def _one_hot(df: DataFrame, columns: Sequence[str], fit: Fit) -> DataFrame:
    shown = [c for c in columns if c in fit.values and len(fit.values[c]) <= ONE_HOT_LIMIT]
    return df.select(
        *[ref(c) for c in df.columns if c not in shown],
        *[d for c in shown for d in _dummies(df, c, fit.values[c])],
    )


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Boolean column per value, ``{column}_{value}``, added at the end.

    A column with more than ``ONE_HOT_LIMIT`` values is left as it is.
    """
    require(df, *columns)
    df = clean(df)
    return _one_hot(df, columns, _fit(df, coded=columns))


def _label_text(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_text(name, df.schema[name].dataType), F.lit(X.MISSING_LABEL))


def label_codes(df: DataFrame, name: str) -> DataFrame:
    """Rank of every label in text order, ``(label, n, code)``, however many there are."""
    return label_dictionary(df, [name]).select("label", "n", "code")


def label_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ranks of the labels of several columns, ``(column, label, n, code)``, from one count and one write.

    Labels are range-partitioned by column and text, sorted and written with their place in the
    partition; the partition sizes then turn places into ranks, and a column's first rank is taken off.
    No label list passes through the driver or one task.
    """
    place = F.monotonically_increasing_id()
    ranged = materialise(
        df.select(rows_of([{"column": F.lit(c), "label": _label_text(df, c)} for c in columns]))
        .groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange("column", "label").sortWithinPartitions("column", "label")
        .select("column", "label", "n", F.shiftright(place, 33).alias("part"),
                place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        "labels",
    )
    # one row per partition and column, ranked over partitions within each column
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part", "column").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
        .select("part", "column", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    )
    return ranged.join(starts, ["part", "column"]).select(
        "column", "label", "n", (F.col("start") + F.col("place")).alias("code")
    )


def _join_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns of many labels by their codes, all from one dictionary.

    Up to ``LOOKUP_ROWS`` codes of a column, in ``LOOKUP_BYTES``, are broadcast.  Beyond that it is a shuffled join in
    which labels that hold over 1 % of the rows (there are under 100 a column) are spread
    over salts, so that no key is hot.  One job over the dictionary tells sizes and hot labels of all columns.
    """
    codes = label_dictionary(df, columns)
    sizes = codes.groupBy("column").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("total"))
    facts = {r["column"]: r for r in codes.join(F.broadcast(sizes), "column").groupBy("column").agg(
        F.first("labels").alias("labels"), F.sum(F.octet_length("label")).alias("bytes"),
        F.collect_list(F.when(F.col("n") > F.col("total") * HOT_SHARE, F.col("label"))).alias("hot")).collect()}
    parts, out = salt_count(df.sparkSession), df
    for c in columns:
        if c not in facts:  # no row, no label
            out = out.withColumn(c, F.lit(None).cast("bigint"))
            continue
        table = codes.filter(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        keyed = out.withColumn("_label", _label_text(out, c))
        if facts[c]["labels"] <= LOOKUP_ROWS and facts[c]["bytes"] <= LOOKUP_BYTES:
            joined = keyed.join(F.broadcast(table), "_label")
        else:
            hot = F.col("_label").isin(facts[c]["hot"])
            salt = F.pmod(F.xxhash64(*[ref(k) for k in df.columns]), F.lit(parts)).cast("int")
            salts = F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
            joined = keyed.withColumn("_salt", F.when(hot, salt).otherwise(F.lit(0))).join(
                table.withColumn("_salt", F.explode(salts)), ["_label", "_salt"])
        out = joined.select(*[F.col("_code").alias(k) if k == c else ref(k) for k in out.columns])
    return out


def _code_of(df: DataFrame, name: str, values: Sequence[str], has_missing: bool) -> Column:
    texts = sorted({*values, *([X.MISSING_LABEL] if has_missing else [])})
    labels = F.array(*[F.lit(t) for t in texts])
    return F.array_position(labels, _label_text(df, name)) - 1


def _label_encode(df: DataFrame, columns: Sequence[str], fit: Fit) -> DataFrame:
    small = {
        c: _code_of(df, c, fit.values[c], fit.missing[c]).alias(c) for c in columns if c in fit.values
    }
    out = df.select(*[small.get(c, ref(c)) for c in df.columns])
    large = [c for c in columns if c not in small]
    return _join_codes(out, large) if large else out


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes 0, 1, … in text order; a missing value is the label ``missing_label``."""
    require(df, *columns)
    df = clean(df)
    return _label_encode(df, columns, _fit(df, coded=columns))


def _scaled(c: Column, low, high) -> Column:
    if low is None:
        return c
    if low == high:
        return F.when(c.isNotNull(), F.lit(0.0))
    return (c.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))


def _rescale(df: DataFrame, scaled: Sequence[str], logged: Sequence[str], fit: Fit) -> DataFrame:
    new = {c: _scaled(ref(c), *fit.ranges[c]).alias(c) for c in scaled}
    for c in logged:
        low = fit.ranges[c][0]
        if low is not None and low > -1:
            new[c] = F.log1p(ref(c)).alias(c)
    return df.select(*[new.get(c, ref(c)) for c in df.columns])


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant becomes 0, missing values stay."""
    require(df, *columns)
    df = clean(df)
    return _rescale(df, columns, [], _fit(df, ranged=columns))


def log1p_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``log(1 + x)``; a column with any value of -1 or less is left as it is."""
    require(df, *columns)
    df = clean(df)
    return _rescale(df, [], columns, _fit(df, ranged=columns))


def apply_plan(
    df: DataFrame,
    plan: DataFrame | None = None,
    scaling: bool = True,
    encoding: bool = True,
    missing: bool = True,
) -> DataFrame:
    """Apply a plan: dedupe, then per column drop, impute, and one encoder or scaler.

    ``plan`` has ``column`` and ``steps`` (edit it to override a step) and is made
    from ``df`` by default.  The three switches leave out scaling and log steps,
    encoders, or everything about missing values.  ``PowerTransform`` and
    ``UnknownType`` are recommendations without an action.

    The deduplicated table is written once to the shared folder, because several
    fit jobs read it; each of them reads only the columns it needs.
    """
    df = clean(df)
    plan = recommend(df) if plan is None else plan
    steps = {r["column"]: r["steps"] for r in plan.select("column", "steps").collect()}
    steps = {c: s for c, s in steps.items() if c in df.columns}

    def picked(step: str) -> list[str]:
        return [c for c, s in steps.items() if step in s and c not in dropped]

    dropped: set[str] = set()
    dropped = set(picked(X.DROP_COLUMN)) | (set(picked(X.DROP_HIGH_NANS)) if missing else set())
    kind = kinds(df)
    # rows repeat if all columns do, so dropped columns leave after the comparison and before the write
    out = materialise(dedupe(df).select(*[ref(c) for c in df.columns if c not in dropped]), "deduped")
    if missing:
        imputed = picked(X.IMPUTE)
        fills = _fills(out, imputed)
        out = out.select(*[
            _filled(out, c, fills.get(c)).alias(c) if c in imputed else ref(c) for c in out.columns
        ])
    hot = picked(X.ONE_HOT) if encoding else []
    labelled = [c for c in picked(X.LABEL) if c not in hot] if encoding else []
    scaled = [c for c in picked(X.MIN_MAX) if kind[c] in ("integer", "float")] if scaling else []
    logged = [c for c in picked(X.LOG1P) if kind[c] in ("integer", "float")] if scaling else []
    scaled = [c for c in scaled if c not in hot and c not in labelled]
    logged = [c for c in logged if c not in hot and c not in labelled and c not in scaled]
    fit = _fit(out, scaled + logged, labelled + hot)
    return _one_hot(_label_encode(_rescale(out, scaled, logged, fit), labelled, fit), hot, fit)


def shape_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after a plan."""
    def shape(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(stage).alias("stage"), "rows", F.lit(len(df.columns)).alias("columns")
        )
    return shape(before, "before").unionByName(shape(after, "after"))
