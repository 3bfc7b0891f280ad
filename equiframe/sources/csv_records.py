"""Records of CSV files that run over several lines, found without giving up splits.

Spark cuts the files into splits of lines.  A line moves a reader from one state to another: outside quotes or
inside.  Where a split begins is not known, so each split tells where it ends from both states, and
these answers, one row per split, are chained in the order of the file.  Each split is then cut into
records from its proven state.  Only the pieces of records that cross a split's end are shuffled, and put together.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ship this module's task functions with their jobs, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A quote opens a field only where the field begins; inside, two quotes stand for one.
_QUOTED = r'(?:[^"]++|"")*+"'
_FIELD = rf'(?:"{_QUOTED}[^,]*+|(?!")[^,]*+)'
_OUTSIDE = rf"{_FIELD}(?:,{_FIELD})*+"
_INSIDE = rf"{_QUOTED}[^,]*+(?:,{_FIELD})*+"
HEADER, RECORD, OPENED, CONTINUED = "header", "record", "opened", "continued"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind the line, if one is, or is not, open before it."""
    if '"' not in line:
        return inside
    return re.fullmatch(_INSIDE if inside else _OUTSIDE, line, re.DOTALL) is None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Stretches of a batch that lie in one split."""
    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        starts = [i for i in range(len(files)) if i == 0 or (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])]
        for start, end in zip(starts, [*starts[1:], len(files)]):
            yield (files[start], blocks[start]), batch.slice(start, end - start)


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, block, from_outside, from_inside)``: whether each split ends inside quotes."""
    ends: dict[tuple[str, int], list[bool]] = {}
    for split, part in _by_split(batches):
        state = ends.setdefault(split, [False, True])
        values = part.column(0)
        for line in values.filter(pa.compute.match_substring(values, '"')).to_pylist():
            state[0] = ends_inside(line, state[0])
            state[1] = ends_inside(line, state[1])
    rows = [{"file": f, "block": b, "from_outside": x, "from_inside": y} for (f, b), (x, y) in ends.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())]))


def split_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, inside)``: the proven state at the start of every split that holds the start of a line.

    A split either settles the state, leaves it, or turns it around.  So the state is that of the last split which
    settles it, turned around once for each split since that does.
    """
    ends = _lines(spark, path).mapInArrow(_split_ends, "file string, block bigint, from_outside boolean, from_inside boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    settles = F.col("from_outside") == F.col("from_inside")
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = ends.withColumn("turns", F.sum(turns).over(upto)).withColumn("settled", F.when(
        settles, F.struct(F.col("from_outside").cast("int").alias("state"), "turns")))
    last = F.last("settled", ignorenulls=True).over(before)
    seen = F.coalesce(F.last("turns").over(before), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + seen - F.coalesce(last["turns"], F.lit(0))
    return counted.select("file", "block", (state % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, block, kind, text)``: whole records, and the pieces of those that cross the split's ends."""
    split = kind = None
    held: list[str] = []
    inside = False
    out: list[tuple] = []

    def close(open_end: bool) -> None:
        nonlocal held, kind
        if held:
            text = "\n".join(held)
            out.append((*split, OPENED if open_end and kind in (HEADER, RECORD) else kind, kind == HEADER, text))
        held, kind = [], RECORD

    def batch_of() -> pa.RecordBatch:
        nonlocal out
        columns, out = list(zip(*out)) or [()] * 5, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
            pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()))], names=["file", "block", "kind", "is_header", "text"])

    for at, part in _by_split(batches):
        if at != split:
            if split is not None:
                close(inside)
            split, inside = at, part.column(3)[0].as_py()
            kind = CONTINUED if inside else HEADER if at[1] == 0 else RECORD
        lines = part.column(0).to_pylist()
        quoted = pa.compute.match_substring(part.column(0), '"').to_pylist()
        for line, has in zip(lines, quoted):
            if not inside and not line.strip("\r"):
                continue  # an empty line outside quotes is no record
            held.append(line)
            if has:
                inside = ends_inside(line, inside)
            if not inside:
                close(False)
        yield batch_of()
    if split is not None:
        close(inside)
        yield batch_of()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, is_header, record)``: every record as text, line breaks in quotes included, headers marked.

    The first record of a file is its header.  A file that ends inside quotes ends its last record there.
    What is broadcast has at most one row per split, that of splits which begin inside quotes.
    """
    inside = split_starts(spark, path).filter("inside")
    lines = _lines(spark, path).join(F.broadcast(inside), ["file", "block"], "left").select(
        "value", "file", "block", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = lines.mapInArrow(_cut, "file string, block bigint, kind string, is_header boolean, text string")
    whole = pieces.filter(F.col("kind").isin(HEADER, RECORD))
    crossing = pieces.filter(F.col("kind").isin(OPENED, CONTINUED))
    # A continued piece belongs to the last record that an earlier split has left open.
    order = Window.partitionBy("file").orderBy("block", F.col("kind").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = crossing.withColumn("owner", F.last(F.when(F.col("kind") == OPENED, F.col("block")), ignorenulls=True).over(order))
    joined = owned.groupBy("file", "owner").agg(
        F.bool_or("is_header").alias("is_header"),
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts")).select(
        "file", "is_header", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.select("file", "is_header", "text").union(joined).select(
        "file", "is_header", F.regexp_replace("text", r"\r$", "").alias("record"))


def column_names(header: str) -> list[str]:
    """Names in a header record; a name that is missing or repeated gets its place."""
    import csv
    import io

    found = next(csv.reader(io.StringIO(header.removeprefix("﻿"), newline="")), [])
    lowered = [n.lower() for n in found]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(found)]
