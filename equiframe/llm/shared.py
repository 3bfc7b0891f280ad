"""What the operators of this subpackage share: table access, row keys, safe joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiframe.functions.scale import shared_path

# White space as the operators' contracts define it: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = SPACES) -> Column:
    """Non-empty pieces between runs of ``separators``; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null has a key of its own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while the frame has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each part hold about ``most_bytes`` (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            if held and held + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


class Stored:
    """A frame written to the folder in ``spark.checkpoint.dir``, so that its lineage ends there.

    ``release`` of the library deletes what is left when its readers are done.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.frame = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
