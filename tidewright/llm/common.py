"""Shared helpers: batch-wise Arrow maps, scratch tables and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.joins import SALTS, join_dealt  # noqa: F401
from tidewright.session import clear_scratch, scratch_folder, share_package  # noqa: F401

#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a blank.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def alnum_words(raw: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return raw.translate(ALNUM).split()


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `size` bytes of the column; a longer text is a part of its own."""
    first, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if k > first and (k - first >= rows or held + (n or 0) > size):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a per-task set-up: make() runs once in each task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield from each(batch)

    share_package(df.sparkSession)
    return df.mapInArrow(run, schema)


class Scratch:
    """Written tables of one operator call, in the shared folder. Each cuts lineage, so a lost executor costs one read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        share_package(spark)
        self.root = scratch_folder(spark, name)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, table: str) -> None:
        self._delete(self.path(table))

    def clear(self) -> None:
        self._delete(self.root)
