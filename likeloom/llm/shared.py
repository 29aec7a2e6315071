"""What the corpus operators have in common: tables in the shared folder, Arrow passes, packing."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import release, store_of, workspace

# Workers get these functions by value, so they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

__all__ = ["Table", "arrow_pass", "blocks", "packed", "release", "shuffle_width", "stage", "texts_of", "unpacked", "unused", "workspace"]

#: Documents are worked on in blocks of about this many bytes, however many rows an Arrow batch has.
BLOCK_BYTES = 4 << 20


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Table:
    """df written once to the shared folder: cuts lineage, survives lost executors.

    The shuffle files of the write go as soon as the table is there; the table itself when the
    application ends, or with drop(). by: columns that the table has folders for.
    """

    def __init__(self, df: DataFrame, label: str, by: tuple[str, ...] = ()):
        self.spark, self.by = df.sparkSession, by
        self.path, before = workspace(self.spark, label), self.spark.conf.get(FREE_SHUFFLES)
        self.schema = T.StructType([f for f in df.schema.fields if f.name not in by])
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").partitionBy(*by).parquet(self.path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)

    def folder(self, *values: int) -> str:
        return "/".join([self.path, *(f"{name}={value}" for name, value in zip(self.by, values, strict=False))])

    def read(self, *values: int) -> DataFrame:
        """The rows whose first `by` columns have these values, without the `by` columns."""
        store, at = store_of(self.spark, self.folder(*values))
        if not store.exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder(*values))

    def drop(self, *values: int) -> None:
        release(self.spark, self.folder(*values))


def stage(df: DataFrame, label: str) -> DataFrame:
    """df as a Table, read back."""
    return Table(df, label).read()


def arrow_pass(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """Runs work on each Arrow batch, one output stream; work must not need other batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about `most`; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit deal by key: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until neither they nor what starts with them are columns of df."""
    taken, out = [c.lower() for c in df.columns], []
    for name in names:
        while any(c.startswith(name.lower()) for c in taken):
            name += "_"
        out.append(name)
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one fixed dtype list as one byte string; see unpacked()."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], dtype="<u4").tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of packed(), whose dtypes are kinds."""
    lengths = np.frombuffer(blob, dtype="<u4", count=len(kinds) + 1)[1:]
    at, out = 4 * (len(kinds) + 1), []
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out
