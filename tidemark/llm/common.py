"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names (shared by driver and
executors), so a lost executor costs a re-read and never a lost result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Fixed value: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which the worker, which serves later tasks too, gives free memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library than glibc
                pass

    return wrapped


class Scratch:
    """Parquet tables in the shared checkpoint folder; ``drop`` frees one as soon as it is spent."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:  # only in local sessions such as tests: a cluster names its folder
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tidemark-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.load(name, df.schema)

    def load(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str | None = None) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root if name is None else f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int, chars: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and text bytes (a single longer text is a part of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    start, held = 0, 0
    for i, n in enumerate(size.to_pylist()):
        if i > start and (held + n > chars or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def each_slice(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int, chars: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """``work`` on every slice of the batches, without what it gives as None. What one slice needed is gone before its
    result is handed on, and a batch before the next is read, so two never stand side by side."""
    for batch in batches:
        yield from (out for out in map(work, slices(batch, rows, chars, column)) if out is not None)
        del batch


def per_text(
    make: Callable[[], Callable[[list], dict[str, list]]], schema: pa.Schema, rows: int = 4096, chars: int = 4 << 20
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over (id, text): ``make()`` runs once a task, its result on slices of
    bounded size, so memory does not follow the Arrow batch. Null texts come as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, rows, chars):
                out = work([t or "" for t in part.column(1).to_pylist()])
                cols = [pa.array(out[f.name], f.type) if f.name in out else part.column(0).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def resolved(path: str | Callable[[], str]) -> str:
    """The path of a vocabulary file; a function is asked where it is called, so each worker finds its own copy."""
    return path() if callable(path) else path


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def spans(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)
