"""Shared plumbing of the operators: row identity, Arrow batches, the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, since a row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back: Python workers stay for later stages, and what they hold on to counts for the executor."""
    pa.default_memory_pool().release_unused()
    if trim_ := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim_(0)


def collect(spark: SparkSession) -> None:
    """Let the driver's JVM find what is not referenced any more: Spark's cleaner then deletes the shuffles of finished steps, which else stay on disk until the next collection."""
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, with ``trim`` at the end of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def rid(*cols: str) -> Column:
    """Identity of a row from its content: repeated rows share it, nulls are allowed."""
    return F.xxhash64(*[F.col(c) for c in cols])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, that all executors see; one is set where none is, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # Only a local session has no such setting: its driver is its one executor.
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = f"file://{tempfile.gettempdir()}/spark-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end; what is returned from there must be ``keep``-ed before."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            drop_folder(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read from there: a lost executor costs no recomputation of what came before, and the plans that follow know the true size. (A checkpoint
    carries the estimate of its plan along, which grows with every join of a loop.)"""
    path = own_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: a result that outlives the tables of its scope."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def own_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_path(folder: str) -> str:
    """The path of a file: folder; other file systems need a mount."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"{folder}: mount the shared folder and give it as file://")
    return folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")


def set_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    k = batch.schema.get_field_index(name)
    return batch if k < 0 else batch.set_column(k, batch.schema.field(k), values.cast(batch.schema.field(k).type))


def same_columns(docs: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply f to the Arrow batches of a table whose columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return mapped(docs, run, docs.schema)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by key, cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.asarray(b["key"])
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        elif held and held[-1]["key"][0] != b["key"][0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
