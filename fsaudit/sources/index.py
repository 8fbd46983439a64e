"""The index on disk: native layout <index>/partition=<name>/part-*.parquet, packed layout <index>/buckets=<n>/bucket=<k>/part-*.parquet, and a reader of the bare layout <index>/<name>/*.parquet.

A directory and a file cost milliseconds each to make, to list and to open, however few rows they hold. So a new index of more than ``PACKED`` partitions is packed: a bucket, by hash of the partition's name, holds about ``PACKED`` of them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fsaudit.functions.paths import partition_of_file
from fsaudit.schema import SCHEMA, SCHEMA_B, SCHEMA_P

ROWS_PER_FILE = 100_000
PACKED = 256
#: Tasks that list directories; each costs tens of milliseconds, a directory much less.
LISTERS = 32


def write_index(files: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, full: bool = False, layout: str | None = None, count: int | None = None) -> None:
    """Write (path, size, atime, partition). Partitions that occur are replaced, others stay; ``full`` replaces the whole index. An index keeps its layout; a new one
    is native or packed, by its number of partitions if no ``layout`` is given: ``count`` if that is known, else they are counted, which takes a look at all rows more.

    Files become visible by the commit of the job; rows are placed by partition (by bucket, if packed), a large one in as many tasks as its bytes ask for and small ones together in one, as adaptive
    execution sees them in the shuffle. They are sorted by path inside it, which is what makes paths compress and prefixes prune."""
    spark, path = files.sparkSession, path.rstrip("/")
    buckets = None if full else _buckets(spark, path)
    if buckets:
        replace_partitions(files, path, [], rows_per_file)
    elif full or not _globbed(spark, f"{path}/partition=*"):
        _overwrite(files, path, rows_per_file, "static" if full else "dynamic", _buckets_of(files, layout, count))
    else:
        _overwrite(files, path, rows_per_file, "dynamic", None)


def _buckets_of(files: DataFrame, layout: str | None, count: int | None) -> int | None:
    if layout == "native":
        return None
    n = count if count is not None else files.agg(F.approx_count_distinct("partition")).first()[0]
    return max(1, -(-n // PACKED)) if n > PACKED or layout == "packed" else None


def _overwrite(files: DataFrame, path: str, rows_per_file: int, mode: str, buckets: int | None) -> None:
    placed, by = files.select("path", "size", "atime", "partition"), ["partition"]
    if buckets:
        by = ["buckets", "bucket"]
        placed = placed.withColumns({"buckets": F.lit(buckets), "bucket": (F.crc32(F.col("partition").cast("binary")) % buckets).cast("int")})
    placed = placed.hint("rebalance", by[-1]).sortWithinPartitions(*dict.fromkeys([by[-1], "partition", "path"]))
    w = placed.write.mode("overwrite").option("partitionOverwriteMode", mode).option("maxRecordsPerFile", rows_per_file).option("compression", "snappy")
    w.partitionBy(*by).parquet(path)


def _globbed(spark: SparkSession, pattern: str) -> list:
    """File statuses."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    try:
        return list(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or [])
    except Py4JJavaError:
        return []


def _buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets a packed index has."""
    found = _globbed(spark, f"{path.rstrip('/')}/buckets=*")
    return int(found[0].getPath().getName().partition("=")[2]) if found else None


def is_packed(spark: SparkSession, path: str) -> bool:
    return _buckets(spark, path) is not None


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.conf.set(key, min(int(old), LISTERS))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _chunks(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """Parquet files by partition; one whose directory is empty has none."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, set[str]] = {}
    for d in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/partition=*")) or []:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(d.getPath().getName().partition("=")[2])
        found[name] = {f.getPath().getName() for f in fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet")}
    return found


def partition_names(spark: SparkSession, path: str) -> set[str]:
    """The partitions of a native or packed index."""
    if _buckets(spark, path):
        return {r.partition for r in read_index(spark, path).select("partition").distinct().toLocalIterator()}
    return set(_chunks(spark, path))


def replace_partitions(files: DataFrame, path: str, partitions: Iterable[str], rows_per_file: int = ROWS_PER_FILE, count: int | None = None) -> dict[str, int]:
    """Write files into an index; partitions of those named that have none any more are deleted. How many chunks each partition has less."""
    spark = files.sparkSession
    if buckets := _buckets(spark, path):
        return _replace_packed(files, path.rstrip("/"), set(partitions), rows_per_file, buckets)
    before = _chunks(spark, path)
    write_index(files, path, rows_per_file, count=count)
    after, pruned = _chunks(spark, path), {}
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in before:
        # New files have new names: a partition with its old ones wasn't written.
        left = after.get(name, set())
        if left == before[name] and name in set(partitions):
            p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/partition={escape(name)}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            left = set()
        if len(left) < len(before[name]):
            pruned[name] = len(before[name]) - len(left)
    return pruned


def _replace_packed(files: DataFrame, path: str, named: set[str], rows_per_file: int, buckets: int) -> dict[str, int]:
    """Of the buckets that hold partitions which are written or named, all rows are written again. A chunk is ``rows_per_file`` rows of a partition."""
    spark = files.sparkSession
    files = files.select("path", "size", "atime", "partition")
    # The new rows aside first: they may come from this very index, and are needed more than once.
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    try:
        files.write.parquet(aside)
        new = spark.read.schema(SCHEMA_P).parquet(aside)
        written = new.select("partition").distinct()
        if named:
            written = written.union(spark.createDataFrame([(n,) for n in sorted(named)], "partition string")).distinct()
        touched = {r[0] for r in written.select((F.crc32(F.col("partition").cast("binary")) % buckets).cast("int")).distinct().collect()}
        if not touched:
            return {}
        old = _packed(spark, path).filter(F.col("bucket").isin(touched)).drop("buckets", "bucket")
        left = old.join(written, "partition", "left_anti").select(new.columns)
        chunks = lambda df, c: df.groupBy("partition").agg(F.ceil(F.count("*") / rows_per_file).alias(c))
        less = chunks(old.join(written, "partition", "left_semi"), "a").join(chunks(new, "b"), "partition", "left").select("partition", (F.col("a") - F.coalesce("b", F.lit(0))).alias("less"))
        pruned = {r.partition: r.less for r in less.filter("less > 0").toLocalIterator()}
        # Spark doesn't overwrite what it reads, and a bucket without any rows is not written.
        whole = f"{path}/_whole-{uuid.uuid4().hex}"
        try:
            left.union(new).write.parquet(whole)
            rows = spark.read.schema(SCHEMA_P).parquet(whole)
            stay = {r[0] for r in rows.select((F.crc32(F.col("partition").cast("binary")) % buckets).cast("int")).distinct().collect()}
            _overwrite(rows, path, rows_per_file, "dynamic", buckets)
        finally:
            _delete(spark, whole)
        for k in touched - stay:
            _delete(spark, f"{path}/buckets={buckets}/bucket={k}")
        return pruned
    finally:
        _delete(spark, aside)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def to_bare(spark: SparkSession, path: str) -> None:
    """Turn a native index into the bare layout, directory by directory."""
    jvm = spark.sparkContext._jvm
    for name in partition_names(spark, path):
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{x}") for x in (f"partition={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}", name))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new)


def escape_glob(name: str) -> str:
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in name)


def _layout(spark: SparkSession, path: str) -> str:
    return "native" if _globbed(spark, f"{path}/partition=*") else "packed" if _globbed(spark, f"{path}/buckets=*") else "bare"


def _packed(spark: SparkSession, path: str) -> DataFrame:
    with _few_listers(spark):
        return spark.read.schema(SCHEMA_B).option("pathGlobFilter", "*.parquet").parquet(path)


def read_index(spark: SparkSession, path: str, partition: str | None = None, layout: str | None = None) -> DataFrame:
    """path, size, atime, partition. One partition is a partition filter on the native layout, one on its bucket and a pushed filter on the packed one, and a narrower glob on the bare one. Only *.parquet is read, so unfinished files are not."""
    path = path.rstrip("/")
    layout = layout or _layout(spark, path)
    if layout == "packed":
        df = _packed(spark, path)
        if partition is not None:
            df = df.filter((F.col("bucket") == zlib.crc32(partition.encode()) % _buckets(spark, path)) & (F.col("partition") == partition))
        return df.select(SCHEMA_P.names)
    if layout == "native":
        with _few_listers(spark):
            df = spark.read.schema(SCHEMA_P).option("pathGlobFilter", "*.parquet").parquet(path)
        return df if partition is None else df.filter(F.col("partition") == partition)
    # A glob of two levels, as a recursive read would skip names that begin with an underscore.
    glob = f"{path}/{'*' if partition is None else escape_glob(partition)}/*.parquet"
    df = spark.read.schema(SCHEMA).parquet(glob)
    return df.withColumn("partition", partition_of_file(F.col("_metadata.file_path")))


def read_root(spark: SparkSession, path: str) -> DataFrame:
    """The root partition; empty if the index has none."""
    from pyspark.errors import AnalysisException

    from fsaudit.schema import ROOT_PARTITION

    try:
        return read_index(spark, path, ROOT_PARTITION)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA_P)
