"""Listings, counts and top partitions of an index (path, size, atime, partition), and their text forms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fsaudit.operators.filters import FilterSpec

FORMATS = ("path", "size", "atime", "csv", "json")
_COLUMNS = {"path": ["path"], "size": ["size", "path"], "atime": ["atime", "path"], "csv": ["path", "size", "atime"], "json": ["path", "size", "atime"]}


def in_partition(index: DataFrame, partition: str | None) -> DataFrame:
    """One partition by its exact name: a partition filter on the native layout."""
    return index if partition is None else index.filter(F.col("partition") == partition)


def find(index: DataFrame, spec: FilterSpec = FilterSpec(), partition: str | None = None, fmt: str = "path", limit: int | None = None) -> DataFrame:
    """The columns of a format. size lists the largest first and atime the oldest first, ties by path and the other column; others are unordered, so their limit takes any rows."""
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format: {fmt}. Valid: {', '.join(FORMATS)}")
    df = spec.apply(in_partition(index, partition))
    if fmt == "size":
        df = df.orderBy(F.desc("size"), "path", "atime")
    elif fmt == "atime":
        df = df.orderBy("atime", "path", "size")
    df = df.select(*_COLUMNS[fmt])
    return df if limit is None else df.limit(limit)


def count(index: DataFrame, spec: FilterSpec = FilterSpec(), partition: str | None = None) -> DataFrame:
    return spec.apply(in_partition(index, partition)).agg(F.count("*").alias("file_count"))


def top_partitions(index: DataFrame, n: int, spec: FilterSpec = FilterSpec(), partition: str | None = None) -> DataFrame:
    """The partitions with most matching files, the root partition among them."""
    df = spec.apply(in_partition(index, partition)).groupBy("partition").agg(F.count("*").alias("file_count"))
    return df.orderBy(F.desc("file_count"), "partition").limit(n)


def csv_line() -> Column:
    """A path is quoted only if it has a comma or a quote."""
    path = F.col("path")
    quoted = F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", F.when(path.rlike('[,"]'), quoted).otherwise(path), F.col("size"), F.col("atime"))


def json_line() -> Column:
    path = F.col("path")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        path = F.replace(path, F.lit(a), F.lit(b))
    return F.concat(F.lit('{"path":"'), path, F.lit('","size":'), F.col("size").cast("string"), F.lit(',"atime":'), F.col("atime").cast("string"), F.lit("}"))


def lines(listing: DataFrame, fmt: str) -> DataFrame:
    """A listing as one text column ``value``: what .write.text stores."""
    if fmt == "csv":
        return listing.select(csv_line().alias("value"))
    if fmt == "json":
        return listing.select(json_line().alias("value"))
    return listing.select(F.concat_ws("\t", *_COLUMNS[fmt]).alias("value"))


def render(listing: DataFrame, fmt: str) -> Iterator[str]:
    """Lines for a terminal, streamed partition by partition."""
    rows = (r.value for r in lines(listing, fmt).toLocalIterator(prefetchPartitions=True))
    if fmt == "csv":
        yield "path,size,atime"
    if fmt == "json":
        yield "["
        held = None
        for x in rows:
            if held is not None:
                yield f"  {held},"
            held = x
        if held is not None:
            yield f"  {held}"
        yield "]"
    else:
        yield from rows


def run(index: DataFrame, spec: FilterSpec, partition: str | None = None, fmt: str = "path", limit: int | None = None, count_only: bool = False, top: int | None = None) -> Iterator[str]:
    """What the command prints: top before count before format."""
    if top is not None:
        yield from (r.partition for r in top_partitions(index, top, spec, partition).collect())
    elif count_only:
        yield str(count(index, spec, partition).first()[0])
    else:
        yield from render(find(index, spec, partition, fmt, limit), fmt)
