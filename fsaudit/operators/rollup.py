"""Roll-ups per partition and per directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.functions.paths import component, file_name, is_dir, rest_after
from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.sorting import SortMode
from fsaudit.schema import ROOT_PARTITION


def partition_summary(index: DataFrame, spec: FilterSpec = FilterSpec(), exact_floor: bool = False) -> DataFrame:
    """Size, latest access and files by partition, without the root partition; under a filter, of matching files, and only partitions with any.

    The filter goes below the aggregate, where it can reach the reader. ``exact_floor`` aggregates conditionally instead, over all files: the latest access
    of a partition that also has other files is then 0 at least."""
    df = index.filter((F.col("partition") != ROOT_PARTITION) & (F.col("partition") != ""))
    if exact_floor and spec.is_active:
        p = spec.predicate()
        one = lambda c: F.when(p, c).otherwise(F.lit(0))
        out = df.groupBy("partition").agg(F.sum(one(F.col("size"))).alias("total_size"), F.sum(one(F.lit(1))).alias("file_count"), F.max(one(F.col("atime"))).alias("latest_atime"))
        return out.filter("file_count > 0")
    return spec.apply(df).groupBy("partition").agg(F.sum("size").alias("total_size"), F.count("*").alias("file_count"), F.max("atime").alias("latest_atime"))


def root_files(index: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """The files directly under the top directory as listing rows."""
    df = spec.apply(index.filter(F.col("partition") == ROOT_PARTITION))
    return df.select(file_name(F.col("path")).alias("name"), "path", F.lit(False).alias("is_dir"), F.col("size").alias("total_size"), F.lit(1).cast("long").alias("file_count"), F.col("atime").alias("latest_atime"))


def partition_listing(index: DataFrame, spec: FilterSpec = FilterSpec(), sort: SortMode = SortMode.NAME) -> DataFrame:
    """Partitions and root files in one listing, in its order."""
    parts = partition_summary(index, spec).select(F.col("partition").alias("name"), F.col("partition").alias("path"), F.lit(True).alias("is_dir"), "total_size", "file_count", "latest_atime")
    return parts.unionByName(root_files(index, spec)).orderBy(*sort.directories(), "path")


def directory_rollup(index: DataFrame, prefix: str, spec: FilterSpec = FilterSpec(), partition: str | None = None) -> DataFrame:
    """Size, files and latest access of each entry directly under ``prefix`` (a directory, with its slash at the end)."""
    if not prefix.endswith("/"):
        prefix += "/"
    df = index if partition is None else index.filter(F.col("partition") == partition)
    rest = rest_after(F.col("path"), prefix)
    df = spec.apply(df.filter(F.col("path").startswith(prefix))).select("size", "atime", component(rest).alias("name"), is_dir(rest).alias("is_dir"))
    out = df.filter("name <> ''").groupBy("name").agg(F.bool_or("is_dir").alias("is_dir"), F.sum("size").alias("total_size"), F.count("*").alias("file_count"), F.max("atime").alias("latest_atime"))
    return out.select("name", F.concat(F.lit(prefix), "name").alias("path"), "is_dir", "total_size", "file_count", "latest_atime")


def directory_listing(index: DataFrame, prefix: str, spec: FilterSpec = FilterSpec(), partition: str | None = None, sort: SortMode = SortMode.NAME) -> DataFrame:
    return directory_rollup(index, prefix, spec, partition).orderBy(*sort.directories())


def partition_root(index: DataFrame, partition: str, mode: str = "common") -> DataFrame:
    """``root``: the directory that holds a partition's files, whatever the filter. "common": the longest directory that all paths lie
    under, found from the least and the greatest of the paths; "shortest": that of the shortest path, of several the least, which can miss siblings."""
    df = index.filter(F.col("partition") == partition)
    if mode == "shortest":
        path = F.min_by("path", F.struct(F.length("path"), "path"))
        return df.agg(path.alias("p")).select(F.regexp_extract("p", "^(.*)/[^/]*$", 1).alias("root"))
    # What the least and the greatest path share, all share.
    ends = df.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    n = F.least(F.size(a), F.size(b)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k))
    agreed = F.size(F.filter(same, lambda x: x))
    return ends.filter("a IS NOT NULL").select(F.array_join(F.slice(a, 1, F.least(agreed, n)), "/").alias("root"))
