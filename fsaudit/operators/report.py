"""Stale-data reports and usage totals."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.functions.paths import user_of
from fsaudit.functions.sizes import format_bytes
from fsaudit.operators.filters import FilterSpec
from fsaudit.schema import DAY

STALE_DAYS = 60


def stale_report(index: DataFrame, now: int, days: int = STALE_DAYS) -> DataFrame:
    """Files not accessed for so many days, by partition: all partitions in one job; those without any are left out."""
    df = FilterSpec(older_than=now - days * DAY).apply(index)
    return df.groupBy("partition").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def write_reports(index: DataFrame, folder: str, now: int, days: int = STALE_DAYS) -> list[str]:
    """One text file per partition with stale files; their paths. The rows are one per partition."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in stale_report(index, now, days).orderBy("partition").toLocalIterator():
        name = os.path.join(folder, f"{r.partition}.txt")
        with open(name, "w", encoding="utf-8") as f:
            f.write(f"Stale data in partition {r.partition}\nGenerated: {time.strftime('%Y-%m-%d %H:%M:%S', time.gmtime(now))} UTC\nNot accessed for over: {days} days\n\n")
            f.write(f"File count: {r.file_count}\nTotal size: {format_bytes(r.total_size)} ({r.total_size} bytes)\n")
        out.append(name)
    return out


def usage_by_user(index: DataFrame) -> DataFrame:
    """Bytes of each user's files under /home, the largest first."""
    df = index.withColumn("user", user_of(F.col("path"))).filter("user <> ''")
    return df.groupBy("user").agg(F.sum("size").alias("total_size"), (F.sum("size") / 1e12).alias("tb")).orderBy(F.desc("total_size"), "user")


def largest_stale_files(index: DataFrame, now: int, days: int = 180, limit: int = 100) -> DataFrame:
    df = FilterSpec(older_than=now - days * DAY).apply(index).select("path", "size", "atime")
    return df.orderBy(F.desc("size"), "path", "atime").limit(limit)


def partition_total(index: DataFrame, partition: str) -> DataFrame:
    return index.filter(F.col("partition") == partition).agg(F.sum("size").alias("total_size"), (F.sum("size") / 1e9).alias("gb"))
