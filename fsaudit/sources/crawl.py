"""The live file system as a Spark data source, and the crawl that makes an index of it.

The unit of work is a directory, with what is below it or only its own files. Directories are split level by level, listed by ``THREADS`` threads at once, until there are ``UNITS`` units for
each of the ``tasks`` tasks or nothing is left to split, so that one large partition, however deep, is shared by all tasks; ``split_depth`` fixes the levels instead. Executors must see the file system.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fsaudit.functions.paths import safe_text
from fsaudit.functions.sizes import SizeMode, format_bytes, format_speed
from fsaudit.schema import ROOT_PARTITION
from fsaudit.sources.index import ROWS_PER_FILE, is_packed, partition_names, read_index, replace_partitions

NAME = "fsmeta"
_SCHEMA = pa.schema([("path", pa.string()), ("disk", pa.int64()), ("length", pa.int64()), ("atime", pa.int64()), ("partition", pa.string())])
_ROWS = 10_000
THREADS, UNITS = 64, 4


@dataclass
class WorkItem(InputPartition):
    """(directory, its partition, whether to go down) of each unit of a task."""

    units: list[tuple[bytes, str, bool]]


def _entries(path: bytes) -> list[os.DirEntry]:
    """Sorted entries; none if the directory can't be read."""
    try:
        with os.scandir(path) as it:
            return sorted(it, key=lambda e: e.name)
    except OSError:
        return []


def _is_dir(e: os.DirEntry) -> bool:
    try:
        return e.is_dir(follow_symlinks=False)
    except OSError:
        return False


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.top = os.fsencode(os.path.realpath(options["path"]))
        self.only = [x.strip() for x in options.get("partitions", "").split(",") if x.strip()]
        self.root = options.get("root", "true").lower() == "true"
        self.skip = os.fsencode(os.path.realpath(options["skip"])) if options.get("skip") else b""
        self.depth, self.tasks = int(options.get("split_depth", -1)), int(options.get("tasks", 1024))

    def partitions(self) -> list[WorkItem]:
        if not os.path.isdir(self.top):
            raise ValueError(f"Not a directory: {safe_text(self.top)}")
        entries = _entries(self.top)
        dirs = {safe_text(e.name): e.path for e in entries if _is_dir(e) and e.path != self.skip}
        for name in self.only:
            if name not in dirs:
                raise ValueError(f"Partition '{name}' not found in {safe_text(self.top)}")
        loose = any(not _is_dir(e) for e in entries)
        if not dirs and not loose:
            raise ValueError(f"No partitions found in {safe_text(self.top)}")
        units: list[tuple[bytes, str, bool]] = [(self.top, ROOT_PARTITION, False)] if loose and self.root else []
        level, depth = [(dirs[name], name) for name in sorted(self.only or dirs)], 0
        with ThreadPoolExecutor(THREADS) as pool:
            while level and (depth < self.depth if self.depth >= 0 else len(units) + len(level) < UNITS * self.tasks):
                below = pool.map(lambda d: [e.path for e in _entries(d[0]) if _is_dir(e) and e.path != self.skip], level)
                units += [(d, name, False) for d, name in level]
                level = [(x, name) for (_, name), xs in zip(level, below) for x in xs]
                depth += 1
        units += [(d, name, True) for d, name in level]
        n = max(1, min(self.tasks, len(units)))
        return [WorkItem(units[k::n]) for k in range(n)]

    def read(self, item: WorkItem) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path, partition, down in item.units:
            for row in self._walk(path, partition, down):
                rows.append(row)
                if len(rows) >= _ROWS:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    def _walk(self, path: bytes, partition: str, down: bool) -> Iterator[tuple]:
        """Regular files, hidden ones too; links are not followed; what can't be read is left out."""
        stack = [path]
        while stack:
            for e in _entries(stack.pop()):
                try:
                    if e.is_dir(follow_symlinks=False):
                        if down and e.path != self.skip:
                            stack.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield safe_text(e.path), s.st_blocks * 512, s.st_size, int(s.st_atime // 1), partition
                except OSError:
                    continue


class CrawlSource(DataSource):
    """Options: path, partitions (a,b), root (whether loose files are read), skip (a directory that is left out), split_depth (by need if not given), tasks."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, disk bigint, length bigint, atime bigint, partition string"

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(self.options)


def crawl(spark: SparkSession, top: str, mode: SizeMode = SizeMode(), partitions: list[str] | None = None, skip: str | None = None, **options: object) -> DataFrame:
    """path, size, atime, partition of the files under a directory."""
    spark.dataSource.register(CrawlSource)
    r = spark.read.format(NAME).option("path", top).options(**{k: str(v) for k, v in options.items()})
    if partitions:
        r = r.option("partitions", ",".join(partitions))
    if skip:
        r = r.option("skip", skip)
    return r.load().select("path", mode.calculate(F.col("disk"), F.col("length")).cast("long").alias("size"), "atime", "partition")


@dataclass(frozen=True)
class CrawlStats:
    files: int
    bytes: int
    seconds: float
    pruned: int
    #: Files and bytes of each partition that was crawled and has any, and the chunks pruned by partition.
    by_partition: DataFrame = field(repr=False)
    pruned_by: dict[str, int] = field(repr=False, default_factory=dict)

    def __str__(self) -> str:
        tail = f", pruned {self.pruned} stale" if self.pruned else ""
        return f"Completed {self.files} files ({format_bytes(self.bytes)}) in {self.seconds:.1f} s{tail}"

    def progress(self) -> Iterator[str]:
        """A line for each partition, and the speed of the whole crawl."""
        gone = dict(self.pruned_by)
        tail = lambda k: f", pruned {k} stale" if k else ""
        for r in self.by_partition.orderBy("partition").toLocalIterator():
            yield f"Finished {r.partition} ({r.files} files, {format_bytes(r.bytes)}{tail(gone.pop(r.partition, 0))})"
        for name in sorted(gone):
            yield f"Finished {name} (0 files, 0 B{tail(gone[name])})"
        yield format_speed(self.files / max(self.seconds, 1e-9))


def index_tree(spark: SparkSession, top: str, out: str, mode: SizeMode = SizeMode(), partitions: list[str] | None = None, rows_per_file: int = ROWS_PER_FILE, **options: object) -> CrawlStats:
    """Crawl a directory into an index. Given partitions, only they (and loose files, unless root=False) are replaced. What was crawled and has no files any more leaves the index."""
    began, root = time.time(), str(options.get("root", True)).lower() == "true"
    loose = [ROOT_PARTITION] if root else []
    # Without a choice all partitions of the index were crawled, those whose directory is gone among them.
    crawled = [*(partition_names(spark, out) - {ROOT_PARTITION} if partitions is None else partitions), *loose]
    pruned = replace_partitions(crawl(spark, top, mode, partitions, skip=out, **options), out, crawled, rows_per_file, len(partitions) if partitions else sum(e.is_dir(follow_symlinks=False) for e in _entries(top)))
    # What was crawled and is there now, from the size column alone.
    index = read_index(spark, out, layout="packed" if is_packed(spark, out) else "native")
    fresh = index.filter(F.col("partition").isin(crawled)) if partitions is not None else index if root else index.filter(F.col("partition") != ROOT_PARTITION)
    total = fresh.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    figures = fresh.groupBy("partition").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return CrawlStats(total.files, total.bytes, time.time() - began, sum(pruned.values()), figures, pruned)
