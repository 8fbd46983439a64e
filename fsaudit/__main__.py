"""python -m fsaudit index|find|view|rm|report: the options of the command line."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from fsaudit.functions.sizes import SizeMode
from fsaudit.operators import find, purge, report
from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.sorting import SortMode
from fsaudit.plans.explorer import Explorer, render_listing
from fsaudit.sources.crawl import index_tree
from fsaudit.sources.index import read_index


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fsaudit")
    sub = p.add_subparsers(dest="tool", required=True)
    query = argparse.ArgumentParser(add_help=False)
    query.add_argument("-i", "--index", default=os.environ.get("FSAUDIT_INDEX"))
    query.add_argument("-u", "--partition")
    query.add_argument("-p", "--pattern")
    query.add_argument("--min-size")
    query.add_argument("--max-size")
    query.add_argument("--older-than", type=int, metavar="DAYS")
    query.add_argument("--newer-than", type=int, metavar="DAYS")
    x = sub.add_parser("index")
    x.add_argument("dir")
    x.add_argument("-o", "--outdir", required=True)
    x.add_argument("-j", "--jobs", type=int, default=int(os.environ.get("FSAUDIT_JOBS", 4)))
    x.add_argument("-B", "--buffsize", type=int, default=100_000)
    x.add_argument("--apparent-size", action="store_true")
    x.add_argument("-k", "--block-size")
    x.add_argument("-v", "--verbose", action="store_true", help="a line for each partition")
    x.add_argument("-p", "--partition", type=lambda s: [y.strip() for y in s.split(",") if y.strip()])
    x = sub.add_parser("find", parents=[query])
    x.add_argument("-f", "--format", default="path")
    x.add_argument("-l", "--limit", type=int)
    x.add_argument("-c", "--count", action="store_true")
    x.add_argument("--top", type=int)
    x = sub.add_parser("view", parents=[query])
    x.add_argument("-s", "--sort", type=SortMode.parse, default=SortMode.NAME)
    x.add_argument("-t", "--tree", action="store_true", help="a column for every level")
    x.add_argument("path", nargs="*", help="names to enter, one level each")
    x = sub.add_parser("rm", parents=[query])
    x.add_argument("-l", "--limit", type=int)
    x.add_argument("-n", "--dry-run", action="store_true")
    x.add_argument("--safe", action="store_true")
    x.add_argument("-f", "--force", action="store_true")
    x.add_argument("-v", "--verbose", action="store_true")
    x.add_argument("-j", "--jobs", type=int, default=4)
    x = sub.add_parser("report")
    x.add_argument("-i", "--index", required=True)
    x.add_argument("-o", "--outdir")
    x.add_argument("--days", type=int, default=report.STALE_DAYS)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: int | None = None) -> int:
    a = parser().parse_args(argv)
    if a.tool != "index" and not a.index:
        parser().error("an index is needed: -i or FSAUDIT_INDEX")
    now = int(time.time()) if now is None else now
    spark = spark or SparkSession.builder.appName("fsaudit").getOrCreate()
    if a.tool == "index":
        stats = index_tree(spark, a.dir, a.outdir, SizeMode.choose(a.apparent_size, a.block_size), a.partition, a.buffsize, tasks=max(1, a.jobs) * 64)
        for line in stats.progress() if a.verbose else ():
            print(line)
        print(stats)
        return 0
    index = read_index(spark, a.index, getattr(a, "partition", None))
    if a.tool == "report":
        for name in report.write_reports(index, a.outdir or os.path.join(a.index, ".stale"), now, a.days):
            print(name)
        return 0
    spec = FilterSpec.of(now, a.pattern, a.min_size, a.max_size, a.older_than, a.newer_than)
    if a.tool == "find":
        out = find.run(index, spec, a.partition, a.format, a.limit, a.count, a.top)
    elif a.tool == "rm":
        out = purge.run(index, spec, a.partition, a.limit, a.dry_run, a.safe, a.force, a.verbose, a.jobs)
    else:
        e = Explorer(index, spec, a.sort)
        for name in [*([a.partition] if a.partition else []), *a.path]:
            e = e.enter(name)
        e = e.toggled() if a.tree else e
        out = [line for title, listing in e.view() for line in [*([f"{title}:"] if a.tree else []), *render_listing(listing, now)]]
    for line in out:
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
