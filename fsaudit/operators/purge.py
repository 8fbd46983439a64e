"""Deletion of the files that a query selects, with an optional check against the live file system.

The executors must see the file system. Outcomes are materialised exactly once: a second action on the lazy frame would find the files gone.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.find import in_partition

OUTCOME = "path string, status string, detail string"
STATUSES = ("deleted", "missing", "skipped", "failed")


def candidates(index: DataFrame, spec: FilterSpec, partition: str | None = None, limit: int | None = None, order_by: list | None = None) -> DataFrame:
    """What would be deleted. Without an order a limit takes any of the files."""
    df = spec.apply(in_partition(index, partition)).select("path", "size", "atime")
    if order_by:
        df = df.orderBy(*order_by)
    return df if limit is None else df.limit(limit)


def outcome(path: str, safe: bool, older_than: int | None, max_size: int | None) -> tuple[str, str]:
    """Delete one file; (status, detail)."""
    name = os.fsencode(path)
    if safe:
        try:
            s = os.stat(name)
        except FileNotFoundError:
            return "missing", f"SKIP (not found): {path}"
        except OSError as e:
            return "failed", f"FAIL (stat error): {path}: {e}"
        if older_than is not None and int(s.st_atime) >= older_than:
            return "skipped", f"SKIP (accessed since index): {path}"
        if max_size is not None and s.st_size > max_size:
            return "skipped", f"SKIP (size changed): {path}"
    try:
        os.remove(name)
    except FileNotFoundError:
        return "missing", f"SKIP (not found): {path}"
    except OSError as e:
        return "failed", f"FAIL: {path}: {e}"
    return "deleted", f"DELETE: {path}"


def purge(files: DataFrame, confirm: bool, safe: bool = False, spec: FilterSpec = FilterSpec(), jobs: int = 4) -> DataFrame:
    """Delete the files; (path, status, detail) of each, held in memory or on disk. Nothing happens unless ``confirm`` is true."""
    if not confirm:
        raise PermissionError("purge needs confirm=True")

    def run(frames):
        for f in frames:
            rows = [outcome(p, safe, spec.older_than, spec.max_size) for p in f["path"]]
            yield pd.DataFrame({"path": f["path"].tolist(), "status": [r[0] for r in rows], "detail": [r[1] for r in rows]})

    spark = files.sparkSession
    if spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise RuntimeError("switch spark.speculation off: two tasks must not delete the same files")
    done = files.select("path").repartition(jobs).mapInPandas(run, OUTCOME)
    if not spark.sparkContext.getCheckpointDir():
        # A session with one process has no executor to lose.
        return spark.createDataFrame(done.toArrow().to_pandas(), OUTCOME) if spark.sparkContext.master.startswith("local") else _refuse()
    return done.checkpoint()


def _refuse() -> DataFrame:
    raise ValueError("set spark.checkpoint.dir: outcomes must survive a lost executor, or their files would be deleted again")


def counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def summary(outcomes: DataFrame) -> list[str]:
    """Deleted always; missing, skipped and failed if there are any."""
    n = {r.status: r.n for r in counts(outcomes).collect()}
    names = {"missing": "Missing", "skipped": "Skipped (safe mode)", "failed": "Failed"}
    return [f"Deleted: {n.get('deleted', 0)}", *(f"{t}: {n[s]}" for s, t in names.items() if n.get(s))]


def recheck(index: DataFrame, fresh: DataFrame, spec: FilterSpec) -> DataFrame:
    """The safe-mode decision as a join of the index with a fresh listing (path, size, atime): path, status (delete, missing or skipped)."""
    now = fresh.select("path", F.col("size").alias("now_size"), F.col("atime").alias("now_atime"))
    skip = F.lit(False)
    if spec.older_than is not None:
        skip = skip | (F.col("now_atime") >= spec.older_than)
    if spec.max_size is not None:
        skip = skip | (F.col("now_size") > spec.max_size)
    status = F.when(F.col("now_atime").isNull(), "missing").when(skip, "skipped").otherwise("delete")
    return spec.apply(index).select("path").join(now, "path", "left").select("path", status.alias("status"))


def run(index: DataFrame, spec: FilterSpec, partition: str | None = None, limit: int | None = None, dry_run: bool = False, safe: bool = False, force: bool = False, verbose: bool = False, jobs: int = 4, ask=input) -> list[str]:
    """What the command prints."""
    files = candidates(index, spec, partition, limit, ["path"] if limit is not None else None)  # an order, so that every action sees the same files
    n = files.count()
    if not n:
        return ["No matching files found."]
    if dry_run:
        return [*(r.path for r in files.toLocalIterator()), "", f"{n} file(s) would be deleted."]
    if not force and ask(f"Delete {n} file(s)? [y/N] ").strip().lower() not in ("y", "yes"):
        return ["Aborted."]
    done = purge(files, True, safe, spec, jobs)
    told = [r.detail for r in done.select("detail").toLocalIterator()] if verbose else []
    return [*told, "", *summary(done)]
