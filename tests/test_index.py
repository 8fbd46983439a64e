import os
import shutil

import pytest
from fsaudit.__main__ import main
from fsaudit.functions.sizes import SizeMode
from fsaudit.operators import find, purge, report, rollup
from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.sorting import SortMode
from fsaudit.plans.explorer import Explorer, render_listing
from fsaudit.sources.crawl import crawl, index_tree
from fsaudit.sources.index import read_index, read_root, write_index

DAY, NOW = 86_400, 1_700_000_000
APPARENT = SizeMode("apparent")


def tree(base, files, days=0):
    """files: name -> bytes, or (bytes, days since access)."""
    for name, x in files.items():
        n, d = x if isinstance(x, tuple) else (x, days)
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * n)
        os.utime(p, (NOW - d * DAY, NOW))
    return str(base)


def totals(df):
    rows = df.collect()
    return len(rows), sum(r.size for r in rows), {r.partition for r in rows}


@pytest.mark.parametrize("files, want", [
    ({"file1.txt": 100, "file2.txt": 200, "file3.txt": 300}, (3, 600, {"__root__"})),
    ({"root.txt": 50, "subdir1/file1.txt": 100, "subdir1/nested/deep.txt": 150, "subdir2/file2.txt": 200}, (4, 500, {"__root__", "subdir1", "subdir2"})),
    ({"alice/file1.txt": 100, "bob/file2.txt": 200, "bob/projects/file3.txt": 300}, (3, 600, {"alice", "bob"})),
    ({"alice/file1.txt": 100, "alice/file2.txt": 200, "bob/data.bin": 500, "charlie/notes.md": 150}, (4, 950, {"alice", "bob", "charlie"})),
    ({"part1/a.txt": 1000, "part2/b.txt": 2000, "part2/c.txt": 3000, ".hidden/.x": 1}, (4, 6001, {"part1", "part2", ".hidden"})),
])
def test_crawl(spark, tmp_path, files, want):
    for options in ({"split_depth": 0}, {"split_depth": 2}, {}, {"tasks": 1}):
        assert totals(crawl(spark, tree(tmp_path / "t", files), APPARENT, **options)) == want


def test_crawl_rules(spark, tmp_path):
    top = tree(tmp_path / "t", {"a/x": 100, "b/y": 5000, "loose": 7})
    os.symlink(top + "/a", top + "/link")
    os.symlink(top + "/a/x", top + "/b/link")
    assert totals(crawl(spark, top, SizeMode("block", 4096))) == (3, 4096 + 8192 + 4096, {"a", "b", "__root__"})
    assert totals(crawl(spark, top, APPARENT, ["b"])) == (2, 5007, {"b", "__root__"})
    assert totals(crawl(spark, top, APPARENT, ["b"], root=False)) == (1, 5000, {"b"})
    assert totals(crawl(spark, top, APPARENT, skip=top + "/b"))[2] == {"a", "__root__"}
    assert all(r.size % 512 == 0 and r.atime == NOW for r in crawl(spark, top).collect())
    for bad, message in ((["nope"], "Partition 'nope' not found"), (["link"], "not found")):
        with pytest.raises(Exception, match=message):
            crawl(spark, top, APPARENT, bad).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="No partitions found"):
        crawl(spark, str(tmp_path / "empty")).collect()
    odd = os.fsencode(top) + b"/a/\xff\xfe"
    open(odd, "wb").close()
    assert any("�" in r.path for r in crawl(spark, top).collect())


def test_index_round_trip_and_update(spark, tmp_path):
    top, out = tree(tmp_path / "t", {"001/a": 1, "002/b": 2, "002/c": 3, "a b+é%/d": 4, "loose": 5}), str(tmp_path / "index")
    stats = index_tree(spark, top, out, APPARENT, rows_per_file=1)
    assert (stats.files, stats.bytes, stats.pruned) == (5, 15, 0) and "Completed 5 files (15 B)" in str(stats)
    assert totals(read_index(spark, out)) == (5, 15, {"001", "002", "a b+é%", "__root__"})
    assert totals(read_index(spark, out, "002")) == (2, 5, {"002"}) and read_root(spark, out).count() == 1
    os.remove(top + "/002/c")
    os.remove(top + "/001/a")
    stats = index_tree(spark, top, out, APPARENT, ["002"])
    assert stats.pruned == 1 and totals(read_index(spark, out)) == (4, 12, {"001", "002", "a b+é%", "__root__"})
    write_index(spark.createDataFrame([("/z", 1, 1, "z")], "path string, size long, atime long, partition string"), out, full=True)
    assert totals(read_index(spark, out)) == (1, 1, {"z"})


def test_partitions_that_were_emptied_leave_the_index(spark, tmp_path):
    top, out = tree(tmp_path / "t", {"a/x": 1, "b/x": 2, "c d/x": 3, "c d/y": 4, "e/x": 6, "loose": 5}), str(tmp_path / "index")
    index_tree(spark, top, out, APPARENT)
    os.remove(top + "/a/x")
    os.remove(top + "/c d/x")
    os.remove(top + "/c d/y")
    # Only what was asked for is replaced.
    stats = index_tree(spark, top, out, APPARENT, ["c d"])
    assert stats.pruned == 1 and totals(read_index(spark, out)) == (4, 14, {"a", "b", "e", "__root__"})
    assert list(stats.progress())[:2] == ["Finished __root__ (1 files, 5 B)", "Finished c d (0 files, 0 B, pruned 1 stale)"]
    os.remove(top + "/loose")
    shutil.rmtree(top + "/e")
    stats = index_tree(spark, top, out, APPARENT, root=False)
    assert (stats.files, stats.pruned) == (1, 2) and totals(read_index(spark, out)) == (2, 7, {"b", "__root__"})
    stats = index_tree(spark, top, out, APPARENT)
    assert stats.pruned == 1 and totals(read_index(spark, out)) == (1, 2, {"b"}) and "pruned 1 stale" in str(stats)
    os.remove(top + "/b/x")
    assert index_tree(spark, top, out, APPARENT).pruned == 1 and not [d for d in os.listdir(out) if d.startswith("partition=")]


def test_one_large_partition_is_shared_by_tasks(tmp_path):
    from fsaudit.sources.crawl import CrawlReader

    top = tree(tmp_path / "t", {f"big/{a}/{b}/{c}/f": 1 for a in range(4) for b in range(4) for c in range(4)} | {"small/x": 1})
    items = CrawlReader({"path": top, "tasks": "8"}).partitions()
    walked = [sum(down for _, _, down in item.units) for item in items]
    assert len(items) == 8 and sum(walked) >= 16 and max(walked) <= 8
    assert len({p for item in items for p, _, _ in item.units}) == sum(len(item.units) for item in items)


def test_many_partitions_share_files(spark, tmp_path):
    from fsaudit.sources.index import PACKED, partition_names, replace_partitions

    n, out = 2 * PACKED + 1, str(tmp_path / "index")
    rows = lambda *parts: spark.createDataFrame([(f"/t/p{k}/{f}", k + f + add, k, f"p{k}" if k else "é b/+") for k, fs, add in parts for f in fs], "path string, size long, atime long, partition string")
    held = lambda df: sorted(map(tuple, df.collect()))
    every = rows(*((k, (0, 1, 2), 0) for k in range(n)))
    write_index(every, out, rows_per_file=2, full=True)
    assert not [d for d in os.listdir(out) if d.startswith("partition=")] and sum(len(ds) for _, ds, _ in os.walk(out)) < 8
    assert held(read_index(spark, out)) == held(every) and read_index(spark, out).columns == every.columns and len(partition_names(spark, out)) == n
    assert [held(read_index(spark, out, p)) for p in ("p7", "é b/+", "none")] == [held(every.filter("partition = 'p7'")), held(every.filter("partition = 'é b/+'")), []]
    # Two partitions are replaced, one is new and one is emptied; the others stay.
    assert replace_partitions(rows((1, (5,), 9), (2, (0, 1, 2), 9), (n, (0,), 0)), out, ["p1", "p2", "p3"], rows_per_file=2) == {"p1": 1, "p3": 2}
    want = held(every.filter("partition NOT IN ('p1', 'p2', 'p3')").union(rows((1, (5,), 9), (2, (0, 1, 2), 9), (n, (0,), 0))))
    assert held(read_index(spark, out)) == want and not [d for d in os.listdir(out) if d.startswith("_") and d != "_SUCCESS"]
    write_index(rows((4, (8,), 0)), out)
    assert held(read_index(spark, out)) == sorted([x for x in want if x[3] != "p4"] + [("/t/p4/8", 12, 4, "p4")])
    names = sorted(partition_names(spark, out))
    replace_partitions(rows((4, (8,), 0)), out, names)
    assert held(read_index(spark, out)) == [("/t/p4/8", 12, 4, "p4")] and len(os.listdir(next(e.path for e in os.scandir(out) if e.name.startswith("buckets=")))) == 1
    write_index(rows((4, (8,), 0)), out, full=True)
    assert os.path.isdir(out + "/partition=p4") and held(read_index(spark, out)) == [("/t/p4/8", 12, 4, "p4")]


def test_index_of_many_directories(spark, tmp_path):
    top, out = tree(tmp_path / "t", {f"d{k}/x": 1 for k in range(300)} | {"loose": 1}), str(tmp_path / "i")
    assert index_tree(spark, top, out, APPARENT).files == 301 and not os.path.exists(out + "/partition=d1")
    shutil.rmtree(top + "/d7")
    stats = index_tree(spark, top, out, APPARENT)
    assert (stats.files, stats.pruned) == (300, 1) and read_index(spark, out, "d7").count() == 0 and read_root(spark, out).count() == 1


def test_index_inside_the_tree_is_left_out(spark, tmp_path):
    top = tree(tmp_path / "t", {"a/x": 1})
    for _ in range(2):
        assert index_tree(spark, top, top + "/index", APPARENT).files == 1


def test_bare_layout(spark, tmp_path):
    for name in ("__root__", "a+b", "a b", "é", "c%d", "001"):
        d = tmp_path / "w"
        spark.createDataFrame([(f"/t/{name}/f", 1, 2)], "path string, size long, atime long").coalesce(1).write.mode("overwrite").parquet(str(d))
        (tmp_path / "bare" / name).mkdir(parents=True)
        f = next(x for x in os.listdir(d) if x.endswith(".parquet"))
        shutil.copy(d / f, tmp_path / "bare" / name / "000000.parquet")
        shutil.copy(d / f, tmp_path / "bare" / name / "000001.parquet.partial")
    got = {(r.path, r.partition) for r in read_index(spark, str(tmp_path / "bare")).collect()}
    assert got == {(f"/t/{n}/f", n) for n in ("__root__", "a+b", "a b", "é", "c%d", "001")}
    assert read_index(spark, str(tmp_path / "bare"), "a b").count() == 1 and read_root(spark, str(tmp_path / "bare")).count() == 1
    shutil.rmtree(tmp_path / "bare" / "__root__")
    assert read_root(spark, str(tmp_path / "bare")).count() == 0


@pytest.fixture(scope="module")
def index(spark):
    rows = [("/t/a/one.log", 100, NOW - 10 * DAY), ("/t/a/sub/two, \"q\".py", 3000, NOW - 100 * DAY), ("/t/a/sub/x/three.py", 50, NOW), ("/t/b/é/four", 700, NOW - 200 * DAY), ("/t/loose", 9, NOW - 1 * DAY)]
    df = spark.createDataFrame([(*r, "__root__" if r[0].count("/") == 2 else r[0].split("/")[2]) for r in rows], "path string, size long, atime long, partition string")
    return df.cache()


def test_find_formats(index):
    assert list(find.run(index, FilterSpec(), fmt="size", limit=2)) == ['3000\t/t/a/sub/two, "q".py', "700\t/t/b/é/four"]
    assert list(find.run(index, FilterSpec(), fmt="atime", limit=1)) == [f"{NOW - 200 * DAY}\t/t/b/é/four"]
    assert list(find.run(index, FilterSpec(min_size=1000), fmt="csv")) == ["path,size,atime", f'"/t/a/sub/two, ""q"".py",3000,{NOW - 100 * DAY}']
    assert list(find.run(index, FilterSpec(min_size=1000), fmt="json")) == ["[", f'  {{"path":"/t/a/sub/two, \\"q\\".py","size":3000,"atime":{NOW - 100 * DAY}}}', "]"]
    assert list(find.run(index, FilterSpec(min_size=10**9), fmt="json")) == ["[", "]"]
    assert list(find.run(index, FilterSpec(pattern="one"))) == ["/t/a/one.log"]
    assert list(find.run(index, FilterSpec(), count_only=True, limit=1)) == ["5"] and list(find.run(index, FilterSpec(), "a", count_only=True)) == ["3"]
    assert list(find.run(index, FilterSpec(), top=2, count_only=True, fmt="nope")) == ["a", "__root__"]
    with pytest.raises(ValueError, match="Unknown format"):
        list(find.run(index, FilterSpec(), fmt="nope"))


def test_plans_push_down_and_need_no_shuffle(spark, tmp_path, index):
    out = str(tmp_path / "i")
    write_index(index, out)
    df = read_index(spark, out)
    text = lambda x: x._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = text(find.find(df, FilterSpec(r"\.py$", 10, None, NOW), "a"))
    assert "StringEndsWith(path,.py)" in plan and "GreaterThanOrEqual(size,10)" in plan and "LessThan(atime" in plan and "PartitionFilters: [isnotnull(partition" in plan and "Exchange" not in plan
    assert "TakeOrderedAndProject" in text(find.find(df, fmt="size", limit=3)) and "ReadSchema: struct<>" in text(find.count(df))
    assert "StringStartsWith(path,/t/a/)" in text(rollup.directory_rollup(df, "/t/a/"))


def test_rollups(index):
    rows = {r.name: r for r in rollup.directory_listing(index, "/t/a/").collect()}
    assert list(rows) == ["sub", "one.log"] and (rows["sub"].total_size, rows["sub"].file_count, rows["sub"].is_dir, rows["sub"].path) == (3050, 2, True, "/t/a/sub")
    assert [r.name for r in rollup.partition_listing(index).collect()] == ["a", "b", "loose"]
    assert [r.name for r in rollup.partition_listing(index, sort=SortMode.AGE_DESC).collect()] == ["b", "loose", "a"]
    assert [r.partition for r in rollup.partition_summary(index, FilterSpec(min_size=1000)).collect()] == ["a"]
    assert rollup.directory_rollup(index, "/t/b/é").first().name == "four"
    assert rollup.partition_root(index, "a").first().root == "/t/a" and rollup.partition_root(index, "b").first().root == "/t/b/é"
    assert rollup.partition_root(index, "a", "shortest").first().root == "/t/a" and rollup.partition_root(index, "none").count() == 0


def test_explorer(index):
    e = Explorer(index)
    a = e.enter("a")
    sub = a.enter("sub")
    assert (a.root, a.path, sub.path) == ("/t/a", "/t/a", "/t/a/sub") and [r.name for r in sub.listing().collect()] == ["x", 'two, "q".py']
    assert sub.enter("..") == a and a.up() == e and a.enter("one.log") == a and e.up() == e
    assert [t for t, _ in sub.columns()] == ["partitions", "/t/a", "/t/a/sub"]
    small, message = a.filtered("max_size", "1K", NOW)
    assert message is None and [r.name for r in small.listing().collect()] == ["sub", "one.log"] and small.cleared() == a
    assert a.filtered("max_size", "?", NOW)[1] and a.select(9, 2).selected == 1
    assert render_listing(a.sorted(SortMode.SIZE_DESC).listing(), NOW)[0] == "sub/\t2.98 KiB\t2 files\ttoday"
    with pytest.raises(ValueError):
        e.enter("nope")
    assert [r.name for r in sub.listing(parent=True).collect()] == ["..", "x", 'two, "q".py'] and [r.name for r in e.listing(parent=True).collect()] == ["a", "b", "loose"]
    # List and tree, at the same place.
    t = sub.toggled()
    assert (t.mode, t.path, t.toggled()) == ("tree", sub.path, sub) and [n for n, _ in t.view()] == ["partitions", "/t/a", "/t/a/sub"] and [n for n, _ in sub.view()] == ["/t/a/sub"]
    assert t.left() == a.toggled() and a.toggled().right("sub") == t and [r.name for r in t.preview("x").collect()] == ["three.py"] and t.preview('two, "q".py') is None
    assert t.move(5, 2).selected == 1 and t.move(-1, 2).selected == 0 and t.last(2).selected == 1 and t.last(2).first().selected == 0
    # A sort mode is chosen, then confirmed or not.
    chosen = a.start_sort().next_sort().next_sort().prev_sort()
    assert (chosen.sort, chosen.pending) == (SortMode.NAME, SortMode.SIZE_DESC) and chosen.confirm_sort() == a.sorted(SortMode.SIZE_DESC) and chosen.cancel_sort() == a


def test_reports(index, tmp_path):
    rows = {r.partition: (r.file_count, r.total_size) for r in report.stale_report(index, NOW).collect()}
    assert rows == {"a": (1, 3000), "b": (1, 700)}
    names = report.write_reports(index, str(tmp_path / "r"), NOW)
    assert [os.path.basename(n) for n in names] == ["a.txt", "b.txt"] and "2.93 KiB (3000 bytes)" in open(names[0]).read()


# Purge: each case indexes a tree, changes it, and deletes.

OLD = 90


def rm(spark, tmp_path, files, change=None, **options):
    top, out = tree(tmp_path / "t", files), str(tmp_path / "index")
    index_tree(spark, top, out, APPARENT)
    if change:
        change(tmp_path / "t")
    spec = {k: options.pop(k) for k in ("pattern", "min_size", "max_size", "older_than_days", "newer_than_days") if k in options}
    said = purge.run(read_index(spark, out), FilterSpec.of(NOW, **spec), force=options.pop("force", True), **options)
    left = sorted(os.path.relpath(os.path.join(d, f), top) for d, _, fs in os.walk(top) for f in fs)
    return said, left


@pytest.mark.parametrize("files, options, left", [
    ({"u/keep.txt": 100, "u/delete.log": 100, "u/also.log": 100}, {"pattern": r"\.log$"}, ["u/keep.txt"]),
    ({"u/small.txt": 100, "u/large.txt": 10000}, {"min_size": "1K"}, ["u/small.txt"]),
    ({"u/small.txt": 100, "u/large.txt": 10000}, {"max_size": "1K"}, ["u/large.txt"]),
    ({"u/recent.txt": 100, "u/old.txt": (100, OLD)}, {"older_than_days": 30}, ["u/recent.txt"]),
    ({"alice/f": 100, "bob/f": 100}, {"partition": "alice"}, ["bob/f"]),
    ({"u/old_large.log": (2000, OLD), "u/old.txt": (2000, OLD), "u/recent.log": 2000, "u/old_small.log": (100, OLD)}, {"pattern": r"\.log$", "older_than_days": 30, "min_size": "1K"}, ["u/old.txt", "u/old_small.log", "u/recent.log"]),
    ({"u/file.txt": 100}, {"safe": True}, []),
])
def test_purge_selects(spark, tmp_path, files, options, left):
    said, now = rm(spark, tmp_path, files, **options)
    assert now == left and said[-1] == f"Deleted: {len(files) - len(left)}"


def test_purge_modes(spark, tmp_path):
    two = {"u/file1.txt": 100, "u/file2.txt": 200}
    said, left = rm(spark, tmp_path / "1", two, dry_run=True)
    assert len(left) == 2 and said[-1] == "2 file(s) would be deleted." and len(said) == 4
    assert rm(spark, tmp_path / "2", two, pattern="none$", dry_run=True)[0] == ["No matching files found."]
    assert rm(spark, tmp_path / "3", two, force=False, ask=lambda _: " No ")[0] == ["Aborted."]
    assert rm(spark, tmp_path / "4", two, force=False, ask=lambda _: " YES ")[1] == []
    said, left = rm(spark, tmp_path / "5", two | {"u/file3.txt": 1}, limit=1)
    assert len(left) == 2 and said[-1] == "Deleted: 1"
    said, _ = rm(spark, tmp_path / "6", two, verbose=True)
    assert sum(x.startswith("DELETE: ") for x in said) == 2
    said, left = rm(spark, tmp_path / "7", {"u/exists.txt": 100, "u/gone.txt": 100}, change=lambda t: os.remove(t / "u/gone.txt"))
    assert left == [] and said[-2:] == ["Deleted: 1", "Missing: 1"]
    said, left = rm(spark, tmp_path / "8", {"u/f": (100, OLD)}, change=lambda t: os.utime(t / "u/f", (NOW, NOW)), older_than_days=30, safe=True)
    assert left == ["u/f"] and said[-2:] == ["Deleted: 0", "Skipped (safe mode): 1"]
    said, left = rm(spark, tmp_path / "9", {"u/f": 100}, change=lambda t: (t / "u/f").write_bytes(b"x" * 2100), max_size="1K", safe=True)
    assert left == ["u/f"] and said[-1] == "Skipped (safe mode): 1"
    assert purge.outcome(str(tmp_path), False, None, None)[0] == "failed" and purge.outcome(str(tmp_path / "no"), True, None, None)[0] == "missing"
    with pytest.raises(PermissionError):
        purge.purge(spark.createDataFrame([("/x",)], "path string"), confirm=False)


def test_command_line(spark, tmp_path, capsys):
    top, out = tree(tmp_path / "t", {"a/x.log": (2048, OLD), "b/y": 10, "z": 1}), str(tmp_path / "i")
    run = lambda *a: (main([*a], spark, NOW), capsys.readouterr().out.splitlines())[1]
    assert run("index", top, "-o", out, "--apparent-size")[0].startswith("Completed 3 files (2.01 KiB)")
    assert run("find", "-i", out, "-p", "log$") == [f"{top}/a/x.log"] and run("find", "-i", out, "-c") == ["3"] and run("find", "-i", out, "-u", "b", "-f", "size") == [f"10\t{top}/b/y"]
    assert run("view", "-i", out, "-s", "size")[0] == "a/\t2.00 KiB\t1 file\t3 months ago" and [x.split("\t")[0] for x in run("view", "-i", out, "a")] == ["../", "x.log"]
    assert [x.split("\t")[0] for x in run("view", "-i", out, "-t", "a")] == ["partitions:", "a/", "b/", "z", f"{top}/a:", "x.log"]
    assert run("index", top, "-o", out, "--apparent-size", "-v")[:3] == ["Finished __root__ (1 files, 1 B)", "Finished a (1 files, 2.00 KiB)", "Finished b (1 files, 10 B)"]
    assert run("report", "-i", out, "-o", str(tmp_path / "r")) == [str(tmp_path / "r" / "a.txt")]
    assert run("rm", "-i", out, "--older-than", "30", "-n")[-1] == "1 file(s) would be deleted." and run("rm", "-i", out, "--older-than", "30", "-f")[-1] == "Deleted: 1"
