import struct

import pytest
from fsaudit.functions import filetype, paths, sizes
from fsaudit.functions.sizes import SizeMode, format_atime, format_bytes, format_count, format_file_count, format_speed, parse_size, round_to_block
from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.sorting import SortMode
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DAY = 86_400


@pytest.mark.parametrize("text, want", [
    ("0", 0), ("1024", 1024), ("1K", 1024), ("1k", 1024), ("10KiB", 10240), ("2M", 2 << 20), ("1.5G", 3 << 29), ("1TiB", 1 << 40), ("1 T", 1 << 40), (" 7 b ", 7), ("0.5K", 512), ("1.9", 1), ("-1.9K", -1945), ("1e3", 1000), (".5M", 1 << 19),
])
def test_parse_size(text, want):
    assert parse_size(text) == want


@pytest.mark.parametrize("text", ["", "x", "10MB", "K", "1_0", "inf", "nan", "1 2", "--1"])
def test_parse_size_rejects(text):
    with pytest.raises(ValueError, match="Invalid size"):
        parse_size(text)


def test_parse_size_column(spark):
    texts = ["1K", "1.5GiB", "10MB", "7", " 2 m ", "x", None, "99999999999T"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sizes.parse_size_col(F.col("t"))).collect()]
    assert got == [1024, 3 << 29, None, 7, 2 << 20, None, None, 2**63 - 1]


def test_parse_size_column_matches_once_a_row(spark):
    texts = ["1e400", "-1e400T", "-9223372036854775809", "9223372036854775807", "5\t", "5K\n", "1_0", "", "K", "1e", "8e18", " -.5 tib", "1d", "nan", "--1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select(sizes.parse_size_col(F.col("t")))
    assert [r[0] for r in df.collect()] == [2**63 - 1, -(2**63), -(2**63), 2**63 - 1, 5, 5120, None, None, None, None, 8 * 10**18, -(1 << 39), None, None, None]
    code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(df._jdf.queryExecution().executedPlan())
    assert code.count(".matcher(") <= 2  # the text of the code has each expression up to twice


def test_display():
    assert [format_bytes(n) for n in (0, 1023, 1024, 1152, 1536, 1 << 20, 5 << 30, 3 << 40)] == ["0 B", "1023 B", "1.00 KiB", "1.12 KiB", "1.50 KiB", "1.00 MiB", "5.00 GiB", "3.00 TiB"]
    assert [format_count(n) for n in (0, 999, 1000, 1150, 1500, 999_999, 10**6, 2_500_000, 10**9)] == ["0", "999", "1.0K", "1.1K", "1.5K", "1000.0K", "1.0M", "2.5M", "1.0B"]
    assert [format_file_count(n) for n in (0, 1, 2, 1500)] == ["0 files", "1 file", "2 files", "1.5K files"]
    assert [format_speed(x) for x in (0, 999.4, 1500, 2.5e6)] == ["0 files/s", "999 files/s", "1.5k files/s", "2.5M files/s"]
    now = 10**9
    ages = {0: "today", 1: "1 day ago", 29: "29 days ago", 30: "1 month ago", 60: "2 months ago", 364: "12 months ago", 365: "1 year ago", 800: "2 years ago"}
    assert {d: format_atime(now - d * DAY, now) for d in ages} == ages and format_atime(0, now) == "" and format_atime(now + 1, now) == "future"
    assert format_atime(-5 * DAY, now) == "31 years ago"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(10**10), 1 << 45), min_size=1, max_size=200))
def test_column_forms_equal_python(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n long").select(
        "n", sizes.format_bytes_col(F.abs("n")).alias("b"), sizes.format_count_col(F.abs("n")).alias("c"), sizes.format_atime_col(F.col("n"), 1 << 40).alias("a"), round_to_block(F.abs("n"), 4096).alias("r")
    )
    for r in df.collect():
        n = abs(r.n)
        assert (r.b, r.c, r.a, r.r) == (format_bytes(n), format_count(n), format_atime(r.n, 1 << 40), round_to_block(n, 4096))


def test_blocks_and_modes():
    assert [round_to_block(n, 4096) for n in (0, 1, 100, 4096, 4097)] == [0, 4096, 4096, 4096, 8192] and round_to_block(77, 0) == 77
    assert SizeMode().calculate(512, 100) == 512 and SizeMode("apparent").calculate(512, 100) == 100 and SizeMode("block", 4096).calculate(512, 100) == 4096
    assert SizeMode.choose(True, "128K") == SizeMode("block", 131072) and SizeMode.choose(True) == SizeMode("apparent") and SizeMode.choose() == SizeMode()


def test_sort_modes():
    assert [SortMode.parse(x) for x in ("size", "COUNT", "age", "oldest", "newest", "name", "age-asc")] == [SortMode.SIZE_DESC, SortMode.COUNT_DESC, SortMode.AGE_DESC, SortMode.AGE_DESC, SortMode.AGE_ASC, SortMode.NAME, SortMode.AGE_ASC]
    m = SortMode.NAME
    for _ in SortMode:
        assert m.next().prev() == m
        m = m.next()
    assert m == SortMode.NAME and str(SortMode.SIZE_ASC) == "size-asc"
    with pytest.raises(ValueError):
        SortMode.parse("huge")


def test_filter_spec():
    now = 10**9
    s = FilterSpec.of(now, "x", "1K", "2M", 30, 60)
    assert s == FilterSpec("x", 1024, 2 << 20, now - 30 * DAY, now - 60 * DAY) and s.is_active and not s.clear().is_active
    assert s.format_display(now) == "[/x] [min:1.00 KiB] [max:2.00 MiB] [older:30d] [newer:60d]"
    assert FilterSpec().format_display(now) == ""
    assert s.with_input("min_size", " ", now) == (FilterSpec("x", None, 2 << 20, now - 30 * DAY, now - 60 * DAY), None)
    for field, text in (("max_size", "10MB"), ("older_than", "x"), ("newer_than", "-1")):
        same, message = s.with_input(field, text, now)
        assert same == s and message
    assert s.with_input("older_than", "7", now)[0].older_than == now - 7 * DAY


def test_filters_select(spark):
    rows = [("/a/x.log", 5, 100), ("/a/x.log\n", 5, 100), ("/b/y.py", 10, 200), ("/b/y_py", 20, 300)]
    df = spark.createDataFrame(rows, "path string, size long, atime long")
    take = lambda **k: [r.path for r in FilterSpec(**k).apply(df).orderBy("path").collect()]
    assert take(pattern=r"\.log$") == ["/a/x.log"] and take(pattern="^/b") == ["/b/y.py", "/b/y_py"] and take(pattern="y.py") == ["/b/y.py", "/b/y_py"]
    assert take(pattern=r"(?P<n>x)\.l") == ["/a/x.log", "/a/x.log\n"] and take(pattern="X") == []
    assert take(min_size=10) == ["/b/y.py", "/b/y_py"] and take(max_size=5) == ["/a/x.log", "/a/x.log\n"]
    assert take(older_than=200) == ["/a/x.log", "/a/x.log\n"] and take(newer_than=200) == ["/b/y.py", "/b/y_py"] and len(take()) == 4


def test_patterns_as_prefix_or_suffix():
    assert paths.literal_edge(r"\.py$") == ("endswith", ".py") and paths.literal_edge("^/a-b") == ("startswith", "/a-b")
    for p in ("a", "^a$", r"a\d$", r"\$", "a.$", "^a|b", r"x\$", "$", "^"):
        assert paths.literal_edge(p) is None
    assert paths.java_pattern(r"a\$") == r"a\$" and paths.java_pattern(r"a\\$") == r"a\\\z"


def test_path_parts(spark):
    df = spark.createDataFrame([("/data/scratch/alice/projects/file.txt",), ("/data/scratch/readme.txt",), ("/data/scratch/bob/2024/é.pdf",)], "path string")
    p = F.col("path")
    rows = df.select(paths.derive_partition(p, "/data/scratch"), paths.file_name(p), paths.component(paths.rest_after(p, "/data/scratch/bob/"))).collect()
    assert [r[0] for r in rows] == ["alice", "__root__", "bob"] and [r[1] for r in rows] == ["file.txt", "readme.txt", "é.pdf"] and rows[2][2] == "2024"


def test_strip_ansi(spark):
    cases = {"a\x1b[1;31mb\x1b[0m": "ab", "\x1b]0;title\x07x": "x", "\x1b]8;;u\x1b\\y": "y", "\x1bMz": "z", "end\x1b": "end", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(paths.strip_ansi(F.col("t"))).collect()] == list(cases.values())


def elf(cls=2, data=1, kind=2, machine=0x3E):
    return b"\x7fELF" + bytes([cls, data]) + bytes(10) + struct.pack("<HH" if data == 1 else ">HH", kind, machine)


@pytest.mark.parametrize("content, path, want", [
    (elf(), "a", ("ELF 64-bit LSB executable, x86-64", False)), (elf(1, 2, 3, 0x14), "a", ("ELF 32-bit MSB shared object, PowerPC", False)), (b"\x7fELF", "a", ("ELF binary", False)),
    (b"\xcf\xfa\xed\xfe" + struct.pack("<III", 0x0100000C, 0, 2), "a", ("Mach-O 64-bit executable, ARM64", False)), (b"\xca\xfe\xba\xbe" + bytes(8), "a", ("Mach-O universal binary", False)),
    (b"\x89PNG\r\n\x1a\n", "a", ("image/png (png)", False)), (b"%PDF-1.4", "a", ("application/pdf (pdf)", False)), (b"#!/usr/bin/env python3\n", "a", ("Python script, UTF-8 text", True)),
    (b"#!/bin/sh -e\n", "a", ("POSIX shell script, UTF-8 text", True)), (b"#!/opt/x\n", "a", ("Script (#!x), UTF-8 text", True)), (b'{"a":1}', "a.txt", ("JSON text, UTF-8", True)), (b"<?xml?>", "a", ("XML text, UTF-8", True)),
    (b"fn main", "/x/a.RS", ("Rust source, UTF-8", True)), (b"hello", "a", ("text/plain; UTF-8", True)), (b"\xff\x00\x01", "a.txt", ("application/octet-stream (binary data)", False)), (b"", "a", ("(unreadable)", False)), (None, "a", ("(unreadable)", False)),
    (b"a" * 8191 + "é".encode(), "a", ("text/plain; UTF-8", True)), (b"x=1", "Makefile", ("text/plain; UTF-8", True)), (b"k: v", "a.yml", ("YAML text, UTF-8", True)), (b"int x;", "a.hpp", ("C++ header, UTF-8", True)),
])
def test_file_types(content, path, want):
    assert filetype.detect_file_type(content, path) == want


def test_sniff_and_pager(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n")
    df = spark.createDataFrame([(str(tmp_path / "a.py"),), (str(tmp_path / "gone"),)], "path string")
    assert {(r.description, r.is_text) for r in filetype.sniff(df).collect()} == {("Python source, UTF-8", True), ("(unreadable)", False)}
    (tmp_path / "b").write_bytes("".join(f"é{k}\r\n" for k in range(1000)).encode() + b"last")
    p = filetype.TextPager(str(tmp_path / "b"), chunk=101, window=50)
    p.to_end()
    assert p.lines[-2:] == ["é999", "last"] and len(p.lines) == 50 and p.first == 951
    p.reload()
    assert p.lines[0] == "é0" and p.first == 0
