"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fsaudit.functions import paths, sizes
from fsaudit.functions.filetype import _MAGIC, file_type
from fsaudit.operators import find, purge, report, rollup
from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.sorting import SortMode
from fsaudit.sources.index import read_index, read_root, replace_partitions, to_bare, write_index
from fsaudit.sources.shared import own_folder
from fsaudit.sources.views import NOW_E, NOW_L, TOPS, sql, view
from fsaudit.schema import DAY, ROOT_PARTITION

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, on: str, build: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir, on))
    if oracle:
        _SQL[name] = oracle.replace("{V}", f"{sql(on)} v")


KB = 1024
_E60, _E15 = NOW_E - 20 * DAY, NOW_E - 10 * DAY
_COMBINED = FilterSpec(pattern=r"\.log$", min_size=1_000_000, max_size=6_000_000, older_than=NOW_L - 365 * DAY, newer_than=NOW_L - 2000 * DAY)
_COMBINED_SQL = f"regexp_matches(path, '\\.log$') AND size >= 1000000 AND size <= 6000000 AND atime < {NOW_L - 365 * DAY} AND atime >= {NOW_L - 2000 * DAY}"

_add("find_path_regex", "L", lambda v: find.find(v, FilterSpec(pattern=r"/p[0-3]/o\d+5\.[12]\.(log|tmp)$")), r"SELECT path FROM {V} WHERE regexp_matches(path, '/p[0-3]/o\d+5\.[12]\.(log|tmp)$')")
_add("find_path_suffix", "L", lambda v: find.find(v, FilterSpec(pattern=r"\.py$")), r"SELECT path FROM {V} WHERE regexp_matches(path, '\.py$')")
_add("find_min_size", "L", lambda v: find.find(v, FilterSpec(min_size=9_000_000), fmt="csv"), "SELECT path, size, atime FROM {V} WHERE size >= 9000000")
_add("find_max_size", "L", lambda v: find.find(v, FilterSpec(max_size=150_000), fmt="csv"), "SELECT path, size, atime FROM {V} WHERE size <= 150000")
_add("find_size_range", "L", lambda v: find.find(v, FilterSpec(min_size=1_000_000, max_size=1_200_000), fmt="csv"), "SELECT path, size, atime FROM {V} WHERE size >= 1000000 AND size <= 1200000")
_add("find_older_than", "E", lambda v: find.find(v, FilterSpec(older_than=_E60), fmt="csv"), f"SELECT path, size, atime FROM {{V}} WHERE atime < {_E60}")
_add("find_newer_than", "E", lambda v: find.find(v, FilterSpec(newer_than=_E15), fmt="csv"), f"SELECT path, size, atime FROM {{V}} WHERE atime >= {_E15}")
_add("find_combined", "L", lambda v: find.find(v, _COMBINED, fmt="csv"), f"SELECT path, size, atime FROM {{V}} WHERE {_COMBINED_SQL}")
_add("find_partition", "E", lambda v: find.find(v, partition="u7", fmt="csv"), "SELECT path, size, atime FROM {V} WHERE partition = 'u7'")
_add("find_by_size_limit", "E", lambda v: find.find(v, fmt="size", limit=50), "SELECT size, path FROM {V} ORDER BY size DESC, path, atime LIMIT 50")
_add("find_by_atime_limit", "E", lambda v: find.find(v, fmt="atime", limit=50), "SELECT atime, path FROM {V} ORDER BY atime, path, size LIMIT 50")
_add("find_csv_rows", "D", lambda v: find.lines(find.find(v, fmt="csv"), "csv"), """SELECT concat(CASE WHEN regexp_matches(path, '[,"]') THEN '"' || replace(path, '"', '""') || '"' ELSE path END, ',', size, ',', atime) AS value FROM {V}""")
_add("find_json_rows", "D", lambda v: find.lines(find.find(v, fmt="json"), "json"), """SELECT concat('{"path":"', replace(path, '"', '\\"'), '","size":', size, ',"atime":', atime, '}') AS value FROM {V}""")
_add("find_size_rows", "D", lambda v: find.lines(find.find(v, fmt="size"), "size"), "SELECT concat(size, chr(9), path) AS value FROM {V}")
_add("count_all", "L", lambda v: find.count(v), "SELECT count(*) AS file_count FROM {V}")
_add("count_filtered", "L", lambda v: find.count(v, _COMBINED), f"SELECT count(*) AS file_count FROM {{V}} WHERE {_COMBINED_SQL}")
_add("top_partitions", "L", lambda v: find.top_partitions(v, 10), "SELECT partition, count(*) AS file_count FROM {V} GROUP BY partition ORDER BY file_count DESC, partition LIMIT 10")
_add("top_partitions_filtered", "D", lambda v: find.top_partitions(v, 5, FilterSpec(min_size=1000)), "SELECT partition, count(*) AS file_count FROM {V} WHERE size >= 1000 GROUP BY partition ORDER BY file_count DESC, partition LIMIT 5")

_SUMS = "CAST(sum(size) AS BIGINT) AS total_size, count(*) AS file_count, max(atime) AS latest_atime"
_add("partition_summary", "D", lambda v: rollup.partition_summary(v), f"SELECT partition, {_SUMS} FROM {{V}} WHERE partition NOT IN ('', '__root__') GROUP BY partition")
_add("partition_summary_filtered", "D", lambda v: rollup.partition_summary(v, FilterSpec(min_size=20_000)), f"SELECT partition, {_SUMS} FROM {{V}} WHERE partition NOT IN ('', '__root__') AND size >= 20000 GROUP BY partition")
_add("partition_summary_conditional", "D", lambda v: rollup.partition_summary(v, FilterSpec(min_size=20_000), exact_floor=True),
     "SELECT partition, CAST(sum(CASE WHEN size >= 20000 THEN size ELSE 0 END) AS BIGINT) AS total_size, CAST(sum(CASE WHEN size >= 20000 THEN 1 ELSE 0 END) AS BIGINT) AS file_count, max(CASE WHEN size >= 20000 THEN atime ELSE 0 END) AS latest_atime FROM {V} WHERE partition <> '__root__' GROUP BY partition HAVING sum(CASE WHEN size >= 20000 THEN 1 ELSE 0 END) > 0")
_ROOT = "SELECT split_part(path, '/', -1) AS name, path, false AS is_dir, size AS total_size, CAST(1 AS BIGINT) AS file_count, atime AS latest_atime FROM {V} WHERE partition = '__root__'"
_add("root_files", "D", lambda v: rollup.root_files(v), _ROOT)
_add("partition_listing_with_root_files", "D", lambda v: rollup.partition_listing(v), f"SELECT partition AS name, partition AS path, true AS is_dir, {_SUMS} FROM {{V}} WHERE partition <> '__root__' GROUP BY partition UNION ALL {_ROOT}")


def _ranked(mode: SortMode) -> Callable[[DataFrame], DataFrame]:
    # One number per partition of the index, so one task may hold them.
    return lambda v: rollup.partition_summary(v).withColumn("rank", F.row_number().over(Window.orderBy(*mode.partitions())).cast("long"))


for _mode, _order in (("name", "partition"), ("size-desc", "total_size DESC, partition"), ("size-asc", "total_size, partition"), ("count-desc", "file_count DESC, partition"), ("count-asc", "file_count, partition"), ("age-desc", "latest_atime, partition"), ("age-asc", "latest_atime DESC, partition")):
    _add(f"partition_sort_{_mode.replace('-', '_')}", "L", _ranked(SortMode(_mode)), f"SELECT *, row_number() OVER (ORDER BY {_order}) AS rank FROM (SELECT partition, {_SUMS} FROM {{V}} GROUP BY partition)")


def _rollup_sql(prefix: str, where: str = "true") -> str:
    n = len(prefix) + 1
    return f"""SELECT name, concat('{prefix}', name) AS path, bool_or(d) AS is_dir, {_SUMS}
FROM (SELECT size, atime, split_part(substr(path, {n}), '/', 1) AS name, position('/' IN substr(path, {n})) > 0 AS d FROM {{V}} WHERE starts_with(path, '{prefix}') AND {where}) WHERE name <> '' GROUP BY name"""


_add("directory_rollup", "E", lambda v: rollup.directory_rollup(v, "/scratch/"), _rollup_sql("/scratch/"))
_add("directory_rollup_filtered", "E", lambda v: rollup.directory_rollup(v, "/scratch/u7/", FilterSpec(min_size=40 * KB)), _rollup_sql("/scratch/u7/", f"size >= {40 * KB}"))
_add("directory_rollup_nested", "E", lambda v: rollup.directory_rollup(v, "/scratch/u7/click/"), _rollup_sql("/scratch/u7/click/"))
_add("directory_rollup_large", "L", lambda v: rollup.directory_rollup(v, "/fs/", FilterSpec(older_than=NOW_L - 1000 * DAY)), _rollup_sql("/fs/", f"atime < {NOW_L - 1000 * DAY}"))
_add("web_tree_rollup", "W", lambda v: rollup.directory_rollup(v, "/web/"), _rollup_sql("/web/"))
_add("directory_sorted", "W", lambda v: rollup.directory_rollup(v, "/web/").withColumn("rank", F.row_number().over(Window.orderBy(*SortMode.SIZE_DESC.directories())).cast("long")),
     f"SELECT *, row_number() OVER (ORDER BY total_size DESC, name) AS rank FROM ({_rollup_sql('/web/')})")
_add("directory_sorted_by_name", "D", lambda v: rollup.directory_rollup(v, "/docs/").withColumn("rank", F.row_number().over(Window.orderBy(*SortMode.NAME.directories())).cast("long")),
     f"SELECT *, row_number() OVER (ORDER BY is_dir DESC, name) AS rank FROM ({_rollup_sql('/docs/')})")


def _listed(mode: SortMode) -> Callable[[DataFrame], DataFrame]:
    # A listing is one level of a tree; partitions and loose files are ranked together.
    return lambda v: rollup.partition_listing(v, sort=mode).withColumn("rank", F.row_number().over(Window.orderBy(*mode.directories(), "path")).cast("long"))


for _mode, _order in (("name", "is_dir DESC, name, path"), ("size-desc", "total_size DESC, name, path"), ("age-asc", "latest_atime DESC, name, path")):
    _add(f"partition_listing_sort_{_mode.replace('-', '_')}", "D", _listed(SortMode(_mode)), f"SELECT *, row_number() OVER (ORDER BY {_order}) AS rank FROM (SELECT partition AS name, partition AS path, true AS is_dir, {_SUMS} FROM {{V}} WHERE partition <> '__root__' GROUP BY partition UNION ALL {_ROOT})")
#: The deepest directory that is the same for all files, depth by depth.
_ROOT_SQL = """WITH p AS (SELECT string_split(path, '/') AS w FROM {V} WHERE partition = 'src1'),
 d AS (SELECT k, array_to_string(list_slice(w, 1, k), '/') AS root FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS k FROM p)),
 g AS (SELECT k, min(root) AS root FROM d GROUP BY k HAVING count(DISTINCT root) = 1 AND count(*) = (SELECT count(*) FROM p))
SELECT root FROM g ORDER BY k DESC LIMIT 1"""
_add("partition_root", "D", lambda v: rollup.partition_root(v, "src1"), _ROOT_SQL)
_add("partition_root_shortest", "D", lambda v: rollup.partition_root(v, "src1", "shortest"), "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM {V} WHERE partition = 'src1' ORDER BY length(path), path LIMIT 1")

_STALE = NOW_L - 1500 * DAY
_add("stale_report", "L", lambda v: report.stale_report(v, NOW_L, 1500), f"SELECT partition, count(*) AS file_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM {{V}} WHERE atime < {_STALE} GROUP BY partition")
_add("usage_by_user", "E", lambda v: report.usage_by_user(v.withColumn("path", F.replace("path", F.lit("/scratch/"), F.lit("/home/")))).select("user", "total_size"),
     "SELECT regexp_extract(replace(path, '/scratch/', '/home/'), '/home/([^/]+)/', 1) AS user, CAST(sum(size) AS BIGINT) AS total_size FROM {V} GROUP BY 1")
_add("largest_stale_files", "L", lambda v: report.largest_stale_files(v, NOW_L, 180), f"SELECT path, size, atime FROM {{V}} WHERE atime < {NOW_L - 180 * DAY} ORDER BY size DESC, path, atime LIMIT 100")
_add("single_partition_total", "E", lambda v: report.partition_total(v, "u7").select("total_size", F.round("gb", 6).alias("gb")), "SELECT CAST(sum(size) AS BIGINT) AS total_size, round(sum(size) / 1e9, 6) AS gb FROM {V} WHERE partition = 'u7'")
_add("derive_partition", "D", lambda v: v.select("path", paths.derive_partition(F.col("path"), TOPS["D"]).alias("partition")), "SELECT path, partition FROM {V}")
_add("path_parts", "W", lambda v: v.select("path", paths.file_name(F.col("path")).alias("name"), paths.component(paths.rest_after(F.col("path"), "/web/")).alias("component"), paths.is_dir(paths.rest_after(F.col("path"), "/web/")).alias("is_dir"), paths.user_of(F.col("path")).alias("user")),
     "SELECT path, split_part(path, '/', -1) AS name, split_part(substr(path, 6), '/', 1) AS component, position('/' IN substr(path, 6)) > 0 AS is_dir, regexp_extract(path, '/home/([^/]+)/', 1) AS user FROM {V}")
_add("round_to_block", "L", lambda v: v.select("path", "size", sizes.round_to_block(F.col("size"), 4096).alias("rounded"), sizes.round_to_block(F.col("size"), 0).alias("same")), "SELECT path, size, (size + 4095) // 4096 * 4096 AS rounded, size AS same FROM {V}")
_add("size_mode", "L", lambda v: v.select("path", *[m.calculate(F.col("size") + 512, F.col("size")).alias(m.kind) for m in (sizes.SizeMode(), sizes.SizeMode("apparent"), sizes.SizeMode("block", 131072))]),
     "SELECT path, size + 512 AS disk, size AS apparent, (size + 131071) // 131072 * 131072 AS block FROM {V}")
_KIB = "CASE WHEN size >= 1099511627776 THEN format('{:.2f} TiB', size / 1099511627776) WHEN size >= 1073741824 THEN format('{:.2f} GiB', size / 1073741824) WHEN size >= 1048576 THEN format('{:.2f} MiB', size / 1048576) WHEN size >= 1024 THEN format('{:.2f} KiB', size / 1024) ELSE concat(size, ' B') END"
_add("format_bytes", "E", lambda v: v.select("path", sizes.format_bytes_col(F.col("size")).alias("text")), f"SELECT path, {_KIB} AS text FROM {{V}}")
_CNT = "CASE WHEN size >= 1000000000 THEN format('{:.1f}B', size / 1e9) WHEN size >= 1000000 THEN format('{:.1f}M', size / 1e6) WHEN size >= 1000 THEN format('{:.1f}K', size / 1e3) ELSE CAST(size AS VARCHAR) END"
_add("format_count", "L", lambda v: v.select("path", sizes.format_count_col(F.col("size")).alias("text")), f"SELECT path, {_CNT} AS text FROM {{V}}")
_add("format_file_count", "L", lambda v: v.select("path", sizes.format_file_count_col(F.col("size")).alias("text")), f"SELECT path, CASE WHEN size = 1 THEN '1 file' ELSE concat({_CNT}, ' files') END AS text FROM {{V}}")
_add("format_speed", "L", lambda v: v.select("path", sizes.format_speed_col(F.col("size").cast("double")).alias("text")),
     "SELECT path, CASE WHEN size >= 1000000 THEN format('{:.1f}M files/s', size / 1e6) WHEN size >= 1000 THEN format('{:.1f}k files/s', size / 1e3) ELSE format('{:.0f} files/s', CAST(size AS DOUBLE)) END AS text FROM {V}")
_D = f"(({NOW_L} - atime) // 86400)"
_ago = lambda n, unit: f"CASE WHEN {n} = 1 THEN '1 {unit} ago' ELSE concat({n}, ' {unit}s ago') END"
_add("format_atime", "L", lambda v: v.select("path", "atime", sizes.format_atime_col(F.col("atime"), NOW_L).alias("text")),
     f"SELECT path, atime, CASE WHEN atime = 0 THEN '' WHEN atime > {NOW_L} THEN 'future' WHEN {_D} = 0 THEN 'today' WHEN {_D} < 30 THEN {_ago(_D, 'day')} WHEN {_D} < 365 THEN {_ago(f'({_D} // 30)', 'month')} ELSE {_ago(f'({_D} // 365)', 'year')} END AS text FROM {{V}}")
_add("parse_size", "L", lambda v: v.select("path", sizes.parse_size_col(F.concat((F.col("size") % 1000).cast("string"), F.lit(".5"), F.element_at(F.array(*map(F.lit, ["K", "MiB", "b", "g", " TIB", ""])), (F.col("size") % 6 + 1).cast("int")))).alias("bytes")),
     "SELECT path, CAST(trunc((size % 1000 + 0.5) * CASE size % 6 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1 WHEN 3 THEN 1073741824 WHEN 4 THEN 1099511627776 ELSE 1 END) AS BIGINT) AS bytes FROM {V}")
_add("strip_ansi", "D", lambda v: v.select("path", paths.strip_ansi(F.concat(F.lit("\x1b[1;31m"), "path", F.lit("\x1b[0m\x1b]0;t\x07\x1bM"), "size", F.lit("\x1b"))).alias("text")), "SELECT path, concat(path, size) AS text FROM {V}")

_SAFE = FilterSpec(older_than=NOW_E - 15 * DAY, max_size=60 * KB)
_add("rm_candidates", "E", lambda v: purge.candidates(v, _SAFE, limit=200, order_by=["atime", "path"]), f"SELECT path, size, atime FROM {{V}} WHERE atime < {NOW_E - 15 * DAY} AND size <= {60 * KB} ORDER BY atime, path LIMIT 200")


def _fresh(v: DataFrame) -> DataFrame:
    """The files some time later: of every eleven one gone, of every seven one read, of every five one grown."""
    h = F.col("size")
    return v.filter(h % 11 != 0).select("path", F.when(h % 5 == 0, h + 100_000).otherwise(h).alias("size"), F.when(h % 7 == 0, F.lit(NOW_E)).otherwise(F.col("atime")).alias("atime"))


_add("safe_mode_recheck", "E", lambda v: purge.recheck(v, _fresh(v), _SAFE),
     f"SELECT path, CASE WHEN size % 11 = 0 THEN 'missing' WHEN size % 7 = 0 OR (size % 5 = 0 AND size + 100000 > {60 * KB}) THEN 'skipped' ELSE 'delete' END AS status FROM {{V}} WHERE atime < {NOW_E - 15 * DAY} AND size <= {60 * KB}")
_add("rm_outcome_counts", "E", lambda v: purge.counts(purge.recheck(v, _fresh(v), _SAFE)),
     f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN size % 11 = 0 THEN 'missing' WHEN size % 7 = 0 OR (size % 5 = 0 AND size + 100000 > {60 * KB}) THEN 'skipped' ELSE 'delete' END AS status FROM {{V}} WHERE atime < {NOW_E - 15 * DAY} AND size <= {60 * KB}) GROUP BY status")


def detect_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the pages' and documents' first bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("/web/"), "page_id", F.lit(".html")).alias("path"), F.substr("html", F.lit(1), F.lit(8192)).alias("head"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/docs/"), "doc_id", F.lit(".txt")).alias("path"), F.substr("text", F.lit(1), F.lit(8192)).alias("head"))
    both = pages.unionByName(docs).withColumn("type", file_type(F.col("head").cast("binary"), "path"))
    return both.select("path", "type.description", "type.is_text")


_QUERIES["detect_file_type"] = detect_file_type
_BYTES = "hex(encode(substr(head, 1, 8192)))"
_BY_MAGIC = " ".join(f"WHEN substr({_BYTES}, {2 * at + 1}, {2 * len(magic)}) = '{magic.hex().upper()}' THEN '{mime} ({ext})'" for at, magic, mime, ext in _MAGIC)
_TRIMMED = "regexp_replace(head, '^\\s+', '')"
_SQL["detect_file_type"] = f"""WITH f AS (SELECT concat('/web/', page_id, '.html') AS path, html AS head FROM pages UNION ALL SELECT concat('/docs/', doc_id, '.txt'), text FROM documents),
 t AS (SELECT path, CASE WHEN head IS NULL OR head = '' THEN '(unreadable)' {_BY_MAGIC} WHEN regexp_matches({_TRIMMED}, '^[{{\\[]') THEN 'JSON text, UTF-8' WHEN starts_with({_TRIMMED}, '<?xml') OR starts_with({_TRIMMED}, '<!DOCTYPE') THEN 'XML text, UTF-8'
  WHEN ends_with(path, '.html') THEN 'HTML text, UTF-8' ELSE 'Plain text, UTF-8' END AS description FROM f)
SELECT path, description, NOT (description = '(unreadable)' OR contains(description, '(') ) AS is_text FROM t"""

#: (bytes before a page in hex, extension, description, is text) by page_id modulo their number.
_HEADS = [
    ("89504E470D0A1A0A", "html", "image/png (png)", False), ("1F8B08", "txt", "application/gzip (gz)", False), ("7F454C4602010100" + "00" * 8 + "02003E00", "so", "ELF 64-bit LSB executable, x86-64", False),
    ("7F454C4601020100" + "00" * 8 + "00010008", "o", "ELF 32-bit MSB relocatable, MIPS", False), ("CFFAEDFE070000010300000006000000", "dylib", "Mach-O 64-bit dylib, x86-64", False), ("CAFEBABE00000002", "class", "Mach-O universal binary", False),
    (b"#!/usr/bin/env python3\n".hex(), "", "Python script, UTF-8 text", True), (b"#! /bin/zsh -f\n".hex(), "txt", "Zsh script, UTF-8 text", True), (b"#!/opt/odd\n".hex(), "txt", "Script (#!odd), UTF-8 text", True), (b" \n[1, ".hex(), "csv", "JSON text, UTF-8", True),
    (b"<?xml version='1.0'?>".hex(), "csv", "XML text, UTF-8", True), ("FEFF00FF", "txt", "application/octet-stream (binary data)", False), (b"x = 1\n".hex(), "PY", "Python source, UTF-8", True), (b"x\n".hex(), "hpp", "C++ header, UTF-8", True),
    (b"x\n".hex(), "ps1", "PowerShell script, UTF-8", True), (b"x\n".hex(), "rst", "reStructuredText, UTF-8", True), (b"x\n".hex(), "unknown", "text/plain; UTF-8", True), (b"x\n".hex(), "", "text/plain; UTF-8", True),
]


def detect_made_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules one by one: pages with bytes before them that make them look like other files."""
    k = F.col("page_id") % len(_HEADS)
    one = lambda i: F.element_at(F.array(*[F.lit(h[i]) for h in _HEADS]), (k + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.concat(F.lit("/web/"), F.col("page_id").cast("string"), F.when(one(1) != "", F.concat(F.lit("."), one(1))).otherwise(""))
    made = pages.select(name.alias("path"), F.concat(F.unhex(one(0)), F.substr("html", F.lit(1), F.lit(8192)).cast("binary")).alias("head"))
    return made.withColumn("type", file_type("head", "path")).select("path", "type.description", "type.is_text")


_QUERIES["detect_made_types"] = detect_made_types
_LIST = lambda i: "[" + ", ".join(f"'{h[i]}'" for h in _HEADS) + "]"
_SQL["detect_made_types"] = f"""SELECT concat('/web/', page_id, CASE WHEN e = '' THEN '' ELSE concat('.', e) END) AS path, {_LIST(2)}[k] AS description, [{", ".join(str(h[3]).lower() for h in _HEADS)}][k] AS is_text
FROM (SELECT page_id, k, {_LIST(1)}[k] AS e FROM (SELECT page_id, CAST(page_id % {len(_HEADS)} AS INTEGER) + 1 AS k FROM pages))"""

# Over an index that was written, not over a computed view: what the reader prunes and pushes down counts here.
_written: dict[tuple, str] = {}


def _indexed(spark: SparkSession, sf_dir: str, on: str, kind: str = "native") -> str:
    """The index of a view, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, on, kind)
    if key not in _written:
        path = own_folder(spark, f"index-{on}")
        v = view(spark, sf_dir, on)
        write_index(v, path, rows_per_file=5_000, full=True, layout="native" if kind == "bare" else None)
        if kind == "bare":
            to_bare(spark, path)
        elif kind == "again":
            # Of these partitions two keep some of their files and one keeps none.
            left = v.filter(F.col("partition").isin("u1", "u3") & (F.col("size") % 2 == 0))
            replace_partitions(left.withColumn("size", F.col("size") + 1), path, ["u1", "u2", "u3"])
        _written[key] = path
    return _written[key]


def _add_indexed(name: str, on: str, build: Callable[[SparkSession, str], DataFrame], oracle: str, kind: str = "native") -> None:
    _QUERIES[name] = lambda spark, sf_dir: build(spark, _indexed(spark, sf_dir, on, kind))
    _SQL[name] = oracle.replace("{V}", f"{sql(on)} v")


_ALL = "SELECT path, size, atime, partition FROM {V}"
_add_indexed("index_scan", "D", lambda spark, path: read_index(spark, path), _ALL)
_add_indexed("index_scan_bare", "D", lambda spark, path: read_index(spark, path), _ALL, "bare")
_add_indexed("index_partition", "E", lambda spark, path: read_index(spark, path, "u7"), _ALL + " WHERE partition = 'u7'")
_add_indexed("index_partition_bare", "D", lambda spark, path: read_index(spark, path, "src1"), _ALL + " WHERE partition = 'src1'", "bare")
_add_indexed("index_root", "D", lambda spark, path: read_root(spark, path), _ALL + " WHERE partition = '__root__'")
_add_indexed("index_file_partition", "D", lambda spark, path: read_index(spark, path).groupBy(F.replace(paths.partition_of_file(F.col("_metadata.file_path")), F.lit("partition=")).alias("partition")).agg(F.count("*").alias("file_count")),
             "SELECT partition, count(*) AS file_count FROM {V} GROUP BY partition")
_add_indexed("index_replaced", "E", lambda spark, path: read_index(spark, path), "SELECT path, CASE WHEN partition IN ('u1', 'u3') THEN size + 1 ELSE size END AS size, atime, partition FROM {V} WHERE partition NOT IN ('u1', 'u2', 'u3') OR (partition <> 'u2' AND size % 2 = 0)", "again")
_add_indexed("index_find_combined", "L", lambda spark, path: find.find(read_index(spark, path), _COMBINED, fmt="csv"), f"SELECT path, size, atime FROM {{V}} WHERE {_COMBINED_SQL}")
_add_indexed("index_find_suffix", "L", lambda spark, path: find.find(read_index(spark, path), FilterSpec(pattern=r"\.py$", min_size=9_000_000), "s7"), "SELECT path FROM {V} WHERE partition = 's7' AND size >= 9000000 AND ends_with(path, '.py')")
_add_indexed("index_count", "L", lambda spark, path: find.count(read_index(spark, path)), "SELECT count(*) AS file_count FROM {V}")
_add_indexed("index_directory_rollup", "L", lambda spark, path: rollup.directory_rollup(read_index(spark, path), "/fs/s7/", partition="s7"), _rollup_sql("/fs/s7/"))
_add_indexed("index_stale_report", "L", lambda spark, path: report.stale_report(read_index(spark, path), NOW_L, 1500), f"SELECT partition, count(*) AS file_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM {{V}} WHERE atime < {_STALE} GROUP BY partition")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 8 KiB and more under click/, not read for a while, the largest first."""
    spec = FilterSpec(pattern="/click/", min_size=8 * KB, older_than=NOW_E - 10 * DAY)
    return find.find(view(spark, sf_dir, "E").filter(F.col("partition") != ROOT_PARTITION), spec, fmt="size")


_QUERIES["entry"] = entry
_SQL["entry"] = f"SELECT size, path FROM {sql('E')} v WHERE regexp_matches(path, '/click/') AND size >= {8 * KB} AND atime < {NOW_E - 10 * DAY}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
