"""File-index views over the driver's tables, for queries and benches: (path, size, atime, partition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fsaudit.functions.paths import derive_partition

_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ))"
TOPS = {"E": "/scratch", "D": "/docs", "W": "/web", "L": "/fs"}
#: Clocks for queries by age.
NOW_E, NOW_L = 1_706_745_600, 1_009_843_200


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "E":
        df = read("events").select(F.concat(F.lit("/scratch/u"), "user_id", F.lit("/"), "event_type", F.lit("/"), "event_id", F.lit(".log")).alias("path"), F.floor(F.col("value") * 1024).cast("long").alias("size"), F.expr(_EPOCH.format("ts")).alias("atime"))
    elif name == "D":
        loose = F.concat(F.lit("/docs/"), "doc_id", F.lit(".txt"))
        path = F.when(F.col("doc_id") % 50 == 0, loose).otherwise(F.concat(F.lit("/docs/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")))
        df = read("documents").select(path.alias("path"), F.col("n_chars").cast("long").alias("size"), (F.lit(1_700_000_000) + F.col("doc_id") * 3600).cast("long").alias("atime"))
    elif name == "W":
        df = read("pages").select(F.concat(F.lit("/web/"), F.regexp_replace("url", "^https?://", "")).alias("path"), F.length("html").cast("long").alias("size"), (F.lit(1_700_000_000) + F.col("page_id") * 86_400).cast("long").alias("atime"))
    else:
        end = F.when(F.col("l_returnflag") == "R", ".tmp").when(F.col("l_returnflag") == "A", ".log").otherwise(".py")
        path = F.concat(F.lit("/fs/s"), "l_suppkey", F.lit("/p"), F.col("l_partkey") % 10, F.lit("/o"), "l_orderkey", F.lit("."), "l_linenumber", end)
        df = read("lineitem").select(path.alias("path"), F.floor(F.col("l_extendedprice") * 100).cast("long").alias("size"), F.expr(_EPOCH.format("l_shipdate")).alias("atime"))
    return df.withColumn("partition", derive_partition(F.col("path"), TOPS[name]))


_SQL = {
    "E": "SELECT concat('/scratch/u',user_id,'/',event_type,'/',event_id,'.log') AS path, CAST(floor(value*1024) AS BIGINT) AS size, epoch_us(ts)//1000000 AS atime FROM events",
    "D": "SELECT CASE WHEN doc_id%50=0 THEN concat('/docs/',doc_id,'.txt') ELSE concat('/docs/',source,'/',lang,'/',doc_id,'.txt') END AS path, CAST(n_chars AS BIGINT) AS size, CAST(1700000000+doc_id*3600 AS BIGINT) AS atime FROM documents",
    "W": "SELECT concat('/web/',regexp_replace(url,'^https?://','')) AS path, CAST(length(html) AS BIGINT) AS size, CAST(1700000000+page_id*86400 AS BIGINT) AS atime FROM pages",
    "L": "SELECT concat('/fs/s',l_suppkey,'/p',l_partkey%10,'/o',l_orderkey,'.',l_linenumber, CASE l_returnflag WHEN 'R' THEN '.tmp' WHEN 'A' THEN '.log' ELSE '.py' END) AS path, CAST(floor(l_extendedprice*100) AS BIGINT) AS size, epoch_us(l_shipdate)//1000000 AS atime FROM lineitem",
}


def sql(name: str) -> str:
    """The view in DuckDB's dialect."""
    n = len(TOPS[name]) + 2
    return f"(SELECT *, CASE WHEN position('/' IN substr(path,{n}))>0 THEN split_part(substr(path,{n}),'/',1) ELSE '__root__' END AS partition FROM ({_SQL[name]}))"
