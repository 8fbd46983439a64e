"""The registered queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fsaudit.llm import decontam, langid, license, mpegts, neardup, packing, quality, suffix, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a transport stream, taken apart again."""
    x = mpegts.demux(mpegts.mux_pages(_table(spark, sf_dir, "pages")))
    return x.select(
        "doc_id", "program", "pid", "stream_type", "cc_errors", F.size("pts").cast("long").alias("n_pes"), F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"),
        F.array_join("pts", ",").alias("timestamps"), F.array_join("random_access", ",").alias("random_access"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with repeated passages and document that holds a first occurrence of one."""
    x = suffix.report(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws("-", s["starts"], s["ends"])), ",")
    return x.select("doc_id", F.explode("first_doc_ids").alias("first_doc_id"), "n_words", "n_removed", spans.alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_words", "n_hits", "n_covered", F.array_join("items", ",").alias("items"), "action")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license.report(docs, license.own_licenses(docs))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.report(pages, urlfilter.build(urlfilter.sample_list(pages)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC files, indexed; of each payload the first record is read back."""
    files = warc.write(_table(spark, sf_dir, "pages"))
    x = warc.read(warc.first_of_digest(warc.index(files)))
    return x.select(F.regexp_extract("record_id", "urn:page:([0-9]+)", 1).cast("long").alias("page_id"), "url", F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("md5"), "ok")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality, op2_transport_streams, op3_suffix_dedup, op4_decontaminate, op5_license, op6_near_dedup, op7_url_filter, op8_warc, op9_pack, op10_language, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_transport_streams": mpegts.ORACLE,
        "op3_suffix_dedup": suffix.ORACLE,
        "op4_decontaminate": decontam.ORACLE,
        "op5_license": license.oracle(),
        "op7_url_filter": urlfilter.ORACLE,
        "op8_warc": warc.ORACLE,
    }
