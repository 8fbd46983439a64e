"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, other ones among them, whatever their names.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables; what becomes of them is said at each. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fsaudit.llm import _frames, decontam, langid, neardup, packing, suffix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay. Null and empty texts, and those without letters, go; a null label only keeps a row out of training; repeated rows are judged alike."""
    return langid.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the largest, then the one with the least doc_id, null last. Texts without words stay; rows that repeat doc_id and text are one document, and stay or go together."""
    return neardup.clean(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier in the corpus, by doc_id, null first, are cut; a document of which nothing is left goes. Null and empty texts and rows that repeat doc_id and text are left alone."""
    return suffix.clean(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that mostly consist of them go. Null and empty texts stay; repeated rows are judged alike; items with a null id count."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most ``packing.CAPACITY`` tokens. Null and empty texts are in none; repeated rows are packed as often as they occur; a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Cross parsing, MinHash and the packing rule are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _frames.own_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # the stage before is read by nothing any more
            _frames.drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
