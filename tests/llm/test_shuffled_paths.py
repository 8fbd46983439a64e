"""The ways beyond the bounds of broadcasts give the same results."""

from collections import Counter

from fsaudit.llm import neardup, suffix


def rows(df):
    return Counter(map(str, df.collect()))


def test_joins_by_shuffle_equal_broadcasts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = rows(suffix.report(docs)), rows(suffix.clean(docs)), rows(neardup.clean(docs))
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", -1)
    assert (rows(suffix.report(docs)), rows(suffix.clean(docs)), rows(neardup.clean(docs))) == want
