"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are those of ``_text`` kind ALNUM: lower case, ASCII punctuation dropped.
An item of at least ``n`` words gives all its runs of ``n`` words; a shorter one
of at least ``min_words`` gives itself as one run; still shorter ones, empty and
null ones give nothing, as their words occur anywhere. Every window of a training
document whose hash is in the set is compared word by word with the test n-grams of
that hash. Words under a hit are covered. If the covered share of a document's words
reaches ``drop_share`` the document goes, else the covered spans do.

Defined results: null and empty texts have no hit; an item with a null item_id counts like any other, but ``items`` can't name it; items
that repeat an item_id count all; repeated rows are judged alike; empty tables give empty results; other columns are kept and never looked at.

Scale: one pass over the documents and no shuffle while the benchmark's text is
within ``broadcast_bytes`` (measured, not assumed). Beyond it the n-grams of both
sides are joined on their hashes instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

N, MIN_WORDS, DROP_SHARE, BROADCAST_BYTES = 13, 5, 0.5, 32 << 20
#: Stands for a null doc_id.
NULL = -(2**63)
REPORT = "doc_id long, n_words long, n_hits long, n_covered long, items array<long>, action string, clean_text string"


class GramSet:
    """Sorted n-gram hashes by length, each with its words and items."""

    def __init__(self, items: list[tuple[int, str]], n: int, min_words: int):
        grams: dict[int, dict[int, dict[bytes, set[int]]]] = {}
        col = _text.lower(pa.array([t for _, t in items], pa.string()))
        data, offsets = _text.buffers(col)
        w = _text.Words(data, offsets, "ALNUM")
        h = w.hashes()
        raw = data.tobytes()
        for k, (item, _) in enumerate(items):
            a, b = w.first[k], w.first[k + 1]
            size = min(n, int(b - a))
            if size < min_words:
                continue
            one = np.zeros(int(b - a), np.int64)
            sub = _Slice(one)
            keys, at = _text.Words.grams(sub, h[a:b], size)
            for key, i in zip(keys.tolist(), at.tolist()):
                words = b" ".join(raw[s:e] for s, e in zip(w.start[a + i : a + i + size], w.end[a + i : a + i + size]))
                grams.setdefault(size, {}).setdefault(key, {}).setdefault(words, set()).add(item)
        self.by_size = {s: (np.array(sorted(g), np.uint64), g) for s, g in grams.items()}

    def hits(self, w: _text.Words, h: np.ndarray, raw: bytes) -> list[tuple[int, int, set[int]]]:
        """(first word, words, items) of every verified window."""
        found = []
        for size, (keys, grams) in self.by_size.items():
            x, at = w.grams(h, size)
            k = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            for i in np.flatnonzero(keys[k] == x).tolist():
                f = int(at[i])
                words = b" ".join(raw[s:e] for s, e in zip(w.start[f : f + size], w.end[f : f + size]))
                if items := grams[int(x[i])].get(words):
                    found.append((f, size, items))
        return found


class _Slice:
    """Stands in for Words where all words are of one row."""

    def __init__(self, row: np.ndarray):
        self.row = row


def _judge(hits: list[tuple[int, int, set]], words: int, drop_share: float) -> tuple[np.ndarray, bool]:
    covered = np.zeros(words, bool)
    for f, size, _ in hits:
        covered[f : f + size] = True
    return covered, bool(covered.sum() >= drop_share * words)


def _without(text: str, covered: np.ndarray) -> str:
    """The text without its covered words, each with the separators up to the next word."""
    data, offsets = _text.buffers(pa.array([text], pa.string()))
    w = _text.Words(data, offsets, "CASED")
    keep = np.ones(len(data), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        keep[w.start[a] : w.start[b] if b < len(w) else len(data)] = False
    return data[keep].tobytes().decode("utf-8", "replace").rstrip() if not keep.all() else text


def _scan(texts: pa.Array, grams: GramSet) -> Iterator[tuple[int, list, int]]:
    """(row, hits with word numbers inside the row, words) of the rows with hits."""
    data, offsets = _text.buffers(_text.lower(texts))
    for i, j in _text.blocks(offsets):
        w = _text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "ALNUM")
        if not len(w):
            continue
        by_row: dict[int, list] = {}
        for f, size, items in grams.hits(w, w.hashes(), w.data.tobytes()):
            r = int(w.row[f])
            by_row.setdefault(r, []).append((f - int(w.first[r]), size, items))
        for r, hits in by_row.items():
            yield i + r, hits, int(w.first[r + 1] - w.first[r])


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")


def _small(bench: DataFrame, most: int) -> bool:
    return (_items(bench).agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= most


def _gram_set(bench: DataFrame, n: int, min_words: int) -> GramSet:
    return GramSet([(r.item_id, r.text) for r in _items(bench).collect()], n, min_words)


def _line(doc_id, text: str, hits: list, words: int, drop_share: float) -> tuple:
    covered, drop = _judge(hits, words, drop_share)
    items = sorted(set().union(*[x for _, _, x in hits]) - {None})
    at = {(f, s) for f, s, _ in hits}
    return doc_id, words, len(at), int(covered.sum()), items, "document" if drop else "span", None if drop else _without(text, covered)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_hits", "n_covered", "items", "action", "clean_text"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _joined_hits(docs: DataFrame, bench: DataFrame, n: int, min_words: int) -> DataFrame:
    """The same hits by a shuffled join on n-gram hashes: rid, doc (with ``NULL`` for a null doc_id), doc_id, text, hits."""

    def bench_grams(batches):
        for b in batches:
            g = GramSet(list(zip(b["item_id"].to_pylist(), b["text"].to_pylist())), n, min_words)
            rows = [(s, k - 2**63, words, i) for s, (_, by) in g.by_size.items() for k, x in by.items() for words, its in x.items() for i in its]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.int64()])], names=["size", "gram", "words", "item"])

    held = _frames.keep(_items(bench).transform(_frames.mapped, bench_grams, "size int, gram long, words binary, item long"))
    sizes = sorted(r[0] for r in held.select("size").distinct().collect())  # n at most

    def doc_grams(batches):
        for b in batches:
            data, offsets = _text.buffers(_text.lower(b["text"]))
            rid, doc = np.asarray(b["rid"]), np.asarray(b["doc"])
            for i, j in _text.blocks(offsets):
                w = _text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "ALNUM")
                h = w.hashes()
                for s in sizes:
                    x, at = w.grams(h, s)
                    r = w.row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[i:j][r]), pa.array(doc[i:j][r]), pa.array((at - w.first[r]).astype(np.int32)), pa.array(np.full(len(x), s, np.int32)), pa.array((x ^ np.uint64(2**63)).view(np.int64))], names=["rid", "doc", "pos", "size", "gram"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _frames.rid("doc_id", "text").alias("rid"))
    own = own.withColumn("doc", F.coalesce("doc_id", F.lit(NULL)))
    hits = own.select("rid", "doc", "text").transform(_frames.mapped, doc_grams, "rid long, doc long, pos int, size int, gram long").join(held, ["size", "gram"])
    return own.join(hits.groupBy("rid", "doc").agg(F.collect_set(F.struct("pos", "size", "words", "item")).alias("hits")), ["rid", "doc"])


def _verified(text: str, hits: list[dict]) -> tuple[list, int]:
    data, offsets = _text.buffers(_text.lower(pa.array([text], pa.string())))
    w, raw, out = _text.Words(data, offsets, "ALNUM"), data.tobytes(), []
    for x in hits:
        f, s = x["pos"], x["size"]
        if b" ".join(raw[a:b] for a, b in zip(w.start[f : f + s], w.end[f : f + s])) == bytes(x["words"]):
            out.append((f, s, {x["item"]}))
    return out, len(w)


def report(docs: DataFrame, bench: DataFrame, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document with hits (and per repetition of it): doc_id, n_words, n_hits (windows), n_covered (words), items, action
    ("span" or "document"), clean_text (null if the document goes)."""
    spark = docs.sparkSession
    _frames.bounded_batches(spark)
    if not _small(bench, broadcast_bytes):

        def lines(batches):
            for b in batches:
                rows = []
                for d, t, hs in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["hits"].to_pylist()):
                    hits, words = _verified(t, hs)
                    if hits:
                        rows.append(_line(d, t, hits, words, drop_share))
                yield _table(rows)

        return _joined_hits(docs, bench, n, min_words).select("doc_id", "text", "hits").transform(_frames.mapped, lines, REPORT)
    grams = spark.sparkContext.broadcast(_gram_set(bench, n, min_words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_line(b["doc_id"][r].as_py(), b["text"][r].as_py(), hits, words, drop_share) for r, hits, words in _scan(b["text"], grams.value)]
            yield _table(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(_frames.mapped, scan, REPORT)


def clean(docs: DataFrame, bench: DataFrame, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with the decisions taken: dropped ones gone, covered spans cut from ``text``, ``n_chars`` (if there) counted anew."""
    _frames.bounded_batches(docs.sparkSession)
    if not _small(bench, broadcast_bytes):
        hits = _joined_hits(docs, bench, n, min_words).select("rid", "doc", "text", "hits")

        def decide(batches):
            for b in batches:
                rows = []
                for r, d, t, hs in zip(b["rid"].to_pylist(), b["doc"].to_pylist(), b["text"].to_pylist(), b["hits"].to_pylist()):
                    found, words = _verified(t, hs)
                    if found:
                        covered, drop = _judge(found, words, drop_share)
                        rows.append((r, d, None if drop else _without(t, covered)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string()])], names=["rid", "doc", "cleaned"])

        rid, doc, cleaned, hit = (_frames.fresh(docs, x) for x in ("__rid", "__doc", "__cleaned", "__hit"))
        done = hits.transform(_frames.mapped, decide, "rid long, doc long, cleaned string").select(F.col("rid").alias(rid), F.col("doc").alias(doc), F.col("cleaned").alias(cleaned), F.lit(True).alias(hit)).dropDuplicates([rid, doc])
        own = F.col("doc_id").cast("long")
        marked = docs.withColumns({rid: F.xxhash64(own, F.col("text").cast("string")), doc: F.coalesce(own, F.lit(NULL))})
        out = marked.join(done, [rid, doc], "left").filter(F.col(hit).isNull() | F.col(cleaned).isNotNull())
        new = F.when(F.col(hit), F.col(cleaned)).otherwise(F.col("text"))
        changed = {"text": new} | ({"n_chars": F.when(F.col(hit), F.length(new)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
        return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in docs.columns])
    grams = docs.sparkSession.sparkContext.broadcast(_gram_set(bench, n, min_words))

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = {}, np.ones(b.num_rows, bool)
        for r, hits, words in _scan(b["text"], grams.value):
            covered, drop = _judge(hits, words, drop_share)
            keep[r] = not drop
            if not drop:
                texts[r] = _without(b["text"][r].as_py(), covered)
        return replace_texts(b, texts, keep)

    return _frames.same_columns(docs, apply)


def replace_texts(b: pa.RecordBatch, texts: dict[int, str], keep: np.ndarray) -> pa.RecordBatch:
    """The batch with some rows' texts changed, n_chars counted anew for them, and some rows gone."""
    if texts:
        mask = np.zeros(b.num_rows, bool)
        mask[list(texts)] = True
        new = pa.array([texts[r] for r in sorted(texts)], b["text"].type)
        text = pc.replace_with_mask(b["text"], pa.array(mask), new)
        if "n_chars" in b.schema.names:
            k = b.schema.field("n_chars").type
            b = _frames.set_column(b, "n_chars", pc.replace_with_mask(b["n_chars"], pa.array(mask), pc.utf8_length(new).cast(k)))
        b = _frames.set_column(b, "text", text)
    return b if keep.all() else b.filter(pa.array(keep))


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM benchmark),
 s AS (SELECT item_id, w, least({N}, len(w)) AS size FROM b WHERE len(w) >= {MIN_WORDS}),
 g AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram FROM (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM s)),
 p AS (SELECT rn, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM s)),
 h AS (SELECT rn, i, p.size, item_id FROM (SELECT rn, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram FROM p) p JOIN g ON p.size = g.size AND p.gram = g.gram),
 c AS (SELECT rn, count(DISTINCT k) AS n_covered FROM (SELECT rn, unnest(generate_series(i, i + size - 1)) AS k FROM h) GROUP BY rn),
 a AS (SELECT rn, count(DISTINCT (i, size)) AS n_hits, coalesce(string_agg(DISTINCT item_id, ',' ORDER BY item_id), '') AS items FROM h GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, n_hits, n_covered, items,
 CASE WHEN n_covered >= {DROP_SHARE} * len(w) THEN 'document' ELSE 'span' END AS action
FROM d JOIN a USING (rn) JOIN c USING (rn)"""
