"""Best-fit packing by the sum-of-squares rule.

A bin holds ``capacity`` tokens. Documents longer than that are cut into pieces: full
ones, each a bin of its own, and a rest. The pieces of each shard arrive in the order
of (hash of doc_id, doc_id, length, piece) and each goes where the sum over residual gaps g in
1..capacity-1 of (number of open bins with gap g) squared becomes smallest; a new bin
is one of the choices; of equal choices the smallest gap wins, and a new bin loses.
Of the bins with the chosen gap, the one opened first is taken.

Tokens are counted with ``length``, a column expression (words between white space by default).
Defined results: null and empty texts have no tokens and are in no bin; repeated rows
are packed as often as they occur; an empty table gives no bins; a null doc_id is kept as null, and such documents are spread over the shards by the hash of their text.

Scale: only (doc_id, hash, length) is shuffled. Shards are residues of the hash, one for about
``shard_docs`` documents, so the order in a shard is random as the rule's analysis wants
it and the loss from open bins at a shard's end is below a bin or two per gap class.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

CAPACITY, SHARD_DOCS = 2048, 50_000
#: Stands for a null doc_id inside a shard, where pandas would turn ids with nulls into floats.
NULL = -(2**63)
SCHEMA = "shard int, bin int, n_tokens int, n_pieces int, doc_ids array<long>, starts array<long>, lengths array<int>"


def _words(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            data, offsets = _text.buffers(b["text"])
            n = [np.diff(_text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "SPACE").first) for i, j in _text.blocks(offsets)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["order"], pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], names=["doc_id", "order", "n"])

    _frames.bounded_batches(docs.sparkSession)
    return docs.select(*_id(), F.col("text").cast("string").alias("text")).transform(_frames.mapped, run, "doc_id long, order long, n long")


def _id() -> list[Column]:
    """doc_id, and the hash that gives its place: of doc_id, or of the text for a null one."""
    doc = F.col("doc_id").cast("long")
    return [doc.alias("doc_id"), F.when(doc.isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.xxhash64(doc)).alias("order")]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, all of 1..capacity-1 tokens, in order of arrival."""
    count = np.zeros(capacity + 1, np.int64)
    waiting: dict[int, deque] = {}
    out = np.empty(len(sizes), np.int64)
    bins = 0
    for k, s in enumerate(sizes.tolist()):
        # Gap g loses a bin: -2N(g)+1. Gap g-s gains one: 2N(g-s)+1, nothing if it is 0, as full bins are closed.
        delta = 2 * (count[0 : capacity - s] - count[s:capacity])
        delta[1:] += 2
        delta[0] = 1 - 2 * count[s]
        delta[count[s:capacity] == 0] = np.iinfo(np.int64).max
        g = int(delta.argmin())
        if delta[g] <= 2 * count[capacity - s] + 1 and count[g + s]:
            b = waiting[g + s].popleft()
            count[g + s] -= 1
        else:
            b, g = bins, capacity - s
            bins += 1
        out[k] = b
        if g:
            count[g] += 1
            waiting.setdefault(g, deque()).append(b)
    return out


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "n"], kind="stable").reset_index(drop=True)
    n = pdf["n"].to_numpy(np.int64)
    full, rest = n // capacity, n % capacity
    has = np.flatnonzero(rest)
    bins = sum_of_squares(rest[has], capacity)
    first = int(bins.max()) + 1 if len(bins) else 0
    src = np.concatenate([has, np.repeat(np.arange(len(n)), full)])
    nth = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    where = np.concatenate([bins, first + np.arange(int(full.sum()))])
    start = np.concatenate([full[has] * capacity, nth * capacity])
    size = np.concatenate([rest[has], np.full(int(full.sum()), capacity)])
    o = np.argsort(where, kind="stable")
    src, where, start, size = src[o], where[o], start[o], size[o]
    edge = np.flatnonzero(np.diff(where, prepend=-1))
    ids = pdf["doc_id"].tolist()
    parts = np.split(np.arange(len(o)), edge[1:]) if len(o) else []
    return pd.DataFrame(
        {
            "shard": int(pdf["shard"].iloc[0]) if len(pdf) else 0,
            "bin": where[edge].astype(np.int32),
            "n_tokens": np.add.reduceat(size, edge).astype(np.int32) if len(o) else np.zeros(0, np.int32),
            "n_pieces": np.array([len(p) for p in parts], np.int32),
            "doc_ids": [[None if ids[k] == NULL else ids[k] for k in src[p]] for p in parts],
            "starts": [start[p].tolist() for p in parts],
            "lengths": [size[p].tolist() for p in parts],
        }
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, length: Column | None = None) -> DataFrame:
    """One row per bin: shard, bin, n_tokens, n_pieces, and, piece by piece, doc_ids, starts (token offset in the document) and lengths."""
    shards = max(1, -(-docs.count() // shard_docs))  # counts rows from the footers, reads no column
    own = _words(docs) if length is None else docs.select(*_id(), length.cast("long").alias("n"))
    own = own.filter("n > 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL)))
    own = own.withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int"))
    # A count of one's own keeps AQE from joining shards: they are a few bytes a document, but much work.
    return own.repartition(shards, "shard").groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity), SCHEMA)
