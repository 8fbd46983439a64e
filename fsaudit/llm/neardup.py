"""Near-duplicate documents by MinHash bands: groups first, then a containment ensemble over what leads them, then an exact index for the pairs that bands miss.

A document's shingles are the distinct runs of ``K`` words (kind ALNUM of ``_text``);
one of fewer words has all its words as its one shingle, one without words has none
and is never a near duplicate. A pair with a <= b shingles is *mutual* if the shared shingles are at least ``t`` * b (so a is at least that, too), and
*contained* if they are at least ``t`` * a, whatever b (``RATIO`` is no limit; a finite ``ratio`` asks for b <= ratio * a). Documents with the same shingles are folded into the least of them, by doc_id, first.

Groups. A mutual pair has a Jaccard index of at least t / (2 - t), whatever its sizes; bands and rows are tuned for that. A bucket of at most ``SMALL`` gives all its pairs. Documents of larger ones
each have a home, the largest of their buckets (in parts of about ``UNIT`` shingles, by hash), in which the pairs are settled in one place: of the pairs whose signatures don't rule them out
(an estimate within ``ERRORS`` standard errors of the least index), the likeliest of each component are checked on the whole shingle sets and joined, until no pair between different components is unchecked. What is
left are pairs between groups, in small buckets or large ones (compared in blocks of ``BLOCK`` by ``BLOCK``): the ``ACROSS`` likeliest of each two groups are checked first and ``GROW`` times as many in each next
round, until none is unchecked. A group is a connected component of mutual pairs; the document with the most shingles leads it, then the least doc_id (null last).

Containment. Leaders, and documents in no group, are partitioned by shingle count into powers of two. For each pair
of partitions that can hold a contained pair with sizes within a factor of ``REACH``, the containment t becomes the least Jaccard
index such a pair can have there, t / (u/l + 1 - t) with the extreme sizes u and l, and bands and
rows are tuned for that threshold alone: the most rows per band with which a pair at the threshold is
found with probability ``FIND``. All pairs that the signatures don't rule out are checked.

The rest, exactly. Bands find a pair with some probability, and signatures may rule one out; so all shingles are indexed, and those that documents of several labels have are kept with the number of documents. In the order of
that number, others first, a document of n shingles shares one of its first n - ceil(t * n) + 1 with each larger one that it is mutual with or contained in: every pair of different groups that does so, and that can be mutual or
is of two leaders, is checked, unless it was. Groups with a mutual pair are joined. No number of pairs is left out. In the order of sizes, a leader goes, and its group with it, if it is contained in a leader that stays.

So no two documents stay that are a contained or mutual pair, and every document that goes is in the group of one that stays, or of one that is contained in it.

Defined results: null and empty texts stay; rows that repeat doc_id and text are one document;
a null doc_id is allowed; an empty table gives an empty result; other columns are kept and never looked at.

Scale: signatures, bands and pairs are shuffled by hash, texts only for documents with candidates. No bucket or group is held in one place: small buckets are, and parts and blocks of large ones. Of the index, about ``UNIT`` shingles are, with all documents of a shingle (24 bytes for each).
Nothing is collected; the id sets that are broadcast are counted first and joined by shuffle beyond ``BROADCAST_ROWS``. Nodes are numbered where they are written, so no two share a number; rows are told apart by doc_id and a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

K, T, RATIO, FIND, FIND_MUTUAL, PERMS, ERRORS = 3, 0.65, math.inf, 0.9, 0.97, 96, 2.5
#: Bands are tuned for contained pairs whose sizes differ by this factor at most.
REACH = 2.0
SMALL, UNIT, BLOCK, ACROSS, GROW, BROADCAST_ROWS = 8, 500_000, 2048, 16, 16, 2_000_000
#: So many shingles are held before they go out to the index, in batches of about ``SENT``.
HELD, SENT = 1 << 21, 1 << 17
#: A document counts as so many shingles at least for the size of a unit.
LEAST = 200
#: Stands for a null doc_id.
NULL = -(2**63)
LIKELY = "a long, b long, est double, more boolean"

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**31, PERMS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMS, np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of lower-cased text, and where each row's begin."""
    w = _text.Words(data, offsets, "ALNUM")
    rows, h = len(offsets) - 1, w.hashes()
    x, at = w.grams(h, k)
    words = np.diff(w.first)
    if (short := np.flatnonzero((words > 0) & (words < k))).size:
        own = []
        for r in short.tolist():
            y = np.uint64(words[r])
            with np.errstate(over="ignore"):
                for v in h[w.first[r] : w.first[r + 1]]:
                    y = y * np.uint64(0xD6E8FEB86659FD93) + v
            own.append(y)
        x = np.concatenate([x, _text.mix(np.array(own, np.uint64))])
        row = np.concatenate([w.row[at], short])
        o = np.argsort(row, kind="stable")
        x, row = x[o], row[o]
    else:
        row = w.row[at]
    start = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        if b - a > 1:
            x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], np.concatenate([[0], np.cumsum(new)])[start]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = _text.buffers(_text.lower(b["text"]))
        for i, j in _text.blocks(offsets):
            x, start = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.diff(start)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            at = start[has]
            d1, d2 = np.add.reduceat(_text.mix(x), at), np.add.reduceat(_text.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
            low, sig = (x >> np.uint64(32)).astype(np.uint32), np.empty((len(has), PERMS), np.uint32)
            step = np.empty_like(low)
            for p in range(PERMS):
                np.multiply(low, _A[p], out=step)
                step += _B[p]
                sig[:, p] = np.minimum.reduceat(step, at)
            keep = pa.array(has + i)
            sigs = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer((np.arange(len(has) + 1) * 4 * PERMS).astype(np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b["rid"].take(keep), b["doc"].take(keep), pa.array(n[has].astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sigs], names=["rid", "doc", "n", "d1", "d2", "sig"]
            )


def _part(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n)).astype(np.int64)


def _tuned(s: float, find: float) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair of index s is found with probability ``find``."""
    for rows in range(6, 0, -1):
        bands = math.ceil(math.log(1 - find) / math.log(1 - s**rows)) if s < 1 else 1
        if bands * rows <= PERMS and bands <= PERMS // 2:
            return bands, rows
    return PERMS, 1


@lru_cache(1024)
def banding(j: int, i: int, t: float = T, ratio: float = REACH, find: float = FIND) -> tuple[int, int, float]:
    """(bands, rows, Jaccard threshold) for contained pairs of partitions j <= i."""
    low, high = 2**j, 2 ** (i + 1) - 1
    s = t / (min(ratio, high / low) + 1 - t)
    return *_tuned(s, find), s


def _tables(p: int, t: float, ratio: float) -> list[tuple[int, int]]:
    """The partition pairs in which a document of partition p takes part."""
    reach = range(0, int(math.log2(ratio)) + 2)
    return [(p, p + d) for d in reach if 2 ** (p + d) <= ratio * (2 ** (p + 1) - 1)] + [(p - d, p) for d in reach if d and p >= d and 2**p <= ratio * (2 ** (p - d + 1) - 1)]


def _bands(t: float, ratio: float | None):
    """Keys of the nodes: of contained pairs by partition, or, without a ratio, of mutual pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, node, sig = np.asarray(b["n"]).astype(np.int64), np.asarray(b["node"]), _sigs(b["sig"]).astype(np.uint64)
            parts = _part(n) if ratio else np.zeros(len(n), np.int64)
            for p in np.unique(parts).tolist():
                own = np.flatnonzero(parts == p)
                for table in _tables(p, t, ratio) if ratio else [(63, 63)]:
                    bands, rows = banding(*table, t, ratio)[:2] if ratio else _tuned(t / (2 - t), FIND_MUTUAL)
                    for k in range(bands):
                        key = np.full(len(own), (table[0] * 64 + table[1]) * 4096 + k + 1, np.uint64)
                        for r in range(rows):
                            key = _text.mix(key) + sig[own, k * rows + r]
                        yield pa.RecordBatch.from_arrays([pa.array(_text.mix(key).view(np.int64)), pa.array(node[own]), pa.array(n[own].astype(np.int32))], names=["key", "node", "n"])

    return run


def _bucket_pairs(ratio: float):
    """Of rows (key, node, n) sorted by key: the pairs of small buckets (n null), and the members of large ones (node, key, n). Never more than a batch is held."""

    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, edge: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, SMALL + 1):
            at = edge[size == m]
            for x in range(m):
                for y in range(x):
                    left.append(at + x)
                    right.append(at + y)
        left, right = np.concatenate(left), np.concatenate(right)
        ok = (np.maximum(n[left], n[right]) <= ratio * np.minimum(n[left], n[right])) & (node[left] != node[right])
        left, right = node[left[ok]], node[right[ok]]
        return np.minimum(left, right), np.maximum(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        large: int | None = None  # the key whose members already go out as those of a large bucket

        def out(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            size = np.diff(np.append(edge, len(key)))
            a, b = pairs(key, node, n, edge, size)
            big = np.flatnonzero(np.repeat((size > SMALL) | (key[edge] == large if large is not None else False), size))
            n_ = pa.array(np.concatenate([np.zeros(len(a), np.int32), n[big]]), mask=np.arange(len(a) + len(big)) < len(a))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, node[big]])), pa.array(np.concatenate([b, key[big]])), n_], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate(x) for x in zip(held, [np.asarray(batch[c]) for c in ("key", "node", "n")])]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            if len(held[0]) - last > SMALL or held[0][-1] == large:
                yield out(*held)
                large, held = int(held[0][-1]), [x[:0] for x in held]
            elif last:
                yield out(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield out(*held)

    return run


def _least_index(n: np.ndarray, m: np.ndarray, t: float, mutual: bool) -> np.ndarray:
    """The least Jaccard index of a contained or mutual pair of these sizes, less ``ERRORS`` standard errors of its estimate."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    s = np.minimum(t * high / (low + (1 - t) * high) if mutual else t * low / (high + (1 - t) * low), 1)
    s = s - ERRORS * np.sqrt(s * (1 - s) / PERMS)
    return np.where(low >= t * high, s, 2) if mutual else s


def _sigs(col: pa.Array) -> np.ndarray:
    data, _ = _text.buffers(col)
    return data.view(np.uint32).reshape(-1, PERMS) if data.ctypes.data % 4 == 0 else np.frombuffer(data.tobytes(), np.uint32).reshape(-1, PERMS)


def _likely(t: float, mutual: bool):
    """Pairs (a, b, na, nb, sa, sb) whose estimated index doesn't rule them out, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                est = (_sigs(b["sa"]) == _sigs(b["sb"])).mean(1)
                ok = est >= _least_index(np.asarray(b["na"]).astype(np.int64), np.asarray(b["nb"]).astype(np.int64), t, mutual)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep), pa.array(est[ok]), pa.array(np.zeros(int(ok.sum()), bool))], names=["a", "b", "est", "more"])

    return run


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated indices of all rows of x with all rows of y."""
    same = np.zeros((len(x), len(y)), np.uint8)
    for p in range(PERMS):
        same += x[:, p][:, None] == y[None, :, p]
    return same / PERMS


def _likely_in_blocks(t: float, ratio: float, most: int | None):
    """The likely pairs in blocks: rows (key, node, n, sig, label, home, side) sorted by key. Where a block has two sides, only pairs between them count. With ``most``, mutual pairs between
    different labels and homes, the ``most`` likeliest of each two labels; ``more`` says whether such pairs were left out. Without, all pairs within the ratio."""

    def one(node, n, sig, label, home, side) -> Iterator[tuple]:
        step = max(1, (1 << 22) // len(node))
        two = side.any()
        for i in range(0, len(node), step):
            k = np.arange(i, min(i + step, len(node)))
            x, y = n[k][:, None], n[None, :]
            est = _same(sig[k], sig)
            no = (np.maximum(x, y) > ratio * np.minimum(x, y)) | (est < _least_index(x, y, t, most is not None))
            no |= (side[k][:, None] >= side[None, :]) if two else (k[:, None] >= np.arange(len(node))[None, :])
            if most is not None:
                no |= (label[k][:, None] == label[None, :]) | (home[k][:, None] == home[None, :])
            r, c = np.nonzero(~no)
            e, r, all_ = est[r, c], k[r], len(r)
            if most is not None and all_ > most:
                u, v = np.minimum(label[r], label[c]), np.maximum(label[r], label[c])
                o = np.lexsort((-e, v, u))
                new = np.ones(all_, bool)
                new[1:] = (u[o][1:] != u[o][:-1]) | (v[o][1:] != v[o][:-1])
                o = o[np.arange(all_) - np.maximum.accumulate(np.where(new, np.arange(all_), 0)) < most]
                r, c, e = r[o], c[o], e[o]
            yield node[r], node[c], e, len(r) < all_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _frames.by_key(batches):
            sig = _sigs(b["sig"])
            key, node, n, label, home, side = (np.asarray(b[c]).astype(np.int64) for c in ("key", "node", "n", "label", "home", "side"))
            edge = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for x, y, est, more in one(node[i:j], n[i:j], sig[i:j], label[i:j], home[i:j], side[i:j]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(est), pa.array(np.full(len(x), more))], names=["a", "b", "est", "more"])

    return run


def _sets(col: pa.Array) -> list[np.ndarray]:
    data, offsets = _text.buffers(_text.lower(col))
    out = []
    for i, j in _text.blocks(offsets):
        x, start = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out += [x[p:q] for p, q in zip(start[:-1].tolist(), start[1:].tolist())]
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def joined(n: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], t: float) -> np.ndarray:
    """The components of the likely pairs that are mutual, each by its first document: in rounds, of each component the likeliest unchecked pairs to others are checked."""
    found = []
    step = max(1, (1 << 22) // len(n))
    for i in range(0, len(n), step):
        k = np.arange(i, min(i + step, len(n)))
        est = _same(sig[k], sig)
        r, c = np.nonzero((est >= _least_index(n[k][:, None], n[None, :], t, True)) & (k[:, None] < np.arange(len(n))[None, :]))
        found.append((k[r].astype(np.int32), c.astype(np.int32), est[r, c].astype(np.float32)))
    x, y, est = (np.concatenate(z) for z in zip(*found))
    o = np.argsort(-est, kind="stable")
    x, y = x[o], y[o]
    label, most = np.arange(len(n)), 1
    while len(x):
        picked = np.zeros(len(x), bool)
        for side in (label[x], label[y]):
            o = np.argsort(side, kind="stable")
            at = np.arange(len(o))
            new = np.ones(len(o), bool)
            new[1:] = side[o][1:] != side[o][:-1]
            picked[o[at - np.maximum.accumulate(np.where(new, at, 0)) < most]] = True
        for i, j in zip(x[picked].tolist(), y[picked].tolist()):
            if label[i] != label[j] and _shared(sets[i], sets[j]) >= t * max(len(sets[i]), len(sets[j])):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
        left = ~picked & (label[x] != label[y])
        x, y, most = x[left], y[left], most * 2
    return label


def _units(t: float):
    """Of rows (key, node, sig, text) sorted by key: the components of the units, each as pairs of its least node with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _frames.by_key(batches):
            key, node = np.asarray(b["key"]), np.asarray(b["node"])
            edge = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                sets = _sets(b["text"].slice(i, j - i))
                own = node[i:j]  # in order, so the least of a component is the first
                label = joined(np.array([len(x) for x in sets]), _sigs(b["sig"].slice(i, j - i)), sets, t)
                others = np.flatnonzero(label != np.arange(j - i))
                yield pa.RecordBatch.from_arrays([pa.array(own[label[others]]), pa.array(own[others])], names=["a", "b"])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each pair (a, b, ta, tb)."""
    known: dict[int, np.ndarray] = {}
    for b in batches:
        ids, shared = {c: b[c].to_pylist() for c in "ab"}, np.zeros(b.num_rows, np.int32)
        for i in range(0, b.num_rows, 512):
            sets = {}
            for c, t in (("a", "ta"), ("b", "tb")):
                first = {v: k for k, v in reversed(list(enumerate(ids[c][i : i + 512])))}
                new = {v: k for v, k in first.items() if v not in known}
                sets |= dict(zip(new, _sets(b[t].slice(i, 512).take(pa.array(list(new.values()), pa.int64())))))
                sets |= {r: known[r] for r in first if r in known}
            for k in range(i, min(i + 512, b.num_rows)):
                shared[k] = _shared(sets[ids["a"][k]], sets[ids["b"][k]])
            known = sets
        yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(shared)], names=["a", "b", "shared"])


def _packed(x: np.ndarray) -> bytes:
    """Integers byte by byte: those that are alike compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _postings(buckets: int):
    """The index of rows (node, label, text): shingles with their nodes and labels, in buckets by shingle. A few buckets are sorted at a time, since two workers share the memory of an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of each block: shingles and their buckets; of its documents, sizes, nodes and labels

        def out() -> Iterator[pa.RecordBatch]:
            node, label = (np.concatenate([h[c] for h in held]) for c in (3, 4))
            o = np.argsort(node, kind="stable")  # small differences compress better
            rank = np.empty(len(o), np.int32)
            rank[o] = np.arange(len(o))
            node, label, ranks = node[o], label[o], np.split(rank, np.cumsum([len(h[3]) for h in held])[:-1])
            size = sum(np.bincount(h[1], minlength=buckets) for h in held)
            has = np.flatnonzero(size)
            end = np.cumsum(size[has])
            i = 0
            while i < len(has):
                at = end[i] - size[has[i]]
                j = max(i + 1, int(np.searchsorted(end, at + SENT, "right")))
                own = [np.flatnonzero((h[1] >= has[i]) & (h[1] <= has[j - 1])) for h in held]
                x, key, row = (np.concatenate(c) for c in zip(*((h[0][k], h[1][k], np.repeat(r, h[2])[k]) for h, k, r in zip(held, own, ranks))))
                by = np.lexsort((row, key))
                x, row = x[by].view(np.int64), row[by]
                ends = list(zip((end[i:j] - size[has[i:j]] - at).tolist(), (end[i:j] - at).tolist()))
                nodes = (_packed(np.diff(node[row[p:q]], prepend=0)) for p, q in ends)
                labels = (_packed(label[row[p:q]] - node[row[p:q]]) for p, q in ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(has[i:j].astype(np.int32)), pa.array([x[p:q].tobytes() for p, q in ends], pa.binary()), pa.array(nodes, pa.binary()), pa.array(labels, pa.binary())],
                    names=["key", "x", "node", "label"],
                )
                i = j
            held.clear()

        size = 0
        for b in batches:
            node, label = np.asarray(b["node"]), np.asarray(b["label"])
            data, offsets = _text.buffers(_text.lower(b["text"]))
            for i, j in _text.blocks(offsets):
                x, start = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((x, (x % np.uint64(buckets)).astype(np.int32), np.diff(start), node[i:j].copy(), label[i:j].copy()))  # a view would keep the batch with its texts
                size += len(x)
                if size >= HELD:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets of the index, sorted by key: the postings of shingles that nodes of several labels have, and how many nodes have the shingle."""
    for b in _frames.by_key(batches):
        key = np.asarray(b["key"])
        edge = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            x = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in b["x"].slice(i, j - i)])
            node = np.concatenate([np.cumsum(_unpacked(v)) for v in b["node"].slice(i, j - i)])
            label = np.concatenate([_unpacked(v) for v in b["label"].slice(i, j - i)]) + node
            o = np.argsort(x)
            x, node, label = x[o], node[o], label[o]
            new = np.flatnonzero(np.diff(x, prepend=x[0] - 1))
            own = np.repeat(np.minimum.reduceat(label, new) < np.maximum.reduceat(label, new), np.diff(np.append(new, len(x))))
            x, node = x[own], node[own]
            if not len(x):
                continue
            o = np.lexsort((node, x))
            x, node = x[o], node[o]
            once = np.ones(len(x), bool)  # repeated rows of a document give its shingles again
            once[1:] = (x[1:] != x[:-1]) | (node[1:] != node[:-1])
            x, node = x[once], node[once]
            size = np.diff(np.append(np.flatnonzero(np.diff(x, prepend=x[0] - 1)), len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(node), pa.array(np.repeat(size, size).astype(np.int32))], names=["x", "node", "df"])


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A hint only if the rows were counted and are few; df must be cheap to count, as a checkpointed one is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of checkpointed nodes (node, rid, doc): one copy of each text, placed by node."""
    return own.join(_maybe_broadcast(nodes), ["rid", "doc"]).groupBy("node").agg(F.first("text").alias("text"))


def _verify(pairs: DataFrame, own: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb) of checkpointed ``pairs`` (a, b). The texts of a are shuffled once for each pair, so a is better the smaller."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    need = _frames.cut(reps.select("node", "rid", "doc", "n").join(ends, "node"))
    text = _texts(own, need.select("node", "rid", "doc"))  # both joins read this same exchange
    both = pairs.select("a", "b").join(text.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    shared, size = both.select("a", "b", "ta", "tb").transform(_frames.mapped, _checked, "a long, b long, shared int"), need.select("node", "n")
    return shared.join(size.selectExpr("node AS a", "n AS na"), "a").join(size.selectExpr("node AS b", "n AS nb"), "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): the least label spreads to the neighbours, then along the labels themselves."""
    links = _frames.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = _frames.cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = links.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = _frames.cut(step.join(jump, "to").select("node", F.least("to", "far").alias("next"), "label"))
        moved = new.filter("next <> label").limit(1).count()
        label = new.select("node", F.col("next").alias("label"))
        if not moved:
            return label


def _own(docs: DataFrame) -> DataFrame:
    """(rid, doc, text); doc stands in for a null doc_id, so that rows can be joined on it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select(_frames.rid("doc_id", "text").alias("rid"), F.coalesce("doc_id", F.lit(NULL)).alias("doc"), "text")


def _blocks(members: DataFrame, reps: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (node, key, label, home) of large buckets, with signatures, in blocks of two chunks each, sorted by block."""
    x = members.join(sizes.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("chunks")), "key").join(reps.select("node", "n", "sig"), "node")
    own = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    x = x.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    x = x.select(unit.alias("key"), "node", "n", "sig", "label", "home", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return x.repartition("key").sortWithinPartitions("key", "node")


def _candidates(nodes: DataFrame, t: float, ratio: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of small buckets, members (node, key) of large ones, sizes (key, members, shingles) of these)."""
    keys = nodes.select("node", "n", "sig").transform(_frames.mapped, _bands(t, ratio), "key long, node long, n int")
    found = keys.repartition("key").sortWithinPartitions("key").transform(_frames.mapped, _bucket_pairs(ratio or 1 / t), "a long, b long, n int")
    found = _frames.cut(found.distinct())
    large = found.filter("n IS NOT NULL").select(F.col("a").alias("node"), F.col("b").alias("key"), "n")
    sizes = _frames.cut(large.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.greatest("n", F.lit(LEAST))).alias("shingles")))
    return found.filter("n IS NULL").select("a", "b"), large.select("node", "key"), sizes


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, t: float, mutual: bool) -> DataFrame:
    sig = nodes.select("node", "n", "sig")
    both = pairs.join(sig.selectExpr("node AS a", "n AS na", "sig AS sa"), "a").join(sig.selectExpr("node AS b", "n AS nb", "sig AS sb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").transform(_frames.mapped, _likely(t, mutual), LIKELY)


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Groups that are joined by links (a, b) of labels get a label together; one of a single document had none yet."""
    over = components(links)
    alone = over.join(label.select("node"), "node", "left_anti")
    to = over.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return _frames.cut(label.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")).union(alone))


def _groups(own: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """(node, label) of the nodes in groups, checkpointed."""
    pairs, large, sizes = _candidates(reps, t, None)
    chunks = F.ceil(F.col("shingles") / UNIT).cast("int")
    homes = large.join(sizes, "key").groupBy("node").agg(F.max(F.struct("members", "key", chunks.alias("chunks"))).alias("x"))
    homes = _frames.cut(homes.select("node", F.xxhash64("x.key", F.pmod(F.xxhash64("node"), F.col("x.chunks"))).alias("home")))
    housed = _frames.cut(homes.join(reps.select("node", "rid", "doc", "sig"), "node"))
    rows = housed.join(_texts(own, housed.select("node", "rid", "doc")), "node").select(F.col("home").alias("key"), "node", "sig", "text")
    edges = _frames.cut(rows.repartition("key").sortWithinPartitions("key", "node").transform(_frames.mapped, _units(t), "a long, b long"))
    likely = _frames.cut(_likely_pairs(pairs, reps, t, True))
    label, checked, most = components(edges), None, ACROSS

    def labelled(df: DataFrame, col: str, to: str) -> DataFrame:
        # A document without a mutual partner is a group.
        return df.join(label.select(F.col("node").alias(col), F.col("label").alias(to)), col, "left").withColumn(to, F.coalesce(to, col))

    while True:
        members = labelled(large.join(homes, "node"), "node", "label")
        mixed = members.groupBy("key").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.min("home").alias("g"), F.max("home").alias("h")).filter("u < v AND g < h").select("key")
        blocks = _blocks(members.join(mixed, "key", "left_semi"), reps, sizes)
        found = likely.union(blocks.transform(_frames.mapped, _likely_in_blocks(t, 1 / t, most), LIKELY)).groupBy("a", "b").agg(F.max("est").alias("est"), F.max("more").alias("more"))
        found = labelled(labelled(found, "a", "la"), "b", "lb").filter("la <> lb")
        found = found.withColumn("done", F.lit(None).cast("boolean")) if checked is None else found.join(checked.withColumn("done", F.lit(True)), ["a", "b"], "left")
        first = Window.partitionBy("u", "v", "done").orderBy(F.desc("est"), "a", "b")
        found = found.select("a", "b", "more", "done", "est", F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v")).withColumn("k", F.row_number().over(first))
        opened = F.col("done").isNull() & (F.col("k") <= most)
        found = _frames.cut(found.filter("more OR done IS NULL").select("a", "b", "u", "v", opened.alias("open"), (F.col("more") | (F.col("done").isNull() & (F.col("k") > most))).alias("left")))
        state = found.agg(F.max("left").alias("left"), F.count_if("open").alias("open")).first()
        if state["open"]:
            new = found.filter("open").select("a", "b")
            hits = _verify(new, own, reps).filter(F.col("shared") >= t * F.greatest("na", "nb")).select("a", "b").join(found.select("a", "b", "u", "v"), ["a", "b"])
            links = _frames.cut(hits.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
            checked = new if checked is None else checked.union(new)
            if links.limit(1).count():
                label = _merged(label, links)
        if not state["left"]:
            return label
        most *= GROW


def _unfound(own: DataFrame, info: DataFrame, checked: DataFrame, t: float, ratio: float) -> DataFrame:
    """(a, b), a not larger than b, of all pairs of nodes (node, rid, doc, n, label, leads) of different labels that can be mutual, or contained where both lead, but for the checked ones; checkpointed."""
    buckets = max(1, math.ceil((info.agg(F.sum("n")).first()[0] or 0) / UNIT))
    rows = own.join(_maybe_broadcast(info.select("rid", "doc", "node", "label")), ["rid", "doc"]).select("node", "label", "text")
    posts = rows.transform(_frames.mapped, _postings(buckets), "key int, x binary, node binary, label binary")
    _frames.collect(own.sparkSession)
    several = _frames.cut(posts.repartition("key").sortWithinPartitions("key").transform(_frames.mapped, _several, "x long, node long, df int"))
    _frames.collect(own.sparkSession)
    of = _maybe_broadcast(info.select("node", "n", "label", "leads"))
    probing = _frames.cut(several.groupBy("node").agg(F.count("*").alias("m")).join(of, "node").filter(F.col("m") >= t * F.col("n")))
    first = F.row_number().over(Window.partitionBy("node").orderBy("df", "x"))
    probes = several.join(_maybe_broadcast(probing), "node").withColumn("k", first).filter(F.col("k") <= F.col("m") - F.ceil(t * F.col("n")) + 1)
    a = probes.selectExpr("x", "node AS a", "n AS na", "label AS la", "leads AS fa")
    b = of.selectExpr("node AS b", "n AS nb", "label AS lb", "leads AS fb")
    larger = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    can = (F.col("na") >= t * F.col("nb")) | (F.col("fa") & F.col("fb") & (F.col("nb") <= ratio * F.col("na")))
    pairs = a.join(several.selectExpr("x", "node AS b"), "x").filter("a <> b").join(b, "b").filter((F.col("la") != F.col("lb")) & larger & can).select("a", "b").distinct()
    checked = checked.union(checked.select("b", "a"))
    return _frames.cut(pairs.join(checked, ["a", "b"], "left_anti"))


def _covered(near: DataFrame) -> DataFrame:
    """(node, by): of contained pairs (low, high, size of high) in one strict order of sizes, those that go, each with the largest that stays and contains it."""
    left, out = near, None
    while left.limit(1).count():
        stays = left.select("high").distinct().join(left.select(F.col("low").alias("high")).distinct(), "high", "left_anti")
        gone = _frames.cut(left.join(stays, "high").groupBy(F.col("low").alias("node")).agg(F.max(F.struct("size", "high")).alias("x")).select("node", F.col("x.high").alias("by")))
        out = gone if out is None else out.union(gone)
        ids = gone.select("node")
        left = _frames.cut(left.join(ids.withColumnRenamed("node", "low"), "low", "left_anti").join(ids.withColumnRenamed("node", "high"), "high", "left_anti"))
    return out if out is not None else near.select(F.col("low").alias("node"), F.col("high").alias("by"))


def _decide(docs: DataFrame, t: float, ratio: float) -> DataFrame:
    """(rid, doc, n, kept_doc, kept_n, relation) of every document in a group, checkpointed. relation: kept, copy, mutual, contained."""
    _frames.bounded_batches(docs.sparkSession)
    with _frames.scratch():
        return _frames.keep(_decisions(docs, t, ratio))


def _decisions(docs: DataFrame, t: float, ratio: float) -> DataFrame:
    own = _own(docs)
    sigs = _frames.cut(own.transform(_frames.mapped, _signatures, "rid long, doc long, n int, d1 long, d2 long, sig binary"))
    folds = sigs.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc", "rid")).alias("rep"), F.first("sig").alias("sig"))
    reps = _frames.cut(folds.select(F.monotonically_increasing_id().alias("node"), "rep.rid", "rep.doc", "n", "d1", "d2", "sig"))
    label = _groups(own, reps, t)
    # The first of each group by size, then doc_id, null last.
    order = F.struct(F.negative("n").alias("n"), (F.col("doc") == NULL).alias("none"), "doc", "rid", "node")

    def led(label: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        members = _frames.cut(reps.select("node", "rid", "doc", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
        leads = members.groupBy("label").agg(F.min(order).alias("x")).select("label", F.col("x.node").alias("lead"))
        return members, leads, _frames.cut(reps.drop("d1", "d2").join(leads.select(F.col("lead").alias("node")), "node"))

    members, leads, leaders = led(label)
    reach = min(ratio, REACH)
    pairs, large, sizes = _candidates(leaders, t, reach)
    blocks = _blocks(large.select("node", "key", F.lit(0).alias("label"), F.lit(0).alias("home")), leaders, sizes)
    likely = _frames.cut(_likely_pairs(pairs, leaders, t, False).union(blocks.transform(_frames.mapped, _likely_in_blocks(t, reach, None), LIKELY)).select("a", "b").distinct())
    found = _frames.cut(_verify(likely, own, leaders).filter(F.col("shared") >= t * F.least("na", "nb")))

    info = _frames.cut(members.join(leads.select(F.col("lead").alias("node"), F.lit(True).alias("leads")), "node", "left").withColumn("leads", F.coalesce("leads", F.lit(False))))
    rest = _frames.cut(_verify(_unfound(own, info, likely, t, ratio), own, reps).filter(F.col("shared") >= t * F.least("na", "nb")))
    mutual = rest.filter(F.col("shared") >= t * F.greatest("na", "nb")).select("a", "b")
    if mutual.limit(1).count():
        of = members.select("node", "label")
        links = mutual.join(of.selectExpr("node AS a", "label AS la"), "a").join(of.selectExpr("node AS b", "label AS lb"), "b")
        members, leads, leaders = led(_merged(label, _frames.cut(links.selectExpr("la AS a", "lb AS b").distinct())))

    near = found.unionByName(rest).filter((F.col("shared") >= t * F.least("na", "nb")) & (F.greatest("na", "nb") <= ratio * F.least("na", "nb")))
    rank = leaders.select("node", order.alias("rank"))
    near = near.join(rank.selectExpr("node AS a", "rank AS ra"), "a").join(rank.selectExpr("node AS b", "rank AS rb"), "b")
    first = F.col("ra") < F.col("rb")
    near = near.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("high"), F.greatest("na", "nb").alias("size"))
    covered = _covered(_frames.cut(near))

    # From the leaders back to their groups, and from the folded documents to all.
    ends = leads.join(covered.select(F.col("node").alias("lead"), "by"), "lead", "left").select("label", "lead", F.coalesce("by", "lead").alias("to"), F.col("by").isNotNull().alias("goes"))
    ends = ends.join(leaders.select(F.col("node").alias("to"), F.col("doc").alias("kept_doc"), F.col("n").alias("kept_n")), "to")
    nodes = members.join(ends, "label").select("node", F.col("rid").alias("rep_rid"), F.col("doc").alias("rep_doc"), "lead", "to", "goes", "kept_doc", "kept_n")
    whole = sigs.select("rid", "doc", "n", "d1", "d2").dropDuplicates(["rid", "doc"]).join(reps.select("node", "n", "d1", "d2"), ["n", "d1", "d2"]).join(nodes, "node")
    rep = (F.col("rid") == F.col("rep_rid")) & (F.col("doc") == F.col("rep_doc"))
    how = F.when(~rep, "copy").when(F.col("node") != F.col("lead"), "mutual").when(F.col("goes"), "contained").otherwise("kept")
    out = _frames.cut(whole.select("rid", "doc", "n", "to", "kept_doc", "kept_n", how.alias("relation")))
    gone = out.filter("relation <> 'kept'")
    return gone.unionByName(out.filter("relation = 'kept'").join(gone.select("to").distinct(), "to", "left_semi")).drop("to")


def report(docs: DataFrame, t: float = T, ratio: float = RATIO) -> DataFrame:
    """One row per document of a group: doc_id, kept_doc_id (the document that stays for it, itself if it stays), n_shingles, kept_shingles, relation (kept; copy: it has the shingles of
    another of the group; mutual: it is in the leader's group; contained: it leads its group and is contained in the one that stays)."""
    id_ = lambda c: F.nullif(F.col(c), F.lit(NULL))
    return _decide(docs, t, ratio).select(id_("doc").alias("doc_id"), id_("kept_doc").alias("kept_doc_id"), F.col("n").alias("n_shingles"), F.col("kept_n").alias("kept_shingles"), "relation")


def clean(docs: DataFrame, t: float = T, ratio: float = RATIO) -> DataFrame:
    """The documents without those that go; all columns as they were."""
    rid, doc = _frames.fresh(docs, "__rid"), _frames.fresh(docs, "__doc")
    gone = _frames.keep(_decide(docs, t, ratio).filter("relation <> 'kept'").select(F.col("rid").alias(rid), F.col("doc").alias(doc)))
    own = F.col("doc_id").cast("long")
    marked = docs.withColumns({rid: F.xxhash64(own, F.col("text").cast("string")), doc: F.coalesce(own, F.lit(NULL))})
    return marked.join(_maybe_broadcast(gone), [rid, doc], "left_anti").select(*docs.columns)
