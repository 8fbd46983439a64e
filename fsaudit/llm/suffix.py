"""Removal of repeated passages by a hash-compared sort of suffixes.

Words are those of ``_text`` kind SPACE, compared byte by byte. A window is a run of ``WINDOW`` words.
A window is *repeated* if an equal one occurs before it, in the order (doc_id, row hash, position); the words
under repeated windows go, so that the first occurrence of every passage stays and later ones go whole.

1. Every window is anchored at the leftmost smallest hash among its runs of ``GRAM`` words. Equal windows have equal
   anchors at equal offsets, so only suffixes that reach windows with a common anchor have to be compared; the windows of one anchor
   lie in a stretch of ``WINDOW`` + (``WINDOW`` - ``GRAM``) words at most. Anchors are shuffled by hash.
2. Stretches of one anchor that agree in a 128-bit hash of all their words (two independent prefix polynomials) are folded: all
   but the first repeat it. What is left are the first of each kind, and only for anchors with several kinds; there the others wait for
   what the sort finds for the windows of their first, as that names where each of theirs occurs first.
3. Their texts are gathered by anchor. The suffixes that begin in them are sorted by mergesort; two suffixes are compared by a binary
   search for their common extension on prefix polynomial hashes, and then by their next word. Neighbours with a common extension of a window
   are verified word by word.

4. An anchor with more than ``HOT`` stretches, as a passage has that very many documents hold, takes no part in 2 and 3, as it would fill a task. Its windows are each hashed (128 bits) instead, and
   aggregated to their first occurrence, in every task of the map side first, to which they are joined back.

Defined results: null and empty texts and those of fewer than ``WINDOW`` words are left alone; repeats inside one document count; rows
that repeat doc_id and text count as one document and are treated alike; a null doc_id comes first in the order; an empty table gives an empty result;
other columns are kept and never looked at.

Scale: one anchor for about (``WINDOW`` - ``GRAM``) / 2 words is written and shuffled, and text only for stretches that differ. Spans are broadcast if they are counted to be few,
else joined by shuffle. No step holds more than ``HOT`` stretches of one anchor; the keys of the anchors beyond it, at most one for ``HOT`` anchors, go to all tasks. Documents are told apart by doc_id and a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text
from fsaudit.llm.decontam import replace_texts

WINDOW, GRAM, HOT = 50, 25, 50_000
BROADCAST_ROWS = 250_000
#: Stands for a null doc_id.
NULL = -(2**63)
REPORT = "doc_id long, n_words long, n_removed long, first_doc_ids array<long>, starts array<int>, ends array<int>"
_Q1, _Q2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


class Prefix:
    """Prefix polynomial hashes of a sequence: H[i] is the sum of h[k] q^k over k < i, modulo 2^64."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, h: np.ndarray, q: np.uint64):
        n = len(h) + 1
        p = self._powers.get(int(q))
        if p is None or len(p) < n:
            p = np.full(max(n, 1 << 16), q, np.uint64)
            p[0] = 1
            p = self._powers[int(q)] = np.cumprod(p)
        self.p = p
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * p[: n - 1], out=self.sums[1:])

    def equal(self, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
        """Whether the runs of ``size`` from x and from y agree: each difference of sums is raised to the other's power."""
        s, p = self.sums, self.p
        return (s[x + size] - s[x]) * p[y] == (s[y + size] - s[y]) * p[x]

    def at_end(self, a: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs [a, e) that can be compared with each other, for n >= all e: all raised to the power n - a."""
        return (self.sums[e] - self.sums[a]) * self.p[n - a]


def _inverse_power(q: np.uint64, a: np.ndarray) -> np.ndarray:
    """q^-a modulo 2^64."""
    inv = pow(int(q), -1, 2**64)
    p = Prefix._powers.get(inv)
    most = int(a.max()) + 1 if len(a) else 1
    if p is None or len(p) < most:
        p = np.full(max(most, 1 << 16), inv, np.uint64)
        p[0] = 1
        p = Prefix._powers[inv] = np.cumprod(p)
    return p[a]


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least of each run of ``width``."""
    value, where, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        later = value[step:] < value[: len(value) - step]
        where = np.where(later, where[step:], where[: len(where) - step])
        value = np.minimum(value[step:], value[: len(value) - step])
        have += step
    return where


def _anchored(w: _text.Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows, and the keys of their anchors' places: (windows, place of the anchor, key by place)."""
    g = h[: len(w) - gram + 1].copy()
    for k in range(1, gram):
        g *= np.uint64(0xC2B2AE3D27D4EB4F)
        g += h[k : k + len(g)]
    g = _text.mix(g)
    valid = np.flatnonzero(w.row[: len(w) - window + 1] == w.row[window - 1 :])
    return valid, _least(g, window - gram + 1)[valid], g


def _hashes(w: _text.Words, h: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each run of words [a, e)."""
    h2 = w.hashes(second=True)
    c1, c2 = [(p.sums[e] - p.sums[a]) * _inverse_power(q, a) for p, q in ((Prefix(h, _Q1), _Q1), (Prefix(h2, _Q2), _Q2))]
    return c1 + (e - a).astype(np.uint64), c2


def anchors(w: _text.Words, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """key, c1, c2 (hashes of the stretch), row, a (first word of the stretch in the row), size (words of the stretch)."""
    if len(w) < window:
        return {}
    h = w.hashes()
    valid, where, g = _anchored(w, h, window, gram)
    if not len(valid):
        return {}
    new = np.ones(len(valid), bool)
    new[1:] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1] + 1)
    a = valid[new]
    last = valid[np.append(np.flatnonzero(new)[1:] - 1, len(valid) - 1)]
    e = last + window
    c1, c2 = _hashes(w, h, a, e)
    row = w.row[a]
    return {"key": g[where[new]], "c1": c1, "c2": c2, "row": row, "a": a - w.first[row], "size": e - a}


ANCHORS = "key long, c1 long, c2 long, doc_id long, rid long, a int, size int"


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _text.buffers(b["text"])
            doc, rid = np.asarray(b["doc_id"]), np.asarray(b["rid"])
            for i, j in _text.blocks(offsets):
                x = anchors(_text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "SPACE"), window, gram)
                if x:
                    r = x["row"] + i
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[c].view(np.int64)) for c in ("key", "c1", "c2")), pa.array(doc[r]), pa.array(rid[r]), pa.array(x["a"].astype(np.int32)), pa.array(x["size"].astype(np.int32))], names=["key", "c1", "c2", "doc_id", "rid", "a", "size"])

    return run


def _hot_windows(keys: np.ndarray, window: int, gram: int):
    """The windows whose anchors have these keys: hashes, document, first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _text.buffers(b["text"])
            doc, rid = np.asarray(b["doc_id"]), np.asarray(b["rid"])
            for i, j in _text.blocks(offsets):
                w = _text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "SPACE")
                if len(w) < window:
                    continue
                h = w.hashes()
                valid, where, g = _anchored(w, h, window, gram)
                at = valid[np.isin(g[where].view(np.int64), keys)]
                if len(at):
                    r = w.row[at]
                    c1, c2 = _hashes(w, h, at, at + window)
                    yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(doc[r + i]), pa.array(rid[r + i]), pa.array((at - w.first[r]).astype(np.int32))], names=["c1", "c2", "doc_id", "rid", "s"])

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and order of occurrence: spans that repeat a folded stretch (kind 0), requests for the texts of stretches to be sorted (1), and
    spans that repeat one of these (2), with the rid and first word of that."""
    for b in _frames.by_key(batches):
        col = {c: np.asarray(b[c]) for c in b.schema.names}
        key = col["key"]
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(edge, len(key)))
        many = np.flatnonzero(np.repeat(size > 1, size))
        if not len(many):
            continue
        col = {c: x[many] for c, x in col.items()}
        o = np.lexsort((col["c2"], col["c1"], col["key"]))  # stable: occurrences stay in order
        k, c1, c2 = col["key"][o], col["c1"][o], col["c2"][o]
        new_key = np.diff(k, prepend=k[0] - 1) != 0
        new = new_key | (np.diff(c1, prepend=c1[0] - 1) != 0) | (np.diff(c2, prepend=c2[0] - 1) != 0)
        kinds = np.add.reduceat(new, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        # A repeated row has the same doc_id, rid and a as the first of its kind, and is as first as that.
        head = o[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = (col["rid"][o] == col["rid"][head]) & (col["a"][o] == col["a"][head]) & (col["doc_id"][o] == col["doc_id"][head])
        one, ask = kinds == 1, new & (kinds > 1)
        for kind, take, first in ((0, o[~same & one], head[~same & one]), (1, o[ask], o[ask]), (2, o[~same & ~one], head[~same & ~one])):
            if len(take):
                a, s = col["a"][take], col["size"][take]
                ref = col["key"][take] if kind else col["doc_id"][first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), kind, np.int32)), *(pa.array(x) for x in (col["rid"][take], col["doc_id"][take], a, a + s, ref, col["rid"][first], col["a"][first]))], names=["kind", "rid", "doc_id", "s", "e", "ref", "head", "at"])


class Sorter:
    """Sorts suffixes of a sequence of words, inside groups, by mergesort with hash-compared common extensions."""

    def __init__(self, h: np.ndarray, window: int):
        self.h, self.window, self.prefix = h, window, Prefix(h, _Q1)
        self.steps = [1 << k for k in range(window.bit_length() - 1, -1, -1)]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common words of the suffixes from x and y, a window at most: a binary search."""
        n = np.zeros(len(x), np.int64)
        for step in self.steps:
            fits = n + step <= self.window
            ok = np.flatnonzero(fits)
            n[ok] += step * self.prefix.equal(x[ok] + n[ok], y[ok] + n[ok], step)
        return n

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.extension(x, y)
        whole = n >= self.window
        k = np.where(whole, 0, n)
        return np.where(whole, or_equal, self.h[x + k] < self.h[y + k])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes from ``at``; ``group`` ascends and groups stay apart. Stable."""
        n = len(at)
        first = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        order, place = np.arange(n), np.arange(n) - first
        most, width = int((end - first).max()) if n else 0, 1
        while width < most:
            pair = place // (2 * width)
            right = (place // width) % 2 == 1
            lo = first + pair * 2 * width + np.where(right, 0, width)  # the other run
            low, high = np.minimum(lo, end), np.minimum(lo + width, end)
            base, own = low.copy(), at[order]
            while (busy := np.flatnonzero(low < high)).size:
                mid = (low[busy] + high[busy]) // 2
                other = own[mid]
                # Equal suffixes keep their order: those of the left run come first.
                r = right[busy]
                goes = np.empty(len(busy), bool)
                for side in (True, False):
                    if (s := np.flatnonzero(r == side)).size:
                        goes[s] = self.less(other[s], own[busy[s]], side)
                low[busy[goes]] = mid[goes] + 1
                high[busy[~goes]] = mid[~goes]
            rank = low - base  # of the other run, those before
            run_start = first + pair * 2 * width
            target = run_start + (np.arange(n) - np.where(right, run_start + width, run_start)) + rank
            target = np.where(base >= end, np.arange(n), target)
            new = np.empty_like(order)
            new[target] = order
            order = new
            width *= 2
        return order


def _sort(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _frames.by_key(batches):
            copies = b.slice(0, 0)
            if "head" in b.schema.names:
                copies, b = b.filter(b["head"].is_valid()), b.filter(b["head"].is_null())
            if not b.num_rows:
                continue
            key, rid, doc, first = (np.asarray(b[c]) for c in ("key", "rid", "doc_id", "s"))
            data, offsets = _text.buffers(b["text"])
            w = _text.Words(data, offsets, "SPACE")
            starts = np.maximum(np.diff(w.first) - window + 1, 0)
            row = np.repeat(np.arange(len(key)), starts)
            at = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts) + w.first[row]
            if not len(at):
                continue
            sorter = Sorter(w.hashes(), window)
            group = (np.cumsum(np.diff(key, prepend=key[0]) != 0))[row]
            o = sorter.sort(at, group)
            x, g, raw = at[o], group[o], data.tobytes()
            same = np.zeros(len(o), bool)
            same[1:] = (g[1:] == g[:-1]) & (sorter.extension(x[1:], x[:-1]) >= window)
            for k in np.flatnonzero(same).tolist():  # texts come with single spaces between words
                i, j = x[k], x[k - 1]
                same[k] = raw[w.start[i] : w.end[i + window - 1]] == raw[w.start[j] : w.end[j + window - 1]]
            kind = np.cumsum(~same) - 1
            r = row[o]
            pos = first[r] + (x - w.first[r])
            by = np.lexsort((pos, rid[r], doc[r], kind))
            head = by[np.searchsorted(kind[by], np.arange(kind[-1] + 1))][kind]
            repeated = ~((rid[r] == rid[r[head]]) & (pos == pos[head]) & (doc[r] == doc[r[head]]))
            if repeated.any():
                p = pos[repeated].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[r][repeated], doc[r][repeated], p, p + np.int32(window), doc[r[head]][repeated])], names=["rid", "doc_id", "s", "e", "ref"])
            if copies.num_rows:
                firsts = np.empty(len(o), np.int64)
                firsts[o] = doc[r[head]]
                yield _of_copies(copies, key, rid, first, row, firsts, np.cumsum(starts) - starts, window)

    return run


def _of_copies(copies: pa.RecordBatch, key: np.ndarray, rid: np.ndarray, first: np.ndarray, row: np.ndarray, firsts: np.ndarray, begin: np.ndarray, window: int) -> pa.RecordBatch:
    """Spans of the copies of sorted stretches (key, rid, first), whose windows, in order, have their first occurrences in ``firsts``: one for each run of windows with the same."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (firsts[1:] != firsts[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    low, high = np.searchsorted(row[at], np.arange(len(key))), np.searchsorted(row[at], np.arange(len(key)), "right")
    place = {x: k for k, x in reversed(list(enumerate(zip(key.tolist(), rid.tolist(), first.tolist()))))}
    of = np.array([place[x] for x in zip(*(copies[c].to_pylist() for c in ("key", "head", "at")))], np.int64)
    n = high[of] - low[of]
    run = np.repeat(low[of], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    s = np.repeat(np.asarray(copies["s"]), n).astype(np.int32)
    k = begin[row[at[run]]]
    who = [np.repeat(np.asarray(copies[c]), n) for c in ("rid", "doc_id")]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*who, (s + at[run] - k).astype(np.int32), (s + last[run] - k + window).astype(np.int32), firsts[at[run]])], names=["rid", "doc_id", "s", "e", "ref"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document, sorted by (rid, doc_id, s), joined where they meet."""
    for b in _frames.by_key(x.rename_columns(["key", *x.schema.names[1:]]) for x in batches):
        rid, doc, s, e, ref = (np.asarray(b[c]) for c in ("key", "doc_id", "s", "e", "ref"))
        other = np.zeros(len(rid), bool)
        other[1:] = (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1])
        group = np.cumsum(other)
        far = np.maximum.accumulate(e + group * 2.0**32)  # ends so far, inside the document
        new = np.ones(len(rid), bool)
        new[1:] = other[1:] | (s[1:] + group[1:] * 2.0**32 > far[:-1])
        at = np.flatnonzero(new)
        ends = np.maximum.reduceat(e, at)
        heads = np.flatnonzero(np.diff(group[at], prepend=-1))
        off = pa.array(np.append(heads, len(at)).astype(np.int32))
        whole = np.flatnonzero(np.diff(group, prepend=-1))
        refs = [np.unique(x).tolist() for x in np.split(ref, whole[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(rid[at][heads]), pa.array(doc[at][heads]), pa.ListArray.from_arrays(off, pa.array(s[at])), pa.ListArray.from_arrays(off, pa.array(ends)), pa.array(refs, pa.list_(pa.int64()))], names=["rid", "doc_id", "starts", "ends", "refs"])


def _own(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select(F.coalesce("doc_id", F.lit(NULL)).alias("doc_id"), "text", _frames.rid("doc_id", "text").alias("rid"))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the stretches that are asked for, with single spaces."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("key", "rid", "doc_id", "s", "text")}
        data, offsets = _text.buffers(b["text"])
        asks, rids, docs = b["asks"], b["rid"].to_pylist(), b["doc_id"].to_pylist()
        for i, j in _text.blocks(offsets):
            w = _text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "SPACE")
            raw = w.data.tobytes()
            for r in range(i, j):
                f = int(w.first[r - i])
                for x in asks[r].as_py():
                    p, q = f + x["s"], f + x["e"]
                    for c, v in zip(out, (x["ref"], rids[r], docs[r], x["s"], b" ".join(raw[w.start[p] : w.end[q - 1]].split()))):
                        out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["s"], pa.int32()), pa.array(out["text"], pa.binary())], names=list(out))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


SPANS = "rid long, doc_id long, s int, e int, ref long"


def _first_windows(own: DataFrame, keys: np.ndarray, window: int, gram: int) -> DataFrame:
    """Spans of the repeated windows of anchors with these keys."""
    rows = _frames.cut(own.select("doc_id", "rid", "text").transform(_frames.mapped, _hot_windows(keys, window, gram), "c1 long, c2 long, doc_id long, rid long, s int"))
    first = rows.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "rid", "s")).alias("x"), F.count("*").alias("n")).filter("n > 1").select("c1", "c2", "x")
    again = rows.join(first, ["c1", "c2"]).filter(F.struct("doc_id", "rid", "s") != F.col("x"))
    return again.select("rid", "doc_id", "s", (F.col("s") + window).alias("e"), F.col("x.doc_id").alias("ref"))


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int | None = None) -> DataFrame:
    """rid, doc_id, starts, ends (word numbers), refs (doc_ids with the first occurrences) of each document with repeats; checkpointed."""
    _frames.bounded_batches(docs.sparkSession)
    with _frames.scratch():
        return _frames.keep(_spans(docs, window, gram, HOT if most is None else most))


def _spans(docs: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    own = _own(docs)
    marks = _frames.cut(own.select("doc_id", "rid", "text").transform(_frames.mapped, _anchors(window, gram), ANCHORS))
    hot = _frames.cut(marks.groupBy("key").count().filter(F.col("count") > most).select("key"))
    keys = np.sort(np.asarray(hot.toArrow()["key"].combine_chunks()))
    usual = marks.join(_few(hot), "key", "left_anti") if len(keys) else marks
    found = usual.repartition("key").sortWithinPartitions("key", "doc_id", "rid", "a")
    found = _frames.cut(found.transform(_frames.mapped, _fold, "kind int, rid long, doc_id long, s int, e int, ref long, head long, at int"))
    folded, asked = found.filter("kind = 0").select("rid", "doc_id", "s", "e", "ref"), found.filter("kind = 1").select("rid", "doc_id", "s", "e", "ref")
    asks = _frames.cut(asked.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("s", "e", "ref")).alias("asks")))
    contexts = own.join(_few(asks), ["rid", "doc_id"]).select("rid", "doc_id", "text", "asks").transform(_frames.mapped, _contexts, "key long, rid long, doc_id long, s int, text binary")
    copies = found.filter("kind = 2").selectExpr("ref AS key", "rid", "doc_id", "s", "CAST(NULL AS BINARY) AS text", "head", "at")
    contexts = contexts.selectExpr("*", "CAST(NULL AS LONG) AS head", "CAST(NULL AS INT) AS at").unionByName(copies)
    sorted_ = contexts.repartition("key").sortWithinPartitions("key").transform(_frames.mapped, _sort(window), SPANS)
    both = folded.unionByName(sorted_)
    if len(keys):
        both = both.unionByName(_first_windows(own, keys, window, gram))
    return both.repartition("rid").sortWithinPartitions("rid", "doc_id", "s").transform(_frames.mapped, _merged, "rid long, doc_id long, starts array<int>, ends array<int>, refs array<long>")


def _cut(data: np.ndarray, w: _text.Words, r: int, base: int, end: int, starts: list[int], ends: list[int]) -> str:
    """The text of row r without the words of the spans, each with the white space up to the next word."""
    keep = np.ones(end - base, bool)
    f = int(w.first[r])
    for s, e in zip(starts, ends):
        keep[w.start[f + s] - base : (w.start[f + e] if f + e < w.first[r + 1] else end) - base] = False
    return data[base:end][keep].tobytes().decode("utf-8", "replace")


def clean(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without repeated passages; n_chars, if there, is counted anew for those that changed. A document of which nothing is left goes."""
    names, (rid, doc, first, last) = docs.columns, [_frames.fresh(docs, x) for x in ("__rid", "__doc", "__starts", "__ends")]
    marks = _few(spans(docs, window, gram).select(F.col("rid").alias(rid), F.col("doc_id").alias(doc), F.col("starts").alias(first), F.col("ends").alias(last)))
    own = F.col("doc_id").cast("long")
    marked = docs.withColumns({rid: F.xxhash64(own, F.col("text").cast("string")), doc: F.coalesce(own, F.lit(NULL))})
    joined = marked.join(marks, [rid, doc], "left").select(*names, first, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = b[first], b[last]
            b, texts, keep = b.select(names), {}, np.ones(b.num_rows, bool)
            for r in np.flatnonzero(np.asarray(starts.is_valid())).tolist():
                data, offsets = _text.buffers(b["text"].slice(r, 1))
                w = _text.Words(data, offsets, "SPACE")
                texts[r] = _cut(data, w, 0, 0, len(data), starts[r].as_py(), ends[r].as_py())
                keep[r] = bool(texts[r].strip())
            yield replace_texts(b, texts, keep)

    return joined.transform(_frames.mapped, run, docs.schema)


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document with repeats (and per repetition of it): doc_id, n_words, n_removed, first_doc_ids (where the passages stay), starts, ends (word numbers of the spans)."""
    marks = _few(spans(docs, window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _text.buffers(b["text"])
            n = [np.diff(_text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "SPACE").first) for i, j in _text.blocks(offsets)]
            gone = [sum(e) - sum(s) for s, e in zip(b["starts"].to_pylist(), b["ends"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64()), pa.array(gone, pa.int64()), b["refs"], b["starts"], b["ends"]], names=["doc_id", "n_words", "n_removed", "first_doc_ids", "starts", "ends"])

    out = _own(docs).join(marks, ["rid", "doc_id"]).select("doc_id", "text", "refs", "starts", "ends").transform(_frames.mapped, run, REPORT)
    none = F.lit(NULL)
    return out.withColumn("doc_id", F.nullif("doc_id", none)).withColumn("first_doc_ids", F.transform("first_doc_ids", lambda x: F.nullif(x, none)))


_SPLIT = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')"
ORACLE = f"""WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
 p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w)),
 r AS (SELECT doc_id, i, first FROM (SELECT doc_id, i, first_value(doc_id) OVER o AS first, row_number() OVER o AS k FROM p WINDOW o AS (PARTITION BY x ORDER BY doc_id, i)) WHERE k > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS i FROM r),
 runs AS (SELECT doc_id, min(i) - 1 AS s, max(i) AS e FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
 n AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, string_agg(concat(s, '-', e), ',' ORDER BY s) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, first AS first_doc_id, CAST(len(w) AS BIGINT) AS n_words, n_removed, spans FROM w JOIN n USING (doc_id) JOIN (SELECT DISTINCT doc_id, first FROM r) USING (doc_id)"""
