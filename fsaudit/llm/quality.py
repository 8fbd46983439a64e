"""Document quality by co-training over two views.

Views. *Text*: shares of kinds of bytes, word and line statistics, and the presence of hashed runs of one and two words, of the whole text. *Page metadata*: source, language and both
together, and nothing that is taken from the text, as its length is. Each view has its own regularised logistic regression, calibrated by Platt's method on the labelled rows held out (``HELD_OUT``).

Co-training. Both start from the labelled training rows. In each of ``ROUNDS`` rounds each classifier, over all documents without a training label, labels those of which it is
surest, ``PER_ROUND`` documents in the ratio of the classes, for the *other* classifier, whose next fit includes them. Only confident labels are given: the calibrated chance that one is wrong is ``DOUBT`` at most, and half of what it
would be without looking. A view that knows nothing gives nothing. Of equally sure documents the least hash of doc_id goes first. No document is given twice by one view.

Combination. The quality of a document is the logistic of the two calibrated log-odds together, less the prior log-odds once, as the prior is in both.

Bound on training: ``LABELLED`` labelled doc_ids at most, those with the least hash. A doc_id with several labels counts by their mean, ties are good; of rows that repeat a doc_id the least text counts.

Defined results: all documents are scored. Null and empty texts have zero statistics; null metadata are values of their own; documents with a null doc_id are scored, but not trained on; repeated rows get equal
scores; without labels of both kinds every score is the share of good labels (0.5 if there are none); an empty table gives an empty result; other columns are never looked at.

Scale: each round is one pass over the documents, whose tasks return their ``PER_ROUND`` surest; the features of the chosen and of the labelled rows, both bounded, go to the driver. Scoring is one more pass. Nothing but ids and labels is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

LABELLED, ROUNDS, PER_ROUND, HELD_OUT, DOUBT, BUCKETS, GRAMS = 20_000, 3, 200, 0.25, 0.1, 64, 1 << 12
REPORT = "doc_id long, text_score double, meta_score double, quality double, keep boolean"

_KIND = np.full(256, 7, np.uint8)  # 7: other ASCII signs
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 4
_KIND[[ord(c) for c in "!#$%&*@=|<>{}[]\\/^~_+`"]] = 5
_KIND[128:] = 6
TEXT_FEATURES, META_FEATURES = 14, 3 * BUCKETS + 1


@dataclass
class Features:
    """Rows of dense features, and of places in a sparse vector: each place of a row counts one over the root of their number. Places are held in two bytes, and worked on in chunks, as the driver holds many."""

    dense: np.ndarray
    flat: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def take(self, rows: np.ndarray) -> Features:
        n = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(start[-1]) - np.repeat(start[:-1], n) + np.repeat(self.start[:-1][rows], n)
        return Features(self.dense[rows], self.flat[at], start)

    def __add__(self, other: Features) -> Features:
        return Features(np.concatenate([self.dense, other.dense]), np.concatenate([self.flat, other.flat]), np.concatenate([self.start, self.start[-1] + other.start[1:]]))

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of rows whose places are not too many at once."""
        return _text.blocks(self.start, 1 << 19)

    def dot(self, w: np.ndarray) -> np.ndarray:
        d, out = self.dense.shape[1], np.zeros(len(self))
        for a, b in self._chunks():
            n = np.diff(self.start[a : b + 1])
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), n), w[d:][self.flat[self.start[a] : self.start[b]]], b - a) / np.sqrt(np.maximum(n, 1))
        return self.dense @ w[:d] + out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        """The gradient of the weights, from that of the rows."""
        out = np.zeros(size - self.dense.shape[1])
        for a, b in self._chunks() if len(out) else ():
            n = np.diff(self.start[a : b + 1])
            out += np.bincount(self.flat[self.start[a] : self.start[b]], np.repeat(g[a:b] / np.sqrt(np.maximum(n, 1)), n), len(out))
        return np.concatenate([self.dense.T @ g, out])


def none(width: int) -> Features:
    return Features(np.zeros((0, width)), np.zeros(0, np.uint16), np.zeros(1, np.int64))


def text_features(texts: pa.Array) -> Features:
    out, flat, counts = np.zeros((len(texts), TEXT_FEATURES)), [np.zeros(0, np.uint16)], np.zeros(len(texts), np.int64)
    for i, j in _text.blocks(_text.buffers(texts)[1]):
        d, off = _text.buffers(texts.slice(i, j - i))
        size = np.diff(off)
        has = np.flatnonzero(size)
        if not len(has):
            continue
        rows, at, n = has + i, off[:-1][has], size[has]
        kind = _KIND[d]
        for k in range(8):
            out[rows, k] = np.add.reduceat(kind == k, at, dtype=np.int64) / n
        w = _text.Words(*_text.buffers(_text.lower(texts.slice(i, j - i))), "ALNUM")
        h, words = w.hashes(), np.diff(w.first)
        two, first = w.grams(h, 2)
        for a, b in _text.blocks(w.first, 100_000):  # rows together, as long as their words are few
            there = np.zeros((b - a, GRAMS), bool)
            p, q = int(w.first[a]), int(w.first[b])
            there[w.row[p:q] - a, (h[p:q] >> np.uint64(52)).astype(np.int64)] = True
            u, v = np.searchsorted(first, [p, q])
            there[w.row[first[u:v]] - a, (two[u:v] >> np.uint64(52)).astype(np.int64)] = True
            counts[i + a : i + b] = there.sum(1)
            flat.append(np.nonzero(there)[1].astype(np.uint16))
        length = np.bincount(w.row, w.end - w.start, j - i) / np.maximum(words, 1)
        out[rows, 8] = np.log1p(words[has]) / 5
        out[rows, 9] = length[has] / 10
        out[rows, 10] = _distinct(h, w.first)[has] / np.maximum(words[has], 1)
        out[rows, 11], out[rows, 12] = (x[has] for x in _lines(d, off))
        out[rows, 13] = 1
    return Features(out, np.concatenate(flat), np.concatenate([[0], np.cumsum(counts)]))


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    x = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first[:-1][first[:-1] < len(x)]] = True
    return np.diff(np.concatenate([[0], np.cumsum(new)])[first])


def _lines(d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of repeated lines, and log of the mean line length."""
    inner = (d != 10).copy()
    before = np.zeros_like(inner)
    before[1:] = inner[:-1]
    before[off[:-1][off[:-1] < len(d)]] = False
    start = np.flatnonzero(inner & ~before)
    first = np.searchsorted(start, off)
    if not len(start):
        return np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    # A line's hash: the sum of its bytes' hashes, each turned by its place in the line modulo a prime.
    place = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d)))) if start[0] == 0 else np.arange(len(d)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(d))))])
    x = (_text._TABLE[d] * inner) * _text._POW[place % 4093]
    h = np.add.reduceat(x, start)
    n = np.diff(first)
    return 1 - _distinct(h, first) / np.maximum(n, 1) * (n > 0) - (n == 0), np.log1p(np.diff(off) / np.maximum(n, 1)) / 5


def meta_features(source: pa.Array, lang: pa.Array) -> Features:
    n = len(source)
    out, codes = np.zeros((n, META_FEATURES)), []
    for k, col in enumerate((source, lang)):
        held = pc.dictionary_encode(col.cast(pa.string()))
        held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
        w = _text.Words(*_text.buffers(pa.array([(x or "").replace(" ", "_") or "-" for x in held.dictionary.to_pylist()], pa.string())), "CASED")
        by_word = np.array([int(_text.mix(w.hashes()[a:b] + np.arange(b - a).astype(np.uint64)).sum(dtype=np.uint64)) for a, b in zip(w.first[:-1], w.first[1:])] + [0], np.uint64)
        code = by_word[np.asarray(pc.fill_null(held.indices, len(by_word) - 1))]
        null = ~np.asarray(col.is_valid())
        out[np.arange(n), k * BUCKETS + np.where(null, 0, (_text.mix(code) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1)] = 1
        codes.append(np.where(null, np.uint64(7), _text.mix(code)))
    out[np.arange(n), 2 * BUCKETS + (_text.mix(codes[0] * np.uint64(3) + codes[1]) % np.uint64(BUCKETS)).astype(np.int64)] = 1
    out[:, -1] = 1
    return Features(out, np.zeros(0, np.uint16), np.zeros(n + 1, np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Features, y: np.ndarray, size: int, l2: float = 0.1, steps: int = 60) -> np.ndarray:
    """Logistic regression with ``size`` sparse places, by a limited-memory quasi-Newton method; y may be fractional."""
    size += x.dense.shape[1]
    l2 /= len(y) ** 0.5

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x.dot(w), -30, 30)
        return float(np.mean(np.logaddexp(0, z) - y * z) + l2 * w @ w / 2), x.back((sigmoid(z) - y) / len(y), size) + l2 * w

    w, held = np.zeros(size), []
    f, g = loss(w)
    for _ in range(steps):
        p, a = g.copy(), []
        for s, t, r in reversed(held):
            a.append(r * (s @ p))
            p -= a[-1] * t
        if held:
            s, t, r = held[-1]
            p *= (s @ t) / (t @ t)
        for (s, t, r), k in zip(held, reversed(a)):
            p += s * (k - r * (t @ p))
        slope, step = float(p @ g), 1.0
        while step > 1e-8:
            new, (f2, g2) = w - step * p, loss(w - step * p)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = new - w, g2 - g
        if s @ t > 1e-12:
            held = [*held, (s, t, 1 / (s @ t))][-8:]
        w, f, g = new, f2, g2
        if np.abs(g).max() < 1e-6:
            break
    return w


def _line(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's line: slope and offset that make a score the log-odds of its label."""
    n1, n0 = y.sum(), (1 - y).sum()
    soft = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    return fit(Features(np.stack([z, np.ones(len(z))], 1), np.zeros(0, np.uint16), np.zeros(len(z) + 1, np.int64)), soft, 0, l2=1e-3)


#: Gives, for the views so far, the documents that each view labels: their features in both views, and the labels.
Choose = Callable[["Views"], list[tuple[Features, Features, np.ndarray]]]


class Views:
    """Weights of both views and their Platt lines; without labels of both kinds none, only the share of good labels."""

    def __init__(self, share: float, weights: list[np.ndarray] | None = None, lines: list[np.ndarray] | None = None):
        self.share, self.weights, self.lines, self.exchanged = share, weights, lines, [0, 0]

    def odds(self, x: tuple[Features, Features]) -> list[np.ndarray]:
        return [v.dot(w) * p[0] + p[1] for v, w, p in zip(x, self.weights, self.lines)]

    def scores(self, text: Features, meta: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.weights is None:
            return (np.full(len(text), self.share),) * 3
        a, b = self.odds((text, meta))
        return sigmoid(a), sigmoid(b), sigmoid(a + b - np.log(self.share / (1 - self.share)))

    def bounds(self, doubt: float = DOUBT) -> tuple[float, float]:
        """(least log-odds of a confident good label, greatest of a confident bad one)."""
        good, bad = min(doubt, (1 - self.share) / 2), min(doubt, self.share / 2)
        return float(np.log((1 - good) / good)), float(np.log(bad / (1 - bad)))


def cotrain(text: Features, meta: Features, y: np.ndarray, choose: Choose, rounds: int = ROUNDS) -> Views:
    share = float(np.mean(y)) if len(y) else 0.5
    if len(y) < 8 or share in (0.0, 1.0):
        return Views(share)
    held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    rest, at = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(y))
    own, checked = [(v.take(rest), y[rest]) for v in (text, meta)], [v.take(at) for v in (text, meta)]

    def fitted() -> Views:
        w = [fit(x, t, GRAMS if k == 0 else 0) for k, (x, t) in enumerate(own)]
        return Views(share, w, [_line(v.dot(u), y[at]) for v, u in zip(checked, w)])

    exchanged = [0, 0]
    for _ in range(rounds):
        for k, (a, b, labels) in enumerate(choose(fitted())):
            own[1 - k] = own[1 - k][0] + (b if k == 0 else a), np.concatenate([own[1 - k][1], labels])
            exchanged[k] += len(labels)
    views = fitted()
    views.exchanged = exchanged
    return views


def _own(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string"}
    return docs.select(*[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


def _gathered(own: DataFrame, ids: DataFrame) -> tuple[np.ndarray, Features, Features]:
    """(doc_ids, features in both views) of the documents with the ids, in order of doc_id."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = text_features(b["text"]), meta_features(b["source"], b["lang"])
            rows = [(d.tobytes(), f.tobytes(), e.tobytes()) for d, f, e in zip(x.dense, np.split(x.flat, x.start[1:-1]), m.dense.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], names=["doc_id", "x", "g", "m"])

    rows = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang")).alias("r")).select("doc_id", "r.*")
    got = rows.transform(_frames.mapped, gather, "doc_id long, x binary, g binary, m binary").toArrow().combine_chunks().sort_by("doc_id")
    if not got.num_rows:
        return np.zeros(0, np.int64), none(TEXT_FEATURES), none(META_FEATURES)
    x, g, m = (_text.buffers(got[c]) for c in ("x", "g", "m"))
    text = Features(x[0].view(np.float64).reshape(-1, TEXT_FEATURES), np.frombuffer(g[0].tobytes(), np.uint16), g[1] // 2)
    meta = Features(m[0].reshape(-1, META_FEATURES).astype(np.float32), np.zeros(0, np.uint16), np.zeros(got.num_rows + 1, np.int64))
    return np.asarray(got["doc_id"].combine_chunks()), text, meta


def surest(best: list[np.ndarray], odds: np.ndarray, order: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """The ``most`` distinct ids with the greatest odds among those so far and these; of equal ones those first in order."""
    z, o, i = (np.concatenate(x) for x in zip(best, [odds, order, ids]))
    by = np.lexsort((i, o, -z))
    by = by[np.sort(np.unique(i[by], return_index=True)[1])][:most]
    return [z[by], o[by], i[by]]


def _quotas(share: float, per_round: int) -> tuple[int, int]:
    return round(per_round * share), round(per_round * (1 - share))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Views:
    _frames.bounded_batches(docs.sparkSession)
    with _frames.scratch():
        return _trained(docs, labels, labelled, rounds, per_round)


def _trained(docs: DataFrame, labels: DataFrame, labelled: int, rounds: int, per_round: int) -> Views:
    spark, own = docs.sparkSession, _own(docs).filter("doc_id IS NOT NULL")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    y = y.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    y = _frames.cut(y.join(own.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    known = {r.doc_id: r.y for r in y.collect()}
    ids, text, meta = _gathered(own, y.select("doc_id"))
    given = [ids, ids]  # what each view no longer gives

    def choose(views: Views) -> list[tuple[Features, Features, np.ndarray]]:
        held, (up, down), quotas = spark.sparkContext.broadcast((views, [np.sort(x) for x in given])), views.bounds(), _quotas(views.share, per_round)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [[np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in range(4)]  # by view, the good and then the bad
            views, given = held.value
            for b in batches:
                doc, order = np.asarray(b["doc_id"]), np.asarray(b["place"])
                for k, z in enumerate(views.odds((text_features(b["text"]), meta_features(b["source"], b["lang"])))):
                    new = ~np.isin(doc, given[k])
                    for s, ok in ((0, new & (z >= up)), (1, new & (z <= down))):
                        best[2 * k + s] = surest(best[2 * k + s], z[ok] * (1 - 2 * s), order[ok], doc[ok], quotas[s])
            n = [len(x[0]) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(4, dtype=np.int32), n)), *(pa.array(np.concatenate(x)) for x in zip(*best))], names=["kind", "z", "place", "doc_id"])

        top = own.withColumn("place", F.xxhash64("doc_id")).transform(_frames.mapped, scan, "kind int, z double, place long, doc_id long")
        top = top.groupBy("kind", "place", "doc_id").agg(F.max("z").alias("z")).withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("z"), "place", "doc_id")))
        top = _frames.cut(top.filter(F.col("k") <= F.element_at(F.array(*map(F.lit, quotas)), F.col("kind") % 2 + 1)).select("kind", "doc_id"))
        picked = top.collect()
        held.unpersist()
        found, x, m = _gathered(own, top.select("doc_id").distinct()) if picked else (np.zeros(0, np.int64), text.take(np.zeros(0, np.int64)), meta.take(np.zeros(0, np.int64)))
        out = []
        for k in (0, 1):
            mine = {r.doc_id: float(r.kind % 2 == 0) for r in picked if r.kind // 2 == k}
            rows = np.flatnonzero(np.isin(found, list(mine)))
            given[k] = np.concatenate([given[k], found[rows]])
            out.append((x.take(rows), m.take(rows), np.array([mine[d] for d in found[rows].tolist()])))
        return out

    return cotrain(text, meta, np.array([known[d] for d in ids.tolist()]), choose, rounds)


def report(docs: DataFrame, labels: DataFrame, model: Views | None = None) -> DataFrame:
    """One row per document: doc_id, text_score and meta_score (calibrated, by view), quality (both), keep (quality at least 0.5)."""
    _frames.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m, q = held.value.scores(text_features(b["text"]), meta_features(b["source"], b["lang"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(a), pa.array(m), pa.array(q), pa.array(q >= 0.5)], names=["doc_id", "text_score", "meta_score", "quality", "keep"])

    return _own(docs).transform(_frames.mapped, run, REPORT)
