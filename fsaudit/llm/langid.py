"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is parsed against
each automaton into phrases, each the longest match at its place (a letter that the sample lacks is a phrase of its own).
Phrases times log2 of the sample's length, per letter of the document, estimate the cross entropy in bits; the language with the fewest
bits wins, of equal ones the first by name.

Text is lower-cased, all but letters becomes single spaces. All of a text is parsed; the parse starts anew every ``SEGMENT``
characters, which adds less than one phrase for each and lets a batch be parsed in lockstep.

Every letter of the samples is a symbol of its own. A document is rejected if it has no letters or if its best language needs at least ``log2`` of the size of that language's alphabet
bits per letter, that is, describes it no better than letters drawn at random. Below ``LEAST_LETTERS`` letters that
figure is too coarse to reject for.

Bounds on training: the ``LANGUAGES`` labels with the most documents with letters; of each ``TRAIN_DOCS`` documents with letters and ``TRAIN_CHARS`` characters, those with the least hash of doc_id; of each document a
quarter of ``TRAIN_CHARS`` at most, from its first letter on. Of rows that repeat a label and doc_id, the least piece counts.

Defined results: null and empty texts, and all texts if nothing is labelled, have the language "und", null bits, and are rejected; repeated rows
get equal results; a null language only keeps a row out of training; an empty table gives an empty result; other columns are kept and never looked at.

Scale: training reads (lang, doc_id) of the rows with letters once and then the text of the chosen rows; the rest is one pass without shuffle. What is broadcast has a fixed bound per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

LANGUAGES, TRAIN_DOCS, TRAIN_CHARS, SEGMENT, LEAST_LETTERS = 200, 64, 32_000, 1024, 16
REPORT = "doc_id long, lang string, predicted string, bits double, margin double, accepted boolean"
#: States times symbols up to which an automaton is one dense table.
DENSE = 1 << 24
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, and where each text's begin."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), heads[offsets]


def normalised(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (0: space), where each text's begin, and letters per text. ``table`` gives the symbol of a code point."""
    points, start = _points(data, offsets)
    x = table[points]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    first = start[:-1][start[:-1] < len(x)]
    keep[first] = x[first] != 0
    total = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(x != 0)])
    return x[keep], total[start], np.diff(letters[start])


class Automaton:
    """Suffix automaton of a sequence of symbols 0..size-1, as (next state * 4 + phrases ended) by state and symbol: one table, or the sorted
    transitions if the table would have more than ``DENSE`` places. Only the symbols of the sequence count; all others are one."""

    def __init__(self, text: list[int], size: int):
        here = sorted(set(text))
        self.own = np.full(size, len(here), np.min_scalar_type(len(here)))
        self.own[here] = np.arange(len(here))
        text, size = self.own[np.array(text, np.int64)].tolist(), len(here) + 1
        link, length, to = [-1], [0], [{}]
        last = 0
        for c in text:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            to.append({})
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = cur
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    to.append(dict(to[q]))
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size, self.log = size, float(np.log2(max(2, len(text))))
        # A miss ends the phrase, if one is open; the symbol opens the next, or is one by itself if the sample lacks it.
        root = np.full(size, -1, np.int32)
        root[list(to[0])] = list(to[0].values())
        self.miss = (np.maximum(root, 0) * 4 + (root < 0)).astype(np.int32)
        state = np.repeat(np.arange(len(to)), [len(x) for x in to])
        keys = state * size + np.array([c for x in to for c in x], np.int64)
        goes = np.array([q for x in to for q in x.values()], np.int32) * np.int32(4)
        self.dense = len(to) * size <= DENSE
        if self.dense:
            self.table = np.tile(self.miss, len(to))
            self.table[size:] += 1
            self.table[keys] = goes
        else:
            o = np.argsort(keys)
            self.keys, self.goes = keys[o], goes[o]

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.table[state * np.int32(self.size) + symbol]
        key = state * np.int64(self.size) + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.goes[at], self.miss[symbol] + (state > 0))

    def phrases(self, columns: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of texts in lockstep: columns[k] has symbol k of each, of which the first active[k] are that long."""
        n = columns.shape[1]
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for k, m in enumerate(active.tolist()):
            v = self._step(state[:m], self.own[columns[k, :m]])
            count[:m] += v & 3
            np.right_shift(v, 2, out=state[:m])
        return count + (state > 0)


class Model:
    """Automata by language over one alphabet."""

    def __init__(self, samples: dict[str, list[str]], most: int = TRAIN_CHARS):
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.size = len(letters) + 2
        self.lut = np.where(_LETTER, len(letters) + 1, 0).astype(np.min_scalar_type(self.size))
        for k, c in enumerate(letters):
            self.lut[ord(c)] = k + 1
        self.languages, self.automata, reject = [], [], []
        for lang in sorted(samples):
            data, offsets = _text.buffers(_text.lower(pa.array(samples[lang], pa.string())))
            x, _, _ = normalised(data, offsets, self.lut)
            if len(x):
                self.languages.append(lang)
                self.automata.append(Automaton(x[:most].tolist(), self.size))
                reject.append(float(np.log2(max(2, np.count_nonzero(np.unique(x))))))
        self.reject = np.array(reject)

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language, and letters by text."""
        data, offsets = _text.buffers(_text.lower(texts))
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, j in _text.blocks(offsets, 4 << 20):
            x, start, letters[i:j] = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.lut)
            size = np.diff(start)
            parts = -(-size // SEGMENT)
            row = np.repeat(np.arange(j - i), parts)
            if not len(row):
                continue
            nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            at = start[:-1][row] + nth * SEGMENT
            n = np.minimum(SEGMENT, size[row] - nth * SEGMENT)
            o = np.argsort(-n, kind="stable")
            at, n, row = at[o], n[o], row[o]
            x = np.concatenate([x, np.zeros(SEGMENT, x.dtype)])
            columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, SEGMENT)[at].T[: n[0]])
            active = np.searchsorted(-n, -np.arange(n[0]), "left")
            for k, a in enumerate(self.automata):
                out[i:j, k] = np.bincount(row, a.phrases(columns, active), j - i) * a.log / np.maximum(size, 1)
        return out, letters

    def judge(self, texts: pa.Array) -> dict[str, pa.Array]:
        bits, letters = self.bits(texts)
        n = len(texts)
        if not self.languages:
            return {"predicted": pa.array(["und"] * n, pa.string()), "bits": pa.nulls(n, pa.float64()), "margin": pa.nulls(n, pa.float64()), "accepted": pa.array([False] * n, pa.bool_())}
        best = bits.argmin(1)
        least = bits[np.arange(n), best]
        none = letters == 0
        second = np.sort(bits, 1)[:, 1] if len(self.languages) > 1 else least
        names = np.array([*self.languages, "und"], object)
        return {"predicted": pa.array(names[np.where(none, len(self.languages), best)], pa.string()), "bits": pa.array(least, mask=none), "margin": pa.array(second - least, mask=none), "accepted": pa.array(~none & ((least < self.reject[best]) | (letters < LEAST_LETTERS)))}


def train(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, languages: int = LANGUAGES) -> Model:
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    # One row per label: how many documents, and the first of them by the hash of their doc_id.
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = own.select("lang", "doc_id").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= docs_per_language).select("lang", "doc_id").distinct()
    if len(common := own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages + 1).collect()) > languages:
        ids = ids.filter(F.col("lang").isin([r.lang for r in common[:languages]]))
    # No document may fill a language's sample by itself: of a long one a piece is taken, from its first letter on.
    piece = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, chars // 4).alias("text")
    rows = own.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "doc_id", piece).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.doc_id)):
        texts.setdefault(r.lang, []).append(r.text)
    return Model(texts, chars)


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, lang (its label), predicted, bits (per letter), margin (bits to the second language), accepted."""
    _frames.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = held.value.judge(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], *x.values()], names=["doc_id", "lang", *x])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).transform(_frames.mapped, run, REPORT)


def clean(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The accepted documents, with all their columns as they were."""
    _frames.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    return _frames.same_columns(docs, lambda b: b.filter(held.value.judge(b["text"].cast(pa.string()))["accepted"]))
