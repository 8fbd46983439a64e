"""Operators 3, 4, 6, 9 and 10 against brute force, and on awkward tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fsaudit.llm import _text, decontam, langid, neardup, packing, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
EXTRA = ", rid long, key string, a int, n string, `__rid` string, `__starts` string, y double, shard int, item_id long, label string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing names."""
    body, r = " ".join(words(120, 1)), (7, "x", 1, "n", "r", "s", 0.5, 3, 9, "l")
    long = " ".join(words(150_000, 2, 10**6))
    rows = [
        (1, body, "en", "s", len(body), *r), (1, body, "en", "s", len(body), *r), (2, body, "de", None, None, *r), (None, body, None, "s", 1, *r), (None, None, None, None, None, *[None] * 10),
        (3, None, "en", "s", None, *r), (4, "", "en", "s", 0, *r), (5, " \n\t ", "en", "s", 4, *r), (6, "!!! ... ---", "en", "s", 11, *r), (7, long, "en", "s", len(long), *r), (8, "Ünïcode ÀÉ İ K 中文", "fr", "s", 9, *r), (9, "one", "en", "s", 3, *r),
    ]
    return spark.createDataFrame(rows, DOCS + EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(words(40, 900))), (2, "Short but, enough words here!"), (3, "two words"), (4, None), (None, "a b c d e f g"), (5, "")], "item_id long, text string")


def rest_of(df):
    """Rows as comparable tuples of all but text and n_chars."""
    return Counter(tuple(str(r[c]) for c in df.columns if c not in ("text", "n_chars")) for r in df.collect())


# Words


def test_words_and_grams():
    data, offsets = _text.buffers(_text.lower(pa.array(["Ab c, d", "", None, "éa b", "x"])))
    w = _text.Words(data, offsets, "ALNUM")
    assert [bytes(data[s:e]).decode() for s, e in zip(w.start, w.end)] == ["ab", "c", "d", "éa", "b", "x"]
    assert w.first.tolist() == [0, 3, 3, 3, 5, 6]
    h = w.hashes()
    assert len(set(h.tolist())) == 6
    assert w.grams(h, 2)[1].tolist() == [0, 1, 3]
    one = _text.Words(*_text.buffers(pa.array(["z" * 3_000_000 + " tail"])), "SPACE")
    assert len(one) == 2 and len(one.hashes()) == 2


# Suffix-array dedup


def brute_removed(docs, window):
    """Removed word numbers by (id, text) of documents in order."""
    seen, gone = {}, defaultdict(set)
    for i, t in docs:
        w = re.split(r"[ \t\n\r\f]+", t.strip(" \t\n\r\f")) if t.strip(" \t\n\r\f") else []
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if seen.setdefault(x, (i, k)) != (i, k):
                gone[i] |= set(range(k, k + window))
    return gone


def shared_corpus():
    passages = [words(n, 50 + n) for n in (49, 50, 51, 75, 200)]
    r, out = random.Random(3), []
    for d in range(60):
        w = words(r.randrange(0, 300), 1000 + d)
        for _ in range(r.randrange(3)):
            p, at = r.choice(passages), r.randrange(len(w) + 1)
            cut = r.randrange(len(p) // 2) if r.random() < 0.4 else 0
            w[at:at] = p[cut:]
        out.append(" ".join(w))
    out += [out[7], out[7] + " more", " ".join(["tick"] * 180), " ".join(["tick", "tock"] * 80), "\n".join(out[9].split(" "))]
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    """Also with nearly all repeated anchors taken for hot."""
    monkeypatch.setattr(suffix, "HOT", hot)
    docs = list(enumerate(shared_corpus()))
    want = brute_removed(docs, 50)
    df = table(spark, [t for _, t in docs])
    got = {r.doc_id: {k for a, b in zip(r.starts, r.ends) for k in range(a, b)} for r in suffix.report(df).collect()}
    assert got == dict(want) and len(got) > 20
    after = {r.doc_id: r.text for r in suffix.clean(df).collect()}
    for i, t in docs:
        left = [w for k, w in enumerate(t.split()) if k not in want.get(i, ())]
        assert after.get(i, "").split() == left


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_copies_of_a_folded_stretch_name_the_first_occurrences(spark, tmp_path, monkeypatch, hot):
    """Copies of documents that share a passage a little over a window with an earlier one, against the SQL."""
    monkeypatch.setattr(suffix, "HOT", hot)
    import duckdb
    from fsaudit.llm import registry

    texts = []
    for g in range(25):
        p = words(50 + g, 5000 + g)
        z, v = words(40 + g, 6000 + g), words(70, 7000 + g)
        texts += [" ".join(words(30 + 3 * g, 8000 + g) + p + words(60, 9000 + g)), " ".join(z + p + v), " ".join(z + p + v)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op3_suffix_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(suffix.ORACLE).project(", ".join(got.columns)).fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert {(2, 0), (2, 1), (1, 0)} <= {x[:2] for x in want}


def test_suffixes_are_compared_by_content_when_hashes_collide(monkeypatch):
    s = suffix.Sorter(np.array([1, 2, 3, 1, 2, 4], np.uint64), 3)
    assert s.extension(np.array([0]), np.array([3])).tolist() == [2]
    # Equal word hashes for different words: the sort calls the windows equal, the check of the words must not.
    monkeypatch.setattr(_text.Words, "hashes", lambda self, second=False: np.ones(len(self), np.uint64))
    b = pa.RecordBatch.from_pydict({"key": [5, 5, 5], "rid": [1, 2, 3], "doc_id": [1, 2, 3], "s": [0, 0, 0], "text": [b"a b c", b"a b d", b"a b c"]}, pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int32()), ("text", pa.binary())]))
    assert [r for x in suffix._sort(3)(iter([b])) for r in x["rid"].to_pylist()] in ([], [3])


def test_suffix_dedup_awkward(spark, awkward, none):
    out = suffix.clean(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    # The null doc_id comes first in order, so its copy of the passage stays.
    assert sorted(str(r.doc_id) for r in rows) == sorted(["None", "None", "3", "4", "5", "6", "7", "8", "9"])
    assert suffix.clean(none).count() == 0 and suffix.report(none).count() == 0
    assert {r.doc_id for r in suffix.report(awkward).collect()} == {1, 2}


# Decontamination


def brute_clean(text, items, n=13, least=5, share=0.5):
    """(hits, covered, text left or None if the document goes) for lists of words of items."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[a-zA-Z0-9\x80-\U0010ffff]+", text)]
    w = [text[a:b].lower() for a, b in spans]
    hits, covered = set(), set()
    for g in items:
        k = min(n, len(g))
        if k >= least:
            grams = {tuple(g[i : i + k]) for i in range(len(g) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hits.add((i, k))
                    covered |= set(range(i, i + k))
    if not hits:
        return 0, 0, text
    if len(covered) >= share * len(w):
        return len(hits), len(covered), None
    out, at = "", 0
    for i, (a, _) in enumerate(spans):
        if i in covered and i - 1 not in covered:
            out += text[at:a]
        if i not in covered and i - 1 in covered:
            at = a
    out += "" if len(w) - 1 in covered else text[at:]
    return len(hits), len(covered), out.rstrip()


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(spark, bench, most):
    items = [words(40, 900), ["short", "but", "enough", "words", "here"]]
    r, texts = random.Random(5), []
    for d in range(60):
        w = [x.upper() if r.random() < 0.1 else x.title() if r.random() < 0.3 else x for x in words(r.randrange(1, 150), 300 + d)]
        if d % 3 == 0:
            a = r.randrange(30)
            at = r.randrange(len(w) + 1)
            w[at:at] = items[0][a : a + r.randrange(10, 40)]
        if d % 7 == 0:
            w.insert(r.randrange(len(w) + 1), "SHORT, but enough; words here.")
        texts.append(", ".join(w) + ".")
    df = table(spark, texts)
    want = {i: brute_clean(t, items) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_hits, r.n_covered, r.clean_text) for r in decontam.report(df, bench, broadcast_bytes=most).collect()}
    assert got == {i: x for i, x in want.items() if x[0]} and len(got) > 15
    after = {r.doc_id: (r.text, r.n_chars) for r in decontam.clean(df, bench, broadcast_bytes=most).collect()}
    assert after == {i: (x[2], len(x[2])) for i, x in want.items() if x[2] is not None}


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_items_without_an_id_count(spark, bench, most):
    docs = table(spark, ["A, b c d e f g! " + " ".join(words(30, 1)), " ".join(words(30, 2))], [None, 1])
    r = decontam.report(docs, bench, broadcast_bytes=most).collect()
    assert [(x.doc_id, x.n_hits, x.n_covered, x.items, x.action) for x in r] == [(None, 1, 7, [], "span")]
    assert {x.doc_id: x.text for x in decontam.clean(docs, bench, broadcast_bytes=most).collect()} == {None: " ".join(words(30, 1)), 1: " ".join(words(30, 2))}


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_awkward(spark, awkward, none, bench, most):
    out = decontam.clean(awkward, bench, broadcast_bytes=most)
    assert out.schema == awkward.schema and rest_of(out) == rest_of(awkward)
    assert decontam.clean(none, bench, broadcast_bytes=most).count() == 0
    assert decontam.report(awkward, bench.limit(0), broadcast_bytes=most).count() == 0
    long = table(spark, [" ".join(words(100_000, 4, 10**6)) + " " + " ".join(words(40, 900))])
    r = decontam.report(long, bench, broadcast_bytes=most).collect()
    assert [(x.action, x.n_covered, x.items) for x in r] == [("span", 40, [1])]


# Near duplicates


def shingle_sets(texts, k=neardup.K):
    def shingles(x):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", x.lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    return {d: shingles(x) for d, x in texts.items()}


def brute_near(texts, t=neardup.T, ratio=neardup.RATIO, k=neardup.K):
    s, near, mutual = shingle_sets(texts, k), set(), set()
    for a in s:
        for b in s:
            if a < b and s[a] and s[b]:
                low, high = sorted((len(s[a]), len(s[b])))
                n = len(s[a] & s[b])
                if high <= ratio * low and n >= t * low:
                    near.add((a, b))
                    if n >= t * high:
                        mutual.add((a, b))
    return near, mutual


def brute_kept(texts):
    """What stays by the rule as stated: of each group its leader, unless a leader that stays contains it."""
    near, mutual = brute_near(texts)
    n = {d: len(x) for d, x in shingle_sets(texts).items()}
    first = lambda d: (-n[d], d)
    gone = {d for g in groups(mutual) for d in g if d != min(g, key=first)}
    kept = set()
    for d in sorted(set(texts) - gone, key=first):
        if not any((min(d, k), max(d, k)) in near for k in kept):
            kept.add(d)
    return kept


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return list(out.values())


def near_corpus():
    """Originals with edits of different strength, a group of more copies than a small bucket holds, shared openings, containment, clusters of light copies of two variants, many variants of one
    text that are far from each other with larger texts that contain most of it, and a passage that many texts, not near, consist of."""
    r, out = random.Random(8), []
    for g, n in enumerate([2, 3, 5, 40]):
        base = words(160, 10_000 + g, 10**5)
        for _ in range(n):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            out.append(" ".join(w))
    opening = words(14, 77)
    out += [" ".join(opening + words(30 + d, 20_000 + d, 10**5)) for d in range(60)]
    base = words(100, 30_000, 10**5)
    out += [" ".join(base), " ".join(base + words(70, 30_001, 10**5)), out[0].upper(), out[0]]
    # Light copies are likelier partners of each other than of the other variant's.
    for g, (every, copies) in enumerate([(12, 8), (14, 8), (17, 12), (13, 30)]):
        base = words(400, 40_000 + g, 10**5)
        for v in range(2):
            variant = [f"v{v}x{k}" if v and k % every == 0 else w for k, w in enumerate(base)]
            for _ in range(copies):
                w = list(variant)
                w[r.randrange(len(w))] = f"edit{r.random()}"
                out.append(" ".join(w))
    for g in range(5):
        base = words(220, 70_000 + g, 10**5)
        for v in range(25):
            w = list(base)
            for k in range(v % 10, len(w), r.choice([9, 10, 11, 14, 30])):
                w[k] = f"e{r.random()}"
            out.append(" ".join(w))
        out += [" ".join(words(n, 80_000 + n, 10**5) + base[:200]) for n in (60, 90, 130)]
    common = words(60, 90_000, 10**5)
    out += [" ".join(common + words(50 + d, 91_000 + d, 10**5)) for d in range(100)]
    return out + [" ".join(common + words(120, 91_005, 10**5)), out[-3] + " more"]


@pytest.mark.parametrize("unit, block", [(neardup.UNIT, neardup.BLOCK), (4_000, 16)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, unit, block):
    """With large buckets in one place, and in parts and blocks."""
    monkeypatch.setattr(neardup, "UNIT", unit)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = dict(enumerate(near_corpus()))
    near, mutual = brute_near(texts)
    assert {16, 24, 60} <= set(map(len, groups(mutual)))
    rows = neardup.report(table(spark, list(texts.values()))).collect()
    kept = brute_kept(texts)
    assert set(texts) - {r.doc_id for r in rows if r.relation != "kept"} == kept
    assert {r.doc_id for r in rows} == {x for p in near for x in p} and {r.kept_doc_id for r in rows} <= kept
    assert not {p for p in near if set(p) <= kept} and {r.relation for r in rows} == {"kept", "copy", "mutual", "contained"}
    n = {d: len(x) for d, x in shingle_sets(texts).items()}
    assert all((r.n_shingles, r.kept_shingles) == (n[r.doc_id], n[r.kept_doc_id]) and (r.relation == "kept") == (r.doc_id == r.kept_doc_id) for r in rows)


def test_near_dedup_leaves_no_pair_out(spark, monkeypatch):
    """Mutual and contained pairs just at the threshold, of which bands miss some, and contained ones of any sizes; shingles in many buckets, a few held at a time."""
    monkeypatch.setattr(neardup, "UNIT", 4_000)
    monkeypatch.setattr(neardup, "HELD", 10_000, raising=False)
    out = []
    for g in range(120):
        common = words(67, 200_000 + g, 10**5)
        out += [" ".join(common + words(35, 210_000 + g, 10**5)), " ".join(words(35, 220_000 + g, 10**5) + common)]
    for g in range(60):
        common = words(28, 230_000 + g, 10**5)
        out += [" ".join(common + words(14, 240_000 + g, 10**5)), " ".join(words((20, 100, 500)[g % 3], 250_000 + g, 10**5) + common)]
    larger = words(3000, 260_000, 10**5)
    out += [" ".join(larger), " ".join(larger[5:8]), " ".join(larger[100:120]), " ".join(larger[100:1000]), " ".join(larger[2000:2400] + words(100, 260_001, 10**5)), " ".join(larger[300:302])]
    texts = dict(enumerate(out))
    near, mutual = brute_near(texts, ratio=10**9)
    assert (len(mutual), len(near)) == (120, 120 + 60 + 5)
    rows = neardup.report(table(spark, out).union(table(spark, out[:20]))).collect()  # repeated rows count once
    of = {r.doc_id: r for r in rows}
    assert set(of) == {x for p in near for x in p} and len(rows) == len(of)
    assert all(of[a].kept_doc_id == of[b].kept_doc_id for a, b in near)
    assert sum(r.relation == "kept" for r in rows) == 120 + 60 + 1


def test_near_dedup_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    near, _ = brute_near({r.doc_id: r.text for r in df.collect()})
    want = {x for p in near for x in p}
    got = {r.doc_id for r in neardup.report(df).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_near_dedup_awkward(spark, awkward, none):
    # Rows that repeat doc_id and text are one document.
    twice = spark.createDataFrame([(20, "a b c d e f g h", "en", "s", 15, *[None] * 10)] * 2, awkward.schema)
    both = awkward.union(twice)
    out = neardup.clean(both)
    assert out.schema == awkward.schema
    # Copies are folded into the least doc_id, null first; other texts stay.
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["None", "None", "3", "4", "5", "6", "7", "8", "9", "20", "20"])
    assert neardup.report(none).count() == 0


def test_postings_take_little_memory_and_are_whole():
    import tracemalloc

    n, size = 1000, 2500  # more than are held at a time
    texts = [" ".join(map(str, range(k * size, (k + 1) * size))) for k in range(n)]
    node = np.random.default_rng(3).permutation(n).astype(np.int64) << 33
    rows = pa.record_batch([pa.array(node), pa.array(node // 2), pa.array(texts)], names=["node", "label", "text"])
    assert n * (size - neardup.K + 1) > neardup.HELD
    got, largest = [], 0
    tracemalloc.start()
    try:
        for b in neardup._postings(7)(rows.slice(k, 100) for k in range(0, n, 100)):
            largest = max(largest, b.nbytes)
            got.append(pa.ipc.read_message(b.serialize()))  # outside of what is traced
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 * neardup.HELD and largest < 16 << 20
    found = []
    for b in (pa.ipc.read_record_batch(m, pa.schema([("key", pa.int32()), *((c, pa.binary()) for c in ("x", "node", "label"))])) for m in got):
        for k, x, node_, label in zip(*(b[c] for c in ("key", "x", "node", "label"))):
            x, node_ = np.frombuffer(x.as_buffer(), np.uint64), np.cumsum(neardup._unpacked(node_))
            assert (x % np.uint64(7) == k.as_py()).all()
            found.append(np.stack([node_, neardup._unpacked(label) + node_, x.view(np.int64)]))
    want = [np.stack([np.full(len(x), v), np.full(len(x), v // 2), x.view(np.int64)]) for v, x in zip(node, neardup._sets(rows["text"]))]
    found, want = (y[:, np.lexsort(y)] for y in (np.concatenate(z, 1) for z in (found, want)))
    assert np.array_equal(found, want)


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_buckets_are_told_apart_across_batches(size):
    r = random.Random(size)
    keys = sorted(k for k, m in enumerate([1, 2, 8, 9, 40, 1, 3, 100, 8, 9, 2]) for _ in range(m))
    rows = pa.RecordBatch.from_pydict({"key": keys, "node": list(range(len(keys))), "n": [10] * len(keys)}, pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32())]))
    got = pa.Table.from_batches(list(neardup._bucket_pairs(2.0)(rows.slice(k, size) for k in range(0, len(keys), size)))).to_pylist()
    of = defaultdict(list)
    for node, k in enumerate(keys):
        of[k].append(node)
    small = {(a, b) for v in of.values() if len(v) <= neardup.SMALL for a in v for b in v if a < b}
    assert {(x["a"], x["b"]) for x in got if x["n"] is None} >= small and r
    assert {(x["a"], x["b"]) for x in got if x["n"] is not None} == {(x, k) for k, v in of.items() if len(v) > neardup.SMALL for x in v}


def test_bandings_follow_the_partition():
    seen = {neardup.banding(j, i) for j in range(6) for i in range(j, j + 2)}
    assert len(seen) > 3
    for bands, rows, s in seen:
        assert bands * rows <= neardup.PERMS and 1 - (1 - s**rows) ** bands >= neardup.FIND - 1e-9


# Packing


def naive_bins(sizes, capacity):
    """The sum-of-squares rule as it is stated."""
    gaps = []
    for s in sizes:
        best = None
        for g in sorted({g for g in gaps if g >= s}) + [capacity]:
            new = g == capacity and True
            trial = Counter(x for x in gaps if 0 < x < capacity)
            if g != capacity or not new:
                trial[g] -= 1
            trial[g - s] += g - s > 0
            cost = sum(v * v for v in trial.values())
            if best is None or cost < best[0]:
                best = (cost, g)
        if best[1] == capacity:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(best[1])] = best[1] - s
    return gaps


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares_equals_the_stated_rule(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 20) for _ in range(200)]
    bins = packing.sum_of_squares(np.array(sizes), 20)
    want = naive_bins(sizes, 20)
    filled = np.bincount(bins, sizes)
    assert sorted((20 - filled).astype(int).tolist()) == sorted(want)


def test_packing_keeps_every_token(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(df, capacity=512, shard_docs=40).collect()
    got = defaultdict(list)
    for r in rows:
        assert r.n_tokens == sum(r.lengths) <= 512 and r.n_pieces == len(r.doc_ids)
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            got[d].append((s, n))
    want = {r.doc_id: len(r.text.split()) for r in df.collect()}
    for d, pieces in got.items():
        end = 0
        for s, n in sorted(pieces):
            assert s == end
            end += n
        assert end == want[d]
    assert set(got) == {d for d, n in want.items() if n}
    full = sum(r.n_tokens for r in rows) / len(rows) / 512
    assert full > 0.8 and len({r.shard for r in rows}) == 5


def test_packing_awkward(spark, awkward, none):
    rows = packing.pack(awkward, capacity=64).collect()
    n = Counter(d for r in rows for d, k in zip(r.doc_ids, r.lengths) for _ in range(k))
    assert n == {1: 240, 2: 120, None: 120, 6: 3, 7: 150_000, 8: 5, 9: 1}
    assert packing.pack(none).count() == 0


def test_documents_without_an_id_are_spread_over_the_shards(spark):
    rows = packing.pack(table(spark, [" ".join(words(20, k)) for k in range(200)], [None] * 200), capacity=64, shard_docs=40).collect()
    assert len({r.shard for r in rows}) == 5 and sum(len(r.doc_ids) for r in rows) == 200 and {d for r in rows for d in r.doc_ids} == {None}


# Language


LETTERS = {"en": "the and of to in is that with for was ", "de": "der die und das mit sch ung keit ein zu ", "fr": "le la les une que est eau oui dans avec "}


def speech(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(LETTERS[lang].split()) + r.choice(LETTERS[lang].split()) for _ in range(n))


def test_cross_parsing_equals_string_search():
    texts = {lang: [speech(lang, k) for k in range(5)] for lang in LETTERS}
    m = langid.Model(texts, 2000)
    x = pa.array([speech("en", 99), "a", "zzz thezzz", ""])
    bits, _ = m.bits(x)
    for k, lang in enumerate(m.languages):
        sample = " ".join(" ".join(texts[lang]).split())
        # The model's texts are joined without a space between them, as its automaton sees them.
        sample = "".join(texts[lang])[:2000]
        for i, t in enumerate(x.to_pylist()):
            n, at = 0, 0
            while at < len(t):
                size = 1
                while at + size < len(t) and t[at : at + size + 1] in sample:
                    size += 1
                at += size
                n += 1
            assert bits[i, k] == pytest.approx(n * np.log2(len(sample)) / max(1, len(t)))


def test_language_accuracy_held_out(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    m = langid.train(df.filter("doc_id % 2 = 0"))
    rows = langid.report(df.filter("doc_id % 2 = 1"), m).collect()
    assert sum(r.lang == r.predicted for r in rows) >= 0.97 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)


def test_language_awkward(spark, awkward, none):
    m = langid.Model({lang: [speech(lang, k) for k in range(5)] for lang in LETTERS})
    by = {r.doc_id: r for r in langid.report(awkward, m).collect()}
    for d in (3, 4, 5, 6):
        assert (by[d].predicted, by[d].bits, by[d].accepted) == ("und", None, False)
    assert by[7].bits is not None and by[8].predicted != "und"
    assert langid.clean(awkward, m).schema == awkward.schema
    assert langid.report(none).count() == 0 and langid.clean(none).count() == 0
    assert {r.predicted for r in langid.report(table(spark, ["some text here"], lang=None)).collect()} == {"und"}
    # Random letters are rejected, if there are enough to tell.
    r = random.Random(1)
    noise = "".join(chr(97 + r.randrange(26)) for _ in range(400))
    assert [x.accepted for x in langid.report(table(spark, [noise, "qx"]), m).collect()] == [False, True]


@pytest.mark.parametrize("dense", [langid.DENSE, 1 << 20])
def test_language_scripts_of_many_letters(monkeypatch, dense):
    """Letters far beyond a byte, and beyond the basic plane, stay apart, with the dense and the sparse table alike."""
    monkeypatch.setattr(langid, "DENSE", dense)
    r = random.Random(4)
    scripts = {"aa": range(0x4E00, 0x4E00 + 600), "bb": range(0xAC00, 0xAC00 + 600), "cc": range(0x4E00 + 300, 0x4E00 + 900), "dd": range(0x20000, 0x20000 + 400)}
    pairs = {k: [chr(r.choice(v)) + chr(r.choice(v)) for _ in range(500)] for k, v in scripts.items()}
    texts = {k: ["".join(r.choice(p) for _ in range(200)) for _ in range(30)] for k, p in pairs.items()} | {"en": [speech("en", k) for k in range(5)]}
    fresh = {k: "".join(r.choice(p) for _ in range(100)) for k, p in pairs.items()} | {"en": speech("en", 77)}
    m = langid.Model(texts)
    assert m.automata[0].dense == (dense > 1 << 20) and m.automata[m.languages.index("en")].dense
    got = m.judge(pa.array(fresh.values()))
    assert got["predicted"].to_pylist() == list(fresh) and all(got["accepted"].to_pylist())
    # Letters that no sample has, and random ones of the samples' own, are rejected.
    strange = ["".join(chr(r.randrange(0x8000, 0x9000)) for _ in range(300)), "".join(chr(97 + r.randrange(26)) for _ in range(400))]
    assert m.judge(pa.array(strange))["accepted"].to_pylist() == [False, False]


def test_sparse_automaton_equals_dense(monkeypatch):
    texts = {lang: [speech(lang, k) for k in range(5)] for lang in LETTERS}
    x = pa.array([speech("en", 99), "a", "zzz thezzz", "", "日本 the"])
    want = langid.Model(texts).bits(x)[0]
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (langid.Model(texts).bits(x)[0] == want).all()


def test_every_labelled_language_with_text_is_trained(spark):
    long = "   " + speech("de", 1, 4000)
    assert len(long) > langid.TRAIN_CHARS // 4
    rows = [(k, speech("en", k), "en") for k in range(20)] + [(100, long, "de")] + [(200 + k, "", "fr") for k in range(langid.TRAIN_DOCS)] + [(999, speech("fr", 1, 200), "fr")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], DOCS)
    m = langid.train(docs)
    assert m.languages == ["de", "en", "fr"]
    assert m.judge(pa.array([speech(x, 50) for x in m.languages]))["predicted"].to_pylist() == m.languages
    # Rows that repeat a label and doc_id count once; of more labels than the bound those with the most documents stay.
    again = langid.train(docs.union(docs.filter("lang = 'en'")).union(docs.filter("lang = 'en'")))
    assert all((a.own == b.own).all() and (a.table == b.table).all() for a, b in zip(m.automata, again.automata))
    assert langid.train(docs, languages=2).languages == ["de", "en"]
