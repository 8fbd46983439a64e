"""URL filter on a sorted digest array.

Entries are canonical URLs, or hosts, which stand for all URLs of the host and of its subdomains, at any port. ``build`` writes the distinct entries to the shared
folder as shards by ranges of their 64-bit xxHash: a sorted key array, string offsets and the strings. ``report`` memory-maps the shards, probes
each URL's keys (the URL itself, its host, the host's parent domains) by vectorised binary search, and confirms every hit on the stored
string. Entries with equal keys lie next to each other and are all compared.

Canonical: trimmed, without scheme and fragment; the authority, which ends at the first of ``/?#``, without user info, dots at the end and the ports 80 and 443, in lower case; a slash before
a query that follows the authority; no slash at the end. An entry with another port stands for itself alone.

Defined results: null and empty URLs are never blocked and never entries; of several hits the URL comes first, then the longest domain; of a host of more than ``LONGEST`` characters, which no
name service holds, the parents aren't probed; repeated rows get equal results; an empty table gives an empty result, an empty list blocks nothing; other columns are never looked at.

Scale: the list is sharded by ``SHARD_ROWS`` entries and built in parallel; no part of it is collected or broadcast. Probes and their keys are JVM expressions. Pages are not shuffled: tasks map the
files, and the pages of a file that a task touches are what its probes need.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

SHARD_ROWS, LONGEST = 4_000_000, 253
REPORT = "page_id long, url string, blocked boolean, matched string"


def parts(url: Column) -> tuple[Column, Column]:
    """(canonical URL, host without port)."""
    x = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*", ""), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//", "")
    authority = F.regexp_extract(x, "^[^/?]*", 0)
    rest, net = F.substr(x, F.length(authority) + 1), F.substring_index(authority, "@", -1)
    host, port = [F.regexp_extract(net, r"(?s)^(.*?)\.*(:[0-9]*)?$", k) for k in (1, 2)]
    host = F.lower(host)
    whole = F.concat(host, F.when(port.isin(":", ":80", ":443"), "").otherwise(port), F.when(F.startswith(rest, F.lit("?")), "/").otherwise(""), rest)
    return F.rtrim(whole, F.lit("/")), host


def canonical(url: Column) -> Column:
    return parts(url)[0]


def probes(url: Column, host: Column) -> Column:
    """What could block a canonical URL, in the order of precedence: itself, its host, the host's parent domains."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(url != "", F.array_distinct(F.concat(F.array(url), F.when(F.length(host) <= LONGEST, above).otherwise(F.array(host)))))


def build(entries: DataFrame, shard_rows: int = SHARD_ROWS) -> str:
    """Write the filter for the entries in column ``url``; the folder that holds it."""
    spark = entries.sparkSession
    own = entries.select(canonical(F.col("url").cast("string")).alias("entry")).filter("entry <> ''").distinct().withColumn("key", F.xxhash64("entry"))
    own = _frames.keep(own)
    bits = max(0, -(-own.count() // shard_rows) - 1).bit_length()
    folder = _frames.own_folder(spark, "urls")
    path = _frames.local_path(folder)
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("entry", pa.string())]))])
        shard = np.asarray(t["shard"].combine_chunks())
        for s in np.unique(shard):  # a task can hold several shards
            part = t.filter(pa.array(shard == s))
            key = np.asarray(part["key"].combine_chunks()).view(np.uint64)
            o = np.argsort(key, kind="stable")
            data, offsets = _text.buffers(part["entry"].take(pa.array(o)).combine_chunks())
            base = f"{path}/{int(s):05d}"
            for name, x in (("strings", data), ("offsets", offsets), ("keys", key[o])):  # keys last: a shard with keys is whole
                tmp = f"{base}.{name}.{uuid.uuid4().hex}"
                with open(tmp, "wb") as f:
                    f.write(np.ascontiguousarray(x).tobytes())
                os.replace(tmp, f"{base}.{name}")
            yield pa.RecordBatch.from_pydict({"shard": [int(s)], "n": [len(o)]}, pa.schema([("shard", pa.int32()), ("n", pa.int64())]))

    shard = (F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)).cast("int")
    own.withColumn("shard", shard).select("shard", "key", "entry").repartition(1 << bits, "shard").transform(_frames.mapped, write, "shard int, n long").agg(F.sum("n")).collect()
    return f"{path}?{bits}"


class Filter:
    """A built filter, mapped into memory."""

    def __init__(self, where: str):
        path, _, bits = where.rpartition("?")
        self.path, self.bits, self.shards = path, int(bits), {}

    def _shard(self, s: int):
        if s not in self.shards:
            base, x = f"{self.path}/{s:05d}", None
            if os.path.exists(f"{base}.keys") and os.path.getsize(f"{base}.keys"):
                x = [np.memmap(f"{base}.{n}", t, "r") for n, t in (("keys", np.uint64), ("offsets", np.int64), ("strings", np.uint8))]
            self.shards[s] = x
        return self.shards[s]

    def contains(self, texts: pa.Array, keys: np.ndarray) -> np.ndarray:
        """Which of the texts, with these xxHash keys, are entries."""
        out = np.zeros(len(texts), bool)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for s in np.unique(shard).tolist():
            if (x := self._shard(s)) is None:
                continue
            have, offsets, strings = x
            own = np.flatnonzero(shard == s)
            own = own[np.argsort(keys[own])]  # neighbouring probes touch neighbouring pages
            a, b = np.searchsorted(have, keys[own], "left"), np.searchsorted(have, keys[own], "right")
            hit = np.flatnonzero(a < b)
            for k, t in zip(hit.tolist(), texts.take(pa.array(own[hit])).to_pylist()):
                out[own[k]] = any(strings[offsets[j] : offsets[j + 1]].tobytes() == t.encode() for j in range(a[k], b[k]))
        return out


def report(pages: DataFrame, where: str) -> DataFrame:
    """One row per page: page_id, url, blocked, matched (the entry)."""
    held: dict[str, Filter] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = held.setdefault(where, Filter(where))
        for b in batches:
            texts, row = pc.list_flatten(b["probes"]), np.asarray(pc.list_parent_indices(b["probes"]))
            hits = np.flatnonzero(filt.contains(texts, np.asarray(pc.list_flatten(b["keys"])).view(np.uint64)))[::-1]
            first = np.full(b.num_rows, -1)
            first[row[hits]] = hits  # of a page's hits the first is written last
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(first >= 0), texts.take(pa.array(first, mask=first < 0))], names=["page_id", "url", "blocked", "matched"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    url, host = parts(F.col("url"))
    own = own.withColumns({"canon": url, "host": host}).withColumn("probes", probes(F.col("canon"), F.col("host")))
    return own.select("page_id", "url", "probes", F.transform("probes", lambda p: F.xxhash64(p)).alias("keys")).transform(_frames.mapped, run, REPORT)


URL_MOD, HOST_MOD = 20, 97


def sample_list(pages: DataFrame) -> DataFrame:
    """The list of the registered query: every 20th page's URL, every 97th page's host."""
    u = F.col("url")
    return pages.filter(F.col("page_id") % URL_MOD == 7).select("url").union(pages.filter(F.col("page_id") % HOST_MOD == 5).select(parts(u)[1].alias("url")))


ORACLE = rf"""WITH a AS (SELECT page_id, url, regexp_extract(trim(url), '(?s)^(?:(?:[A-Za-z][-A-Za-z0-9+.]*:)?//)?([^/?#]*)([^#]*)', ['net', 'rest']) AS u FROM pages),
 n AS (SELECT page_id, url, u.rest AS rest, lower(list_last(string_split(u.net, '@'))) AS net FROM a),
 q AS (SELECT page_id, url, rest, CASE WHEN regexp_matches(net, ':[0-9]*$') THEN list_last(string_split(net, ':')) END AS port, regexp_replace(net, ':[0-9]*$', '') AS host FROM n),
 p AS (SELECT page_id, url, rtrim(host, '.') AS host, rtrim(concat(rtrim(host, '.'), CASE WHEN port NOT IN ('', '80', '443') THEN concat(':', port) END, CASE WHEN rest[1] = '?' THEN '/' END, rest), '/') AS c FROM q),
 e AS (SELECT DISTINCT entry FROM (SELECT c AS entry FROM p WHERE page_id % {URL_MOD} = 7 UNION ALL SELECT host FROM p WHERE page_id % {HOST_MOD} = 5) WHERE entry <> ''),
 h AS (SELECT page_id, c, entry, CASE WHEN entry = c THEN 1000000 ELSE length(entry) END AS o FROM p, e WHERE entry = c OR entry = host OR (length(host) <= {LONGEST} AND ends_with(host, '.' || entry))),
 m AS (SELECT page_id, arg_max(entry, o) AS matched FROM h GROUP BY page_id)
SELECT p.page_id, url, matched IS NOT NULL AS blocked, matched FROM p LEFT JOIN m ON p.page_id = m.page_id"""
