"""Licence scan by canonical digests.

A text becomes canonical by: lower case; copyright lines dropped; words (kind ALNUM of ``_text``) joined by single spaces; equivalent spellings, word by word, to one of them. The SHA-256
digest of the whole canonical text is hash-joined to the digests of known licences.

A copyright line begins, after signs, with ``copyright`` and ``(c)`` or ``©`` in either order, with ``©``, or with ``copyright`` or ``(c)`` before a year or its placeholder; or it says ``all rights reserved`` and nothing else. Such lines are dropped where they are a paragraph by themselves and in the head,
which is what comes before the body; the body begins with the first paragraph (lines with words, and none without between them) of at least ``BODY`` words outside copyright lines, after those at its top; a text without such a paragraph is all head. So clauses
that begin with ``(c)``, and lines of the body that happen to begin with the word, count like any other.

Defined results: null texts have a null digest and no licence, as have texts whose canonical form is empty; repeated rows get equal results; a licence known under
two names with one digest goes by the first name; an empty table gives an empty result; without known licences nothing matches; other columns are never looked at.

Scale: one pass, vectorised over the bytes of a batch; only texts with a copyright line or another spelling are touched one by one. The documents' digests are not shuffled while the known ones are under the session's broadcast threshold, and are hash-joined beyond it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

BODY = 20
#: Of a lower-cased line.
NOTICE = r"^[^a-z0-9©]*(?:copyright[ \t]*(?:\(c\)|©)|\(c\)[ \t]*copyright|©|(?:copyright|\(c\))[ \t,:]*(?:by[ \t]+)?(?:(?:19|20)[0-9][0-9](?:[^0-9]|$)|[\[<{](?:yyyy|year)[\]>}]))"
RESERVED = r"^[^a-z0-9]*all[ \t]+rights[ \t]+reserved[^a-z0-9]*$"
_NOTICE, _WORD = re.compile(f"{NOTICE}|{RESERVED}"), re.compile(r"[a-z0-9\x80-\U0010ffff]+")
_MARKS = ("copyright", "(c)", "©", "all rights", "all\trights")
SPELLINGS = {
    "licence": "license", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations", "favour": "favor", "honour": "honor", "behaviour": "behavior", "colour": "color",
    "judgement": "judgment", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "merchantibility": "merchantability", "analogue": "analog", "whilst": "while", "https": "http",
}
#: Two words, after the spellings of each, that are also written as one.
JOINED = {("sub", "license"): "sublicense", ("non", "infringement"): "noninfringement", ("per", "cent"): "percent"}
_ONE = {a.encode(): b.encode() for a, b in SPELLINGS.items()}
_TWO = {(a.encode(), b.encode()): c.encode() for (a, b), c in JOINED.items()}
#: A text that needs its spellings looked at has one of these.
_STEMS = ("licence", "organisation", "avour", "honour", "behaviour", "colour", "judgement", "acknowledgement", "merchantibility", "analogue", "whilst", "https", "sub licen", "non infringement", "per cent")

#: SHA-256 of the canonical texts of public licences; the texts themselves are not kept here.
KNOWN: dict[str, str] = {
    "Apache-2.0": "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "BSD-3-Clause-UC": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "24a668c9e3fb6a8186f46c6a4eaaf14ee1a1f96f57f74b91ab2bdac712581b9d",
    "GFDL-1.3": "75c632ea5d8952669a1d595cafa1ba48ef8956e48479d9f234e1b803f3bb3a65",
    "GPL-1.0": "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6",
    "GPL-2.0": "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7",
    "GPL-3.0": "cc8c7596e87658cdffe98ce31be98b303df2589758bd6d4365cdb496f419c85f",
    "LGPL-2.0": "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614",
    "LGPL-2.1": "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    "MIT": "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127",
    "Unlicense": "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
    "BSD-2-Clause": "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
    "BSD-3-Clause": "c165caf2263156afde96f4b02327c2ba96c47bd8cff887df37a4210399885793",
}


def without_notices(text: str) -> str:
    """A lower-cased text without its copyright lines."""
    lines = text.split("\n")
    notice = [bool(_NOTICE.search(x)) for x in lines]
    words = [len(_WORD.findall(x)) for x in lines]
    body, i, drop = len(lines), 0, set()
    while i < len(lines):
        j = i
        while j < len(lines) and words[j]:
            j += 1
        own = [k for k in range(i, j) if not notice[k]]
        if body == len(lines) and sum(words[k] for k in own) >= BODY:
            body = own[0]
        drop |= {k for k in range(i, max(j, i + 1)) if notice[k] and (k < body or not own)}
        i = j + 1
    return "\n".join(x for k, x in enumerate(lines) if k not in drop)


def _spelled(words: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    for w in words:
        w = _ONE.get(w, w)
        if out and (both := _TWO.get((out[-1], w))):
            out[-1] = both
        else:
            out.append(w)
    return out


def _any(col: pa.Array, parts: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(col), bool)
    for x in parts:
        out |= np.asarray(pc.fill_null(pc.match_substring(col, x), False))
    return out


def canonical(texts: pa.Array) -> Iterator[bytes]:
    """The canonical form of each text; empty for null."""
    for i, j in _text.blocks(_text.buffers(texts)[1]):
        col = _text.lower(texts.slice(i, j - i)).fill_null("")
        if (rows := np.flatnonzero(_any(col, _MARKS))).size:
            mask = np.zeros(len(col), bool)
            mask[rows] = True
            col = pc.replace_with_mask(col, pa.array(mask), pa.array([without_notices(x) for x in col.take(pa.array(rows)).to_pylist()], col.type))
        # With a space after each text, every word has a sign behind it: that becomes its space, all others go.
        data, offsets = _text.buffers(pc.binary_join_element_wise(col, "", " "))
        inside = _text.CLASSES["ALNUM"][data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        flat = np.where(inside, data, 32).astype(np.uint8)[keep].tobytes()
        at = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
        flat_col = pa.array([flat[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:])], pa.binary()).cast(pa.string(), safe=False)
        odd = _any(flat_col, _STEMS)
        for x, special in zip(flat_col.cast(pa.binary()).to_pylist(), odd.tolist()):
            yield b" ".join(_spelled(x.split(b" "))) if special else x


def _digests(df: DataFrame, kept: str, kind: str) -> DataFrame:
    """(kept, digest) of a table with a column ``kept`` and texts."""
    _frames.bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[kept], pa.array([hashlib.sha256(x).hexdigest() if x else None for x in canonical(b["text"])], pa.string())], names=[kept, "digest"])

    return df.select(F.col(kept).cast(kind).alias(kept), F.col("text").cast("string").alias("text")).transform(_frames.mapped, run, f"{kept} {kind}, digest string")


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of the built-in catalogue."""
    return spark.createDataFrame([(d, n) for n, d in KNOWN.items()], "digest string, license string")


def catalogue(texts: DataFrame) -> DataFrame:
    """(digest, license) of a table (license, text) of known licences."""
    return _digests(texts, "license", "string").select("digest", "license")


def report(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest, license (null if not known)."""
    held = licenses if licenses is not None else known(docs.sparkSession)
    held = held.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))
    return _digests(docs, "doc_id", "long").join(held, "digest", "left").select("doc_id", "digest", "license")


OWN_MOD = 97


def own_licenses(docs: DataFrame) -> DataFrame:
    """The catalogue of the registered query: the built-in one, and every 97th document as a text of the house."""
    return known(docs.sparkSession).unionByName(catalogue(docs.filter(F.col("doc_id") % OWN_MOD == 5).select(F.concat(F.lit("own-"), F.col("doc_id").cast("string")).alias("license"), "text")))


def oracle() -> str:
    rows = ", ".join(f"('{d}', '{n}')" for n, d in KNOWN.items())
    one = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items())
    joined = "x"
    for (a, b), c in JOINED.items():
        joined = f"replace({joined}, ' {a}  {b} ', ' {c} ')"
    return rf"""WITH l AS (SELECT rn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT rn, string_split(lower(text), chr(10)) AS lines FROM (SELECT row_number() OVER () AS rn, text FROM documents))),
 w AS (SELECT rn, i, list_filter(regexp_split_to_array(line, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w, regexp_matches(line, '{NOTICE}') OR regexp_matches(line, '{RESERVED}') AS notice FROM l),
 p AS (SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i) AS part FROM w),
 b AS (SELECT rn, min(part) AS part FROM (SELECT rn, part FROM p WHERE NOT notice GROUP BY rn, part HAVING sum(len(w)) >= {BODY}) GROUP BY rn),
 t AS (SELECT p.rn, min(i) AS top FROM p JOIN b ON p.rn = b.rn AND p.part = b.part WHERE NOT notice AND len(w) > 0 GROUP BY p.rn),
 o AS (SELECT rn, part FROM p WHERE len(w) > 0 GROUP BY rn, part HAVING bool_and(notice)),
 k AS (SELECT p.rn, i, list_transform(w, lambda x: CASE x {one} ELSE x END) AS w FROM p LEFT JOIN t ON p.rn = t.rn LEFT JOIN o ON p.rn = o.rn AND p.part = o.part WHERE NOT notice OR (i >= top AND o.rn IS NULL)),
 x AS (SELECT rn, concat(' ', string_agg(array_to_string(w, '  '), '  ' ORDER BY i), ' ') AS x FROM k WHERE len(w) > 0 GROUP BY rn),
 d AS (SELECT n.doc_id, sha256(nullif(trim(regexp_replace({joined}, ' +', ' ', 'g')), '')) AS digest FROM (SELECT row_number() OVER () AS rn, doc_id FROM documents) n LEFT JOIN x ON n.rn = x.rn),
 c AS (SELECT digest, min(license) AS license FROM (SELECT * FROM (VALUES {rows}) v(digest, license) UNION ALL SELECT digest, concat('own-', doc_id) FROM d WHERE doc_id % {OWN_MOD} = 5 AND digest IS NOT NULL) GROUP BY digest)
SELECT doc_id, d.digest, license FROM d LEFT JOIN c ON d.digest = c.digest"""
