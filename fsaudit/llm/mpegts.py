"""MPEG transport streams in a binary column.

``demux`` gives one row per media row, program and elementary stream: packets are found by their sync bytes, the program association and program map tables are
read (with CRC check), continuity counters are checked, elementary packets (PES) are reassembled, and their timestamps stored with the random-access points.

Defined results: null and empty media give no row, as do media without a valid program map. What precedes the first sync byte (one that three packets confirm, or fewer at the end) and a cut packet
at the end are skipped. Where a packet lacks its sync byte, it alone is skipped if the packets after it are in place; else the next confirmed sync byte is searched, and if that lies inside
the packet before, that one is too short and dropped. ``n_gaps`` and ``n_skipped`` count such places and their bytes in the whole medium. A counter that neither follows nor repeats the last is one error, unless the packet says that it is discontinuous; a repeated counter with a
payload is a duplicate, which is dropped and not an error. Packets flagged with a transport error, and elementary payload before the first PES start, are dropped; the latter is counted in ``n_orphans``. Scrambled packets count but give no
payload. PES without a timestamp have null. The first version of a table holds from the
beginning, a later one from where it ends; a stream has a row for each type that a program's maps give it, with the packets of that time, and a PID of several programs one for each. Repeated rows give repeated results; an empty table gives an empty result; other columns are never looked at.

``mux`` writes such streams; it serves as the source of test media.

Scale: one pass without shuffle; parsing is vectorised over all packets of a batch, and batches are bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.llm import _frames, _text

SIZE = 188
SCHEMA = "doc_id long, program int, pid int, stream_type int, n_packets int, cc_errors int, n_duplicates int, n_orphans int, pts array<long>, dts array<long>, random_access array<int>, sizes array<int>, n_gaps int, n_skipped int, data binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.int64()] + [pa.int32()] * 7 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.int32()] * 2 + [pa.binary()]

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32(head).to_bytes(4, "big")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29) & 14 | 1, (t >> 22) & 255, (t >> 14) & 254 | 1, (t >> 7) & 255, (t << 1) & 254 | 1])


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | 0x1000).to_bytes(2, "big"))
_PMT = _section(2, 1, b"\xe1\x00\xf0\x00" + b"\x1b\xe1\x00\xf0\x00" + b"\x0f\xe1\x01\xf0\x00")
VIDEO, AUDIO, UNIT, TICKS, KEY = 0x100, 0x101, 1024, 3600, 8


def mux(video: bytes, audio: bytes, unit: int = UNIT) -> bytes:
    """A program of two streams: video in units of ``unit`` bytes, each a PES with PTS and DTS, every eighth a random-access point; audio as one PES."""
    out, counter = [], {0: 0, 0x1000: 0, VIDEO: 0, AUDIO: 0}

    def packet(pid: int, start: bool, payload: bytes, random: bool = False) -> None:
        field = b"\x40" if random else b""
        room = SIZE - 4 - (2 if random else 0)
        if len(payload) < room:
            if not random:
                pad = room - len(payload) - 1
                field = b"\x00" if pad else b""
                head = bytes([pad]) + (field + b"\xff" * (pad - 1) if pad else b"")
            else:
                pad = room - len(payload)
                head = bytes([1 + pad]) + field + b"\xff" * pad
        else:
            head = b"\x01" + field if random else b""
        cc = counter[pid]
        counter[pid] = (cc + 1) & 15
        out.append(bytes([0x47, start << 6 | pid >> 8, pid & 255, (0x30 if head else 0x10) | cc]) + head + payload)

    def pes(pid: int, stream: int, data: bytes, t: int, random: bool) -> None:
        head = b"\x80\xc0\x0a" + _stamp(3, t + TICKS) + _stamp(1, t)
        n = len(head) + len(data)
        whole = b"\x00\x00\x01" + bytes([stream]) + (n if n < 65536 else 0).to_bytes(2, "big") + head + data
        at, first = 0, True
        while at < len(whole):
            room = SIZE - 4 - (2 if random and first else 0)
            packet(pid, first, whole[at : at + room], random and first)
            at, first = at + room, False

    for k in range(0, max(1, -(-len(video) // unit))):
        if k % KEY == 0:
            for pid, section in ((0, _PAT), (0x1000, _PMT)):
                packet(pid, True, (b"\x00" + section).ljust(SIZE - 4, b"\xff"))
        pes(VIDEO, 0xE0, video[k * unit : (k + 1) * unit], k * TICKS, k % KEY == 0)
        if k == 0:
            pes(AUDIO, 0xC0, audio, 0, True)
    return b"".join(out)


def _packets(d: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Where the packets begin, the places where sync was lost after the first, and the bytes skipped there."""
    n = len(d)
    good = d == 0x47
    sure = good.copy()  # by the next two packets, if there are so many
    for k in (1, 2):
        sure[: max(0, n - k * SIZE)] &= good[k * SIZE :]
    places, found, gaps, skipped = np.flatnonzero(sure), [], 0, 0
    at = int(places[0]) if len(places) else n
    places = places[(places + SIZE <= n) & (good[np.minimum(places + SIZE, n - 1)] | (places + SIZE == n))]
    while at < n:
        bad = np.flatnonzero(~good[at::SIZE][: (n - at) // SIZE])
        m = int(bad[0]) if len(bad) else (n - at) // SIZE
        found.append(at + SIZE * np.arange(m))
        if not len(bad):
            break
        p = at + SIZE * m
        if p + SIZE == n or p + SIZE < n and sure[p + SIZE]:
            to = p + SIZE
        else:
            k = int(np.searchsorted(places, p - SIZE, "right"))
            near = places[k : int(np.searchsorted(places, places[k] + SIZE))] if k < len(places) else places[:0]
            # Of the places in a packet's length, the one that most packets confirm.
            run = [int(np.argmin(np.append(good[q : q + 16 * SIZE : SIZE], False))) for q in near.tolist()]
            to = int(near[int(np.argmax(run))]) if run else n
            if to < p:
                found[-1], p = found[-1][:-1], p - SIZE
        gaps, skipped, at = gaps + 1, skipped + to - p, to
    return np.concatenate(found) if found else np.zeros(0, np.int64), gaps, skipped


def _sections(number: np.ndarray, packets: np.ndarray, start: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Valid sections of one PID's packets, with the number of the packet that shows their end; ``start`` has the payload starts, ``at`` where payloads begin."""
    held, i = b"", 0
    for i, p, s, a in zip(number.tolist(), packets, start, at):
        body = p[a:].tobytes()
        if s and body:
            tail, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if held:
                held += tail
                yield from ((i, x) for x in _whole(held))
            held = body
        elif held:
            held += body
        # A section is seen where it ends; what follows it in the packet is stuffing, or goes on in the next one.
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)):
            yield from ((i, x) for x in _whole(held[:n]))
            held = held[n:]
    yield from ((i, x) for x in _whole(held))


def _whole(data: bytes) -> Iterator[bytes]:
    while len(data) >= 3 and data[0] != 0xFF:
        n = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if len(data) < n:
            return
        if n >= 12 and crc32(data[:n]) == 0:
            yield data[:n]
        data = data[n:]


def _time(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return (x[:, 0] >> 1 & 7) << 30 | x[:, 1] << 22 | (x[:, 2] >> 1) << 15 | x[:, 3] << 7 | x[:, 4] >> 1


def demux_batch(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(row, program, pid, stream type, ...) as in SCHEMA for the media of a batch."""
    parts, row, gaps = [], [], {}
    for r in range(len(offsets) - 1):
        d = data[offsets[r] : offsets[r + 1]]
        begin, *lost = _packets(d)
        if len(begin):
            parts.append(d[begin[:, None] + np.arange(SIZE)])
            row.append(np.full(len(begin), r))
            gaps[r] = lost
    if not parts:
        return []
    p, row = np.concatenate(parts), np.concatenate(row)
    ok = (p[:, 0] == 0x47) & (p[:, 1] & 0x80 == 0)
    p, row = p[ok], row[ok]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, control, cc, clear = p[:, 1] & 0x40 != 0, p[:, 3] >> 4 & 3, p[:, 3] & 15, p[:, 3] & 0xC0 == 0
    adapted = control & 2 != 0
    size = np.where(adapted, p[:, 4].astype(np.int64) + 1, 0)
    at = np.minimum(4 + size, SIZE)
    has = (control & 1 != 0) & (at < SIZE)
    flags = np.where(adapted & (size > 1), p[:, 5], 0)
    random, broken = flags & 0x40 != 0, flags & 0x80 != 0
    # By row and PID, in order.
    o = np.lexsort((pid, row))
    key = row[o].astype(np.int64) << 13 | pid[o]
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(edge[1:], len(o))
    where = {int(key[a]): o[a:b] for a, b in zip(edge, ends)}
    out = []
    for r in np.unique(row).tolist():
        # Where each program's map is, by time: (from packet, PID or None). A section that is not yet in force doesn't count.
        tables: dict[int, list[tuple[int, int | None]]] = {}
        version, now = None, set()
        for i, x in _sections(*_take(where.get(r << 13), p, start, at, has)):
            if x[0] != 0 or not x[5] & 1:
                continue
            if version not in (None, x[5]):
                gone, now = now, set()
            else:
                gone = set()
            for k in range(8, len(x) - 4, 4):
                number, to = int.from_bytes(x[k : k + 2], "big"), int.from_bytes(x[k + 2 : k + 4], "big") & 0x1FFF
                if number:
                    had = tables.setdefault(number, [])
                    if number not in now and (not had or had[-1][1] != to):
                        had.append((i if had else -1, to))
                    now.add(number)
            if x[6] == x[7]:  # programs of the version before that this one no longer has
                for number in gone - now:
                    tables[number].append((i, None))
            version = x[5]
        for number, places in sorted(tables.items()):
            maps: list[tuple[int, dict[int, int]]] = []
            for (since, to), until in zip(places, [x[0] for x in places[1:]] + [len(p)]):
                for i, x in _sections(*_take(where.get(r << 13 | to), p, start, at, has)) if to is not None else [(since, None)]:
                    if x is None:
                        maps.append((since, {}))
                    elif x[0] == 2 and x[5] & 1 and int.from_bytes(x[3:5], "big") == number and (since < i <= until):
                        k, own = 12 + (int.from_bytes(x[10:12], "big") & 0xFFF), {}
                        while k + 5 <= len(x) - 4:
                            own.setdefault(int.from_bytes(x[k + 1 : k + 3], "big") & 0x1FFF, x[k])
                            k += 5 + (int.from_bytes(x[k + 3 : k + 5], "big") & 0xFFF)
                        if not maps or maps[-1][1] != own:
                            maps.append((i if maps else -1, own))
            for own, kind in dict.fromkeys(x for _, m in maps for x in m.items()):
                i = where.get(r << 13 | own, np.zeros(0, np.int64))
                use = np.zeros(len(i), bool)
                for (since, m), until in zip(maps, [x[0] for x in maps[1:]] + [len(p)]):
                    if m.get(own) == kind:
                        use |= (i > since) & (i <= until)
                *x, body = _stream(i[use], p, start, at, has & clear, cc, random, broken)
                out.append((r, number, own, kind, *x, *gaps[r], body))
    return out


def _take(idx: np.ndarray | None, p: np.ndarray, start: np.ndarray, at: np.ndarray, has: np.ndarray) -> tuple:
    idx = np.zeros(0, np.int64) if idx is None else idx[has[idx]]
    return idx, p[idx], start[idx], at[idx].tolist()


def _stream(i: np.ndarray, p, start, at, has, cc, random, broken) -> tuple:
    """Counts, timestamps and payload of the packets i of one stream."""
    n, c, payload = len(i), cc[i].astype(np.int64), has[i]
    step = np.diff(c, prepend=c[:1] - 1 if n else 0) & 15
    # A packet without payload keeps the counter, one with payload moves it on by one or repeats the packet.
    plain = p[i, 3] & 0x10 != 0
    twice = plain & (step == 0)
    twice[:1] = False
    wrong = np.where(plain, (step != 1) & ~twice, step != 0) & ~broken[i]
    wrong[:1] = False
    use = payload & ~twice
    i, j = i[use], np.flatnonzero(use)
    first = np.flatnonzero(start[i])
    orphans = int(first[0]) if len(first) else len(i)
    i, first = i[orphans:], first - orphans
    mask = np.arange(SIZE)[None, :] >= at[i][:, None]
    flat = p[i][mask]
    total = np.concatenate([[0], np.cumsum(SIZE - at[i])])
    begin = total[first]
    end = np.append(begin[1:], total[-1])
    pts, dts, points, sizes, data = [], [], [], [], []
    for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
        x = flat[b : e]
        t = d = None
        body = x[:0]
        if len(x) >= 6 and x[0] == 0 and x[1] == 0 and x[2] == 1:
            n_pes = int(x[4]) << 8 | int(x[5])
            if n_pes:
                x = x[: 6 + n_pes]
            if x[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):  # these have no header of their own
                body = x[6:]
            elif len(x) >= 9:
                body = x[9 + int(x[8]) :]
                if x[7] & 0x80 and len(x) >= 14:
                    t = int(_time(x[None, 9:14])[0])
                if x[7] & 0x40 and len(x) >= 19:
                    d = int(_time(x[None, 14:19])[0])
        if random[i[first[k]]]:
            points.append(k)
        pts.append(t)
        dts.append(d)
        sizes.append(len(body))
        data.append(body)
    return n, int(wrong.sum()), int(twice.sum()), orphans, pts, dts, points, sizes, np.concatenate(data).tobytes() if data else b""


def demux(media: DataFrame, column: str = "media") -> DataFrame:
    _frames.bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _text.buffers(b["media"])
            ids = b["doc_id"].to_pylist()
            for i, j in _text.blocks(offsets):
                rows = demux_batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i + x[0]] for x in rows], pa.int64()), *(pa.array([x[k] for x in rows], t) for k, t in enumerate(_KINDS[1:], 1))], names=_NAMES)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("media")).transform(_frames.mapped, run, SCHEMA)


def mux_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, media) with the page's html as video and its url as audio."""
    _frames.bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [mux((h or "").encode(), (u or "").encode()) for u, h in zip(b["url"].to_pylist(), b["html"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array(media, pa.binary())], names=["doc_id", "media"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).transform(_frames.mapped, run, "doc_id long, media binary")


ORACLE = f"""WITH v AS (SELECT page_id, greatest(1, CAST(ceil(octet_length(encode(html)) / {UNIT}) AS BIGINT)) AS n, octet_length(encode(html)) AS b, md5(html) AS h FROM pages)
SELECT page_id AS doc_id, 1 AS program, {VIDEO} AS pid, 27 AS stream_type, 0 AS cc_errors, n AS n_pes, CAST(b AS BIGINT) AS n_bytes, h AS md5,
 array_to_string(list_transform(generate_series(1, n), lambda k: k * {TICKS}), ',') AS timestamps,
 array_to_string(generate_series(0, n - 1, {KEY}), ',') AS random_access FROM v
UNION ALL SELECT page_id, 1, {AUDIO}, 15, 0, 1, CAST(octet_length(encode(url)) AS BIGINT), md5(url), '{TICKS}', '0' FROM pages"""
