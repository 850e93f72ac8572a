"""MPEG transport streams as media columns.

`mux` stores bytes in a transport stream: program association and map tables
with their CRC, and one private elementary stream of timestamped packets.
`demux` reads any such stream back: it finds the packets' rhythm again where bytes were put in or lost, assembles the tables' sections
over as many packets as they take, follows each packet identifier's continuity counter, reassembles the elementary packets, and
gives their timestamps and the packets where decoding can start.

Defined results: a null text is empty; an empty text is one block of spaces; a very long text has as many packets as it needs, its counters and clock
going round; equal texts have equal media; repeated rows and rows without an id are stored each; other columns are not looked at. Media that are null or hold no
elementary packet have a null payload. An elementary packet that is shorter than it says, or in which the counter
jumps, is damaged: it is counted in `damaged`, and the payload is null, as it is where the counter
jumps between two of them; `whole` holds what the undamaged ones carry.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, emit, id_and_text

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0101, 0x1FFF
PRIVATE_PES, STREAM_ID = 0x06, 0xBD
#: Bytes that a payload is padded to, bytes of an access unit, access units between random-access points, 90 kHz ticks of one.
BLOCK, UNIT, RAP_EVERY, TICKS = 192, 192 * 16, 8, 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC of program tables; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter) + b"\x00" + section).ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(0x02, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_PES, 0xE000 | ES_PID, 0xF000))
_PATS = [_table_packet(PAT_PID, _PAT, i) for i in range(16)]
_PMTS = [_table_packet(PMT_PID, _PMT, i) for i in range(16)]


def _pts(t: int) -> bytes:
    return bytes((0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE))


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of BLOCK, and the length before."""
    raw = text.encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" "), len(raw)


def mux_bytes(payload: bytes) -> bytes:
    out, counter = [], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        t = (i * TICKS) & 0x1FFFFFFFF
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, (len(unit) + 8) & 0xFFFF, 0x84, 0x80, 5) + _pts(t) + unit
        if i % RAP_EVERY == 0:
            k = i // RAP_EVERY % 16
            out += (_PATS[k], _PMTS[k])
            field = b"\x07\x50" + struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
        else:
            field = b""
        room, start = PACKET - 4 - len(field), 0
        first = True
        while start < len(pes):
            part = pes[start : start + room]
            if len(part) < room:
                short = room - len(part)
                field = bytes((short - 1,)) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"") if not field else bytes((7 + short,)) + field[1:] + b"\xff" * short
            out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | ES_PID, (0x30 if field else 0x10) | counter) + field + part)
            start += len(part)
            counter, field, room, first = (counter + 1) & 15, b"", PACKET - 4, False
    return b"".join(out)


def _packets(media: bytes) -> tuple[np.ndarray, int]:
    """(packets, stretches of bytes skipped): the rhythm of sync bytes, sought again where it breaks."""
    n = len(media)
    whole = n // PACKET
    p = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    if (p[:, 0] == SYNC).all() and n % PACKET == 0:
        return p, 0
    starts, at, lost = [], 0, 0

    def begins(at: int) -> bool:
        """Whether a packet begins here, as the next two say."""
        return media[at] == SYNC and all(q >= n or media[q] == SYNC for q in (at + PACKET, at + 2 * PACKET))

    while at + PACKET <= n:
        if media[at] == SYNC and (starts and starts[-1] + PACKET == at or begins(at)):
            starts.append(at)
            at += PACKET
            continue
        lost += 1
        at = media.find(SYNC, at + 1)
        while 0 <= at <= n - PACKET and not begins(at):
            at = media.find(SYNC, at + 1)
        if at < 0:
            at = n
    lost += at < n
    raw = np.frombuffer(media, np.uint8)
    return raw[np.array(starts, np.int64)[:, None] + np.arange(PACKET)] if starts else p[:0], lost


def _sections(p: np.ndarray, first: np.ndarray, starts: np.ndarray, counter: np.ndarray) -> list[bytes]:
    """Distinct sections with a right CRC among one identifier's packets in order, each over as many packets as it takes."""
    out: dict[bytes, None] = {}
    held, last = b"", -1

    def take(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            end = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < end:
                return data
            if end >= 12 and crc32_mpeg(data[:end]) == 0:
                out[data[:end]] = None
            data = data[end:]
        return b"" if data[:1] == b"\xff" else data

    for row, o, start, c in zip(p, first.tolist(), starts.tolist(), counter.tolist(), strict=True):
        if o >= PACKET or c == last:
            continue
        raw = row.tobytes()[o:]
        if held and c != (last + 1) % 16:
            held = b""
        last = c
        if start:
            after = 1 + raw[0]
            if held:
                take(held + raw[1:after])
            held = take(raw[after:])
        elif held:
            held = take(held + raw)
    return list(out)


def demux_bytes(media: bytes | None) -> dict:
    """What a stream holds: payload (null if anything is missing), whole (what undamaged elementary packets carry), and the figures of DEMUX."""
    out = {"payload": None, "whole": None, "packets": 0, "programs": 0, "streams": 0, "pes": 0, "damaged": 0, "cc_errors": 0, "duplicates": 0, "lost_sync": 0, "pts": [], "rap_packets": []}
    if not media:
        return out
    p, lost = _packets(media)
    bad = p[:, 1] & 0x80 != 0
    out["packets"], out["lost_sync"] = len(p), lost + int(bad.sum())
    if not len(p):
        return out
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pid[bad] = NULL_PID
    starts, control, counter = p[:, 1] & 0x40 != 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    has, adapts = control & 1 == 1, control & 2 == 2
    offset = np.where(adapts, 5 + p[:, 4].astype(np.int32), 4)
    flags = np.where(adapts & (p[:, 4] > 0), p[:, 5], 0)

    def tables(of: int) -> list[bytes]:
        rows = np.flatnonzero((pid == of) & has)
        return _sections(p[rows], offset[rows], starts[rows], counter[rows])

    pmts: dict[int, None] = {}
    for s in tables(PAT_PID):
        for i in range(8, len(s) - 4, 4):
            number, at = struct.unpack(">HH", s[i : i + 4])
            if number:
                pmts[at & 0x1FFF] = None
    streams: dict[int, int] = {}
    for m in pmts:
        for s in tables(m):
            i = 12 + (struct.unpack(">H", s[10:12])[0] & 0x0FFF)
            while i + 5 <= len(s) - 4:
                kind, es, info = struct.unpack(">BHH", s[i : i + 5])
                streams[es & 0x1FFF] = kind
                i += 5 + (info & 0x0FFF)
    out["programs"], out["streams"] = len(pmts), len(streams)
    payload: list[bytes] = []
    missing = 0
    for es in [PAT_PID, *pmts, *streams]:
        rows = np.flatnonzero((pid == es) & has)
        if not len(rows):
            continue
        step = (counter[rows][1:].astype(np.int16) - counter[rows][:-1]) % 16
        same = np.concatenate(([False], step == 0))
        jump = np.concatenate(([False], (step != 1) & (step != 0) & (flags[rows][1:] & 0x80 == 0)))
        out["cc_errors"] += int(jump.sum())
        out["duplicates"] += int(same.sum())
        if es not in streams:
            continue
        missing += int(jump.sum())
        keep = ~same & (offset[rows] < PACKET)
        rows, jump = rows[keep], jump[keep]
        if not len(rows):
            continue
        q = p[rows]
        size = PACKET - offset[rows]
        data = q[np.arange(PACKET) >= offset[rows][:, None]].tobytes()
        begin = np.concatenate(([0], np.cumsum(size)))
        heads = np.flatnonzero(starts[rows])
        missing += int(not len(heads) or heads[0] > 0)  # packets before the first head
        for j, at in enumerate(heads):
            end = heads[j + 1] if j + 1 < len(heads) else len(rows)
            pes = data[begin[at] : begin[end]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out["damaged"] += 1
                continue
            body, want = 9 + pes[8], struct.unpack(">H", pes[4:6])[0]
            out["pes"] += 1
            if jump[at + 1 : end].any() or want and len(pes) < 6 + want or len(pes) < body:
                out["damaged"] += 1
                continue
            payload.append(pes[body : 6 + want] if want else pes[body:])
            if pes[7] & 0x80 and len(pes) >= 14:
                a, b, c, d, e = pes[9:14]
                t = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
                out["pts"].append(t)
                if flags[rows[at]] & 0x40:
                    out["rap_packets"].append(int(rows[at]))
    if payload:
        out["whole"] = b"".join(payload)
        out["payload"] = None if missing or out["damaged"] or lost else out["whole"]
    return out


MUX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
DEMUX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary()), ("whole", pa.binary()), ("packets", pa.int64()), ("programs", pa.int32()), ("streams", pa.int32()), ("pes", pa.int64()), ("damaged", pa.int64()), ("cc_errors", pa.int64()), ("duplicates", pa.int64()), ("lost_sync", pa.int64()), ("pts", pa.list_(pa.int64())), ("rap_packets", pa.list_(pa.int64()))])
_NAMES = DEMUX.names[4:]


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded, as a stored transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    payload, n = padded(t)
                    yield i, n, mux_bytes(payload)

        return emit(rows(), MUX, lambda r: len(r[2]) + 32)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def demux(media: DataFrame) -> DataFrame:
    """What `demux_bytes` reads from each row's stored media; whole is null where the payload is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for *kept, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "media")), strict=True):
                    found = demux_bytes(m)
                    if found["payload"] is not None:
                        found["whole"] = None  # the same bytes
                    yield *kept, *(found[n] for n in _NAMES)

        return emit(rows(), DEMUX, lambda r: len(r[4] or b"") + len(r[5] or b"") + 256)

    held = media.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return held.mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, whole binary, packets long, programs int, streams int, pes long, damaged long, cc_errors long, duplicates long, lost_sync long, pts array<long>, rap_packets array<long>")


def op1_media_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a transport stream, read back and described; pts: the clock of each access unit, rap_packets: the packets where decoding can start."""
    d = demux(mux(documents(spark, sf_dir)))
    feature = F.format_string(
        "programs=%d;streams=%d;packets=%d;pes=%d;damaged=%d;cc_errors=%d;duplicates=%d;lost_sync=%d;first_pts=%d;last_pts=%d;rap=%d",
        "programs", "streams", "packets", "pes", "damaged", "cc_errors", "duplicates", "lost_sync",
        F.coalesce(F.try_element_at("pts", F.lit(1)), F.lit(-1)), F.coalesce(F.try_element_at("pts", F.lit(-1)), F.lit(-1)), F.size("rap_packets"),
    )
    return d.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), "pts", "rap_packets")
