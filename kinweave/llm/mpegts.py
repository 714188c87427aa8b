"""Media columns of MPEG transport streams.

``parse`` reads 188-byte transport packets: the program association and program
map tables (with their checksums), the continuity counter of every stream, and
the packetised elementary stream (PES) packets with their time stamps and
random-access points.  ``mux`` writes a payload as one private data stream, so
that any bytes can be kept in the format and read back.

Tables may run over several packets and packets may hold several tables.  A
packet with the counter of the one before is a repeat only if its bytes are the
same (its clock reference aside); otherwise packets were lost.  A table or PES
packet that misses a transport packet is given up or marked ``damaged``.  Packets
marked as faulty or scrambled are taken as missing.  Data packets of streams that
no table has named yet are counted; tables come again at each random-access point.
A sync byte is believed if another stands a packet further, so that stray ones
before or between packets cost no packet.

Defined results: a null value has null media columns; a stream cut short or with
bad checksums or counters is read as far as it goes and says so in its columns;
bytes that aren't a transport stream have no programs and no data; empty bytes
are an empty stream.  Media of any length are held as a whole, with their copy, in
their task; equal rows give equal columns, an empty table an empty one, and columns
named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, map_batches, texts

#: Fixed values of the format.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0
_TABLE_PAT, _TABLE_PMT = 0x00, 0x02
PRIVATE_STREAM_TYPE, PRIVATE_STREAM_ID = 0x06, 0xBD
_CLOCK = 90_000
_CRC_POLYNOMIAL = 0x04C11DB7


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (_CRC_POLYNOMIAL if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


@dataclass
class Pes:
    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes
    damaged: bool = False


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number to PMT pid
    streams: dict[int, int] = field(default_factory=dict)  # elementary pid to stream type
    bad_tables: int = 0
    lost: int = 0  # breaks of a continuity counter
    repeated: int = 0  # packets sent twice
    broken: int = 0  # bytes that are no packet
    unnamed: int = 0  # packets of streams that no table has named
    unreadable: int = 0  # packets marked as faulty or scrambled
    pes: list[Pes] = field(default_factory=list)

    def data(self, pid: int) -> bytes:
        """The elementary stream of one pid."""
        return b"".join(p.data for p in self.pes if p.pid == pid)


class _Sections:
    """Collects the table sections of one pid."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def take(self, payload: bytes, begins: bool, lost: bool) -> list[bytes]:
        """The sections that this packet completes."""
        done: list[bytes] = []
        if lost:
            self.held = None
        if not begins:
            if self.held is not None:
                self.held += payload
                self._cut(done)
            return done
        pointer = payload[0] if payload else 0
        if self.held is not None:
            self.held += payload[1 : 1 + pointer]
            self._cut(done)
        self.held = payload[1 + pointer :]
        self._cut(done)
        return done

    def _cut(self, done: list[bytes]) -> None:
        while self.held is not None and len(self.held) >= 3:
            if self.held[0] == 0xFF:  # stuffing
                self.held = None
                return
            end = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
            if len(self.held) < end:
                return
            done.append(self.held[:end])
            self.held = self.held[end:] or None


def _stamp(b: bytes) -> int:
    return ((b[0] >> 1) & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _stamped(mark: int, t: int) -> bytes:
    return bytes([(mark << 4) | ((t >> 30) & 7) << 1 | 1, (t >> 22) & 255, ((t >> 15) & 127) << 1 | 1, (t >> 7) & 255, (t & 127) << 1 | 1])


def _pes(pid: int, raw: bytes, random_access: bool, damaged: bool = False) -> Pes | None:
    if len(raw) < 9 or raw[:3] != b"\x00\x00\x01":
        return None
    flags, head = raw[7] >> 6, raw[8]
    pts = _stamp(raw[9:14]) if flags & 2 and len(raw) >= 14 else None
    dts = _stamp(raw[14:19]) if flags == 3 and len(raw) >= 19 else pts
    length = struct.unpack(">H", raw[4:6])[0]
    end = 6 + length if length else len(raw)
    return Pes(pid, raw[3], pts, dts, random_access, raw[9 + head : end], damaged or end > len(raw))


def _is_sync(media: bytes, at: int) -> bool:
    """Whether a packet can begin at ``at``, or the data ends before it."""
    return at >= len(media) or media[at] == SYNC


def _next_sync(media: bytes, at: int) -> int:
    """The first place from ``at`` on with a sync byte that two others follow in step, or the data's end; else the end."""
    at = media.find(SYNC, at)
    while at >= 0 and not (at + PACKET <= len(media) and _is_sync(media, at + PACKET) and _is_sync(media, at + 2 * PACKET)):
        at = media.find(SYNC, at + 1)
    return len(media) if at < 0 else at


def _believed(media: bytes, at: int, locked: bool) -> bool:
    """Whether a packet begins at ``at``; ``locked``: one has just ended there.

    A sync byte counts if the next is in its place.  After a good packet it also
    counts if bytes were put in or spoilt behind it, that is if packets don't go on
    in step from a place inside of it.
    """
    if media[at] != SYNC:
        return False
    if _is_sync(media, at + PACKET):
        return True
    if not locked:
        return False
    return _next_sync(media, at + 1) >= at + PACKET


def parse(media: bytes) -> Stream:
    """Read a transport stream in order of its packets."""
    out = Stream()
    counter: dict[int, tuple[int, bytes]] = {}
    open_: dict[int, list] = {}  # parts, random access, damaged
    sections: dict[int, _Sections] = {PAT_PID: _Sections()}

    def close(pid: int) -> None:
        if pid in open_:
            parts, random_access, damaged = open_.pop(pid)
            p = _pes(pid, b"".join(parts), random_access, damaged)
            if p is None:
                out.broken += sum(map(len, parts))
            else:
                out.pes.append(p)

    def table(pid: int, s: bytes) -> None:
        if len(s) < 12 or crc32_mpeg(s) != 0:
            out.bad_tables += 1
        elif pid == PAT_PID and s[0] == _TABLE_PAT:
            for k in range(8, len(s) - 4, 4):
                number, p = struct.unpack(">HH", s[k : k + 4])
                if number:
                    out.programs[number] = p & 0x1FFF
                    sections.setdefault(p & 0x1FFF, _Sections())
        elif s[0] == _TABLE_PMT:
            k = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                kind, p, info = struct.unpack(">BHH", s[k : k + 5])
                out.streams[p & 0x1FFF] = kind
                k += 5 + (info & 0x0FFF)

    at, n, locked = 0, len(media), False
    while at + PACKET <= n:
        nxt = at if _believed(media, at, locked) else _next_sync(media, at + 1)
        if nxt > at:
            out.broken += nxt - at
            at, locked = nxt, False
            continue
        out.packets += 1
        locked = True
        b1, b2, b3 = media[at + 1], media[at + 2], media[at + 3]
        if b1 & 0x80 or b3 & 0xC0:
            # marked as faulty, or scrambled: as if it were missing, which the counter of the next shows
            out.unreadable += 1
            at += PACKET
            continue
        pid, begins, control, cc = (b1 & 0x1F) << 8 | b2, bool(b1 & 0x40), (b3 >> 4) & 3, b3 & 15
        start, end, random_access, jump = at + 4, at + PACKET, False, False
        if control & 2:
            size = media[start]
            if size:
                random_access, jump = bool(media[start + 1] & 0x40), bool(media[start + 1] & 0x80)
            start += 1 + size
        at = end
        if pid == NULL_PID or not control & 1 or start > end:
            continue
        payload = media[start:end]
        last = counter.get(pid)
        lost = False
        if last is not None and not jump:
            if cc == last[0] and payload == last[1]:
                out.repeated += 1
                continue
            lost = cc != (last[0] + 1) & 15
            out.lost += lost
        counter[pid] = (cc, payload)
        if pid in sections:
            for s in sections[pid].take(payload, begins, lost):
                table(pid, s)
        elif pid in out.streams:
            if begins:
                if lost and pid in open_:
                    open_[pid][2] = True
                close(pid)
                open_[pid] = [[payload], random_access, False]
            elif pid in open_:
                open_[pid][0].append(payload)
                open_[pid][2] |= lost
            else:
                out.broken += len(payload)  # the packet's beginning is missing
        else:
            out.unnamed += 1
    out.broken += n - at
    for pid in sorted(open_):
        close(pid)
    return out


def _table(pid: int, body: bytes, cc: int) -> bytes:
    section = body + struct.pack(">I", crc32_mpeg(body))
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | cc) + b"\x00" + section
    return packet + b"\xff" * (PACKET - len(packet))


def _tables(pmt_pid: int, pid: int, kind: int, cc: int) -> tuple[bytes, bytes]:
    pat = struct.pack(">BHHBBB", _TABLE_PAT, 0xB000 | 13, 1, 0xC1, 0, 0) + struct.pack(">HH", 1, 0xE000 | pmt_pid)
    pmt = struct.pack(">BHHBBBHH", _TABLE_PMT, 0xB000 | 18, 1, 0xC1, 0, 0, 0xE000 | pid, 0xF000) + struct.pack(">BHH", kind, 0xE000 | pid, 0xF000)
    return _table(PAT_PID, pat, cc), _table(pmt_pid, pmt, cc)


_PMT_PID, _DATA_PID = 0x0100, 0x0101


def mux(payload: bytes, pes_bytes: int = 48_000, every: int = 4, ticks: int = 3_600) -> bytes:
    """``payload`` as a transport stream of one program with one private data stream.

    PES packets hold ``pes_bytes`` each, ``ticks`` of the 90 kHz clock apart;
    every ``every``-th is a random-access point, with the tables before it, so
    that a reader may begin there.
    """
    tables = lambda n: _tables(_PMT_PID, _DATA_PID, PRIVATE_STREAM_TYPE, n & 15)
    out, cc = [] if payload else [*tables(0)], 0
    for i, a in enumerate(range(0, len(payload), pes_bytes)):
        if i % every == 0:
            out += tables(i // every)
        part = payload[a : a + pes_bytes]
        body = struct.pack(">BBB", 0x84, 0x80, 5) + _stamped(2, _CLOCK + i * ticks)
        raw = struct.pack(">IH", 0x100 | PRIVATE_STREAM_ID, len(body) + len(part)) + body + part
        packets, cc = _packets(raw, _DATA_PID, cc, i % every == 0)
        out.append(packets)
    return b"".join(out)


def _packets(raw: bytes, pid: int, cc: int, random_access: bool) -> tuple[bytes, int]:
    """A PES packet as transport packets; the first has the flag, the first or last the stuffing."""
    room = PACKET - 4
    first = room - 2 if random_access else room
    n = 1 if len(raw) <= first else 1 + -(-(len(raw) - first) // room)
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, pid >> 8, pid & 255
    out[:, 3] = 0x10 | ((cc + np.arange(n)) & 15)
    out[0, 1] |= 0x40
    data = np.frombuffer(raw, dtype=np.uint8)
    at = 0
    for i in sorted({0, n - 1}):
        # packets with an adaptation field; those between are full
        flag = random_access and i == 0
        space = first if i == 0 else room
        take = min(space, len(data) - at) if i == 0 else len(data) - at
        if i and n > 2:
            whole = (n - 2) * room
            out[1 : n - 1, 4:] = data[at : at + whole].reshape(n - 2, room)
            at += whole
            take = len(data) - at
        gap = room - take
        if gap:
            out[i, 3] |= 0x20
            out[i, 4] = gap - 1
            if gap > 1:
                out[i, 5] = 0x40 if flag else 0
        out[i, PACKET - take :] = data[at : at + take]
        at += take
    return out.tobytes(), (cc + n) & 15


MEDIA = {
    "packets": T.LongType(),
    "programs": T.LongType(),
    "streams": T.LongType(),
    "lost_packets": T.LongType(),
    "repeated_packets": T.LongType(),
    "bad_tables": T.LongType(),
    "broken_bytes": T.LongType(),
    "unnamed_packets": T.LongType(),
    "unreadable_packets": T.LongType(),
    "pes": T.ArrayType(
        T.StructType(
            [
                T.StructField("pid", T.IntegerType()),
                T.StructField("pts", T.LongType()),
                T.StructField("dts", T.LongType()),
                T.StructField("random_access", T.BooleanType()),
                T.StructField("damaged", T.BooleanType()),
                T.StructField("data", T.BinaryType()),
            ]
        )
    ),
}


def media_columns(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add the columns of ``MEDIA`` read from a binary column."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [None if m is None else parse(m) for m in column(batch, media).to_pylist()]
        get = lambda f: [None if s is None else f(s) for s in found]
        return {
            "packets": get(lambda s: s.packets),
            "programs": get(lambda s: len(s.programs)),
            "streams": get(lambda s: len(s.streams)),
            "lost_packets": get(lambda s: s.lost),
            "repeated_packets": get(lambda s: s.repeated),
            "bad_tables": get(lambda s: s.bad_tables),
            "broken_bytes": get(lambda s: s.broken),
            "unnamed_packets": get(lambda s: s.unnamed),
            "unreadable_packets": get(lambda s: s.unreadable),
            "pes": get(lambda s: [{"pid": p.pid, "pts": p.pts, "dts": p.dts, "random_access": p.random_access, "damaged": p.damaged, "data": p.data} for p in s.pes]),
        }

    return map_batches(df, run, MEDIA, keep=keep)


def store_texts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` and ``media``: each text's bytes, with zeros up to a positive multiple of 64, as a stream."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts(batch, text)]
        return {"n_bytes": [len(r) for r in raw], "media": [mux(padded(r)) for r in raw]}

    return map_batches(docs, run, {"n_bytes": T.LongType(), "media": T.BinaryType()}, keep=keep)


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def digests(stored: DataFrame) -> DataFrame:
    """Digests of the payload that the streams in ``media`` give back, and of the streams.

    ``stored`` has n_bytes, media and what else shall stay.  The feature names
    packets, time span in milliseconds, random-access points and faults.
    """
    new = {
        "payload_bytes": T.LongType(),
        "payload_sha256": T.StringType(),
        "tail_crc32": T.LongType(),
        "media_bytes": T.LongType(),
        "media_sha256": T.StringType(),
        "feature": T.StringType(),
    }

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in new}
        for m in column(batch, "media").to_pylist():
            s = parse(m)
            pid = min(s.streams)
            own = [p for p in s.pes if p.pid == pid]
            data = b"".join(p.data for p in own)
            span = (own[-1].pts - own[0].pts) * 1000 // _CLOCK
            out["payload_bytes"].append(len(data))
            out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
            out["tail_crc32"].append(zlib.crc32(data[-64:]))
            out["media_bytes"].append(len(m))
            out["media_sha256"].append(hashlib.sha256(m).hexdigest())
            points = sum(p.random_access for p in own)
            out["feature"].append(f"packets={s.packets};pes={len(own)};span_ms={span};points={points};lost={s.lost};broken={s.broken}")
        return out

    return map_batches(stored, run, new, keep=[c for c in stored.columns if c != "media"])
