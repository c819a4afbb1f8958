"""Media columns: payloads in MPEG-2 transport streams, and back.

``mux`` stores 8-bit samples as private-data access units of ``UNIT`` bytes: each
is one PES packet with a 33-bit presentation time in 90 kHz ticks (samples count
as 8 kHz), spread over 188-byte packets. A PAT and a PMT come first and again at
each random-access point, which is every ``RAP_EVERY``-th unit and flagged in the
adaptation field. ``demux`` parses program tables, checks CRCs and continuity
counters, reassembles PES packets and returns payload, times and random-access
points; a break raises.

Defined results: null or empty text is a payload of 64 zero bytes; equal texts have
equal media; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
UNIT, RAP_EVERY = 4096, 8
TICKS, RATE = 90_000, 8_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _time(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, 1 | ticks >> 14 & 0xFE, ticks >> 7 & 255, 1 | ticks << 1 & 0xFE])


def _pcr(ticks: int) -> bytes:
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    out, tables, counter = [], 0, 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        ticks = at * TICKS // RATE & (1 << 33) - 1
        rap = unit % RAP_EVERY == 0
        if rap:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        body = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(ticks) + body
        # first packet: adaptation field with the flag and, at a random-access point, the clock
        field_ = bytes([0x50]) + _pcr(ticks) if rap else bytes([0x00])
        size = min(len(pes), PACKET - 5 - len(field_))
        stuffing = PACKET - 5 - len(field_) - size
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15, len(field_) + stuffing]) + field_ + b"\xff" * stuffing + pes[:size])
        counter += 1
        rest = pes[size:]
        full = len(rest) // 184
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, :3] = (SYNC, ES_PID >> 8, ES_PID & 255)
            packets[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * 184).reshape(full, 184)
            out.append(packets.tobytes())
            counter += full
        if left := rest[full * 184 :]:
            pad = 183 - len(left)
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15, pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad else b"") + left)
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    times: list[int] = field(default_factory=list)
    #: (packet number, presentation time) of each random-access point
    access: list[tuple[int, int]] = field(default_factory=list)


def _checked(section: bytes, table: int) -> bytes:
    size = int.from_bytes(section[1:3], "big") & 0xFFF
    whole = section[: size + 3]
    if section[0] != table or crc32_mpeg(whole):
        raise ValueError(f"table {table} is damaged")
    return whole[8:-4]


def _programs(pids: np.ndarray, packets: np.ndarray) -> int:
    """The elementary stream's PID, from every copy of the program tables."""
    bodies = {}
    for pid, table in ((PAT_PID, 0), (None, 2)):
        if pid is None:
            pid = int.from_bytes(bodies[0][2:4], "big") & NULL_PID
        copies = {bytes(p[5:]) for p in packets[pids == pid]}
        if len(copies) != 1:
            raise ValueError("program tables are missing or differ")
        bodies[table] = _checked(copies.pop(), table)
    return int.from_bytes(bodies[2][5:7], "big") & NULL_PID


def demux(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        raise ValueError("a transport stream is a positive number of 188-byte packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    for pid in np.unique(pids):
        counters = packets[pids == pid, 3] & 15
        if ((counters[1:].astype(np.int16) - counters[:-1]) % 16 != 1).any():
            raise ValueError(f"continuity of PID {pid} is broken")
    mine = np.flatnonzero(pids == _programs(pids, packets))
    own = packets[mine]
    has_field = own[:, 3] & 0x20 > 0
    begin = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    bodies = np.arange(PACKET) >= begin[:, None]
    data, sizes = own[bodies].tobytes(), PACKET - begin
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out, parts = Stream(packets=len(packets)), []
    for k, s in enumerate(starts):
        a, b = int(edges[s]), int(edges[starts[k + 1]] if k + 1 < len(starts) else edges[-1])
        pes = data[a:b]
        if pes[:4] != b"\x00\x00\x01\xbd" or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            raise ValueError("an elementary packet is damaged")
        t = pes[9:14]
        ticks = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        out.times.append(ticks)
        if has_field[s] and own[s, 4] and own[s, 5] & 0x40:
            out.access.append((int(mine[s]), ticks))
        parts.append(pes[9 + pes[8] :])
    out.payload = b"".join(parts)
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each row's text as UTF-8, zero-padded to a positive multiple of 64, in a transport stream."""

    def write(batches):
        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            for i, j in tk.slices(off, 1 << 22):
                raw = [data[off[r] : off[r + 1]].tobytes() for r in range(i, j)]
                media = [mux(t.ljust(max(64, -len(t) // 64 * -64), b"\0")) for t in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """FEATURES of each stored stream (doc_id, n_bytes, media), from its own bytes."""

    def read(batches):
        names = [f.split()[0] for f in FEATURES.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
        for batch in batches:
            data, off = tk.utf8(batch.column(2))
            for i, j in tk.slices(off, 1 << 22):
                rows = []
                for r in range(i, j):
                    m = data[off[r] : off[r + 1]].tobytes()
                    s = demux(m)
                    x = np.frombuffer(s.payload, np.uint8)
                    feature = f"packets={s.packets};units={len(s.times)};access={len(s.access)};last_pts={s.times[-1]};mean={x.mean():.6f};peak={int(x.max())}"
                    rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *cols], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def op5_media_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(storage.materialize(spark, store(storage.read_table(spark, sf_dir, "documents")), "media"))
