"""Media columns as MPEG transport streams.

``mux`` stores a payload losslessly in an 188-byte-packet transport stream: a program association table, a
program map table, and one private data stream whose access units (``UNIT`` payload bytes each) travel in
packetised elementary stream (PES) packets with a presentation timestamp. The first packet of an access unit
carries a program clock reference and the random-access flag. ``demux`` parses any such stream: program tables
(with their CRC), continuity counters, reassembled elementary streams, timestamps and random-access points.

Payloads are 8-bit units, so nothing is converted. Memory is a few times one payload. Empty payloads give a
stream with tables only; null texts count as empty; equal texts have equal streams. An empty table gives an empty
result, repeated rows are stored alike, and other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

PACKET, UNIT, PAD = 188, 576 * 32, 576
PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
#: 90 kHz ticks between access units.
TICKS = 3600


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 (polynomial 04C11DB7, not reflected)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1 & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def _unit(data: np.ndarray, pts: int, counter: int) -> np.ndarray:
    """The packets of one access unit."""
    size = len(data) + 8
    header = b"\x00\x00\x01\xbd" + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(pts)
    pes = np.concatenate([np.frombuffer(header, np.uint8), data])
    room = PACKET - 12  # the first packet has a clock reference and the random-access flag
    rest = max(0, len(pes) - room)
    n = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    first = min(room, len(pes))
    out[0, 4], out[0, 5] = 7 + room - first, 0x50
    base = pts & (1 << 33) - 1
    out[0, 6:12] = np.frombuffer(((base << 15 | 0x3F << 9)).to_bytes(6, "big"), np.uint8)
    out[0, PACKET - first :] = pes[:first]
    if n > 1:
        full = rest // (PACKET - 4)
        out[1 : 1 + full, 4:] = pes[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if tail := rest - full * (PACKET - 4):  # stuffing in an adaptation field
            out[-1, 3] |= 0x20
            gap = PACKET - 4 - tail
            out[-1, 4] = gap - 1
            if gap > 1:
                out[-1, 5] = 0
            out[-1, PACKET - tail :] = pes[len(pes) - tail :]
    return out


def mux(payload: bytes | np.ndarray) -> np.ndarray:
    """The transport stream of a payload, as bytes in an array."""
    data = np.frombuffer(payload, np.uint8) if isinstance(payload, (bytes, bytearray)) else payload
    parts, counter = [np.frombuffer(PAT + PMT, np.uint8).reshape(2, PACKET)], 0
    for k, at in enumerate(range(0, len(data), UNIT)):
        parts.append(_unit(data[at : at + UNIT], k * TICKS, counter))
        counter += len(parts[-1])
    return np.concatenate(parts).reshape(-1)


@dataclass
class Stream:
    """What ``demux`` finds. ``faults`` counts packets marked or found damaged, ``bad_crc`` sections that are cut short or whose CRC is wrong."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: dict[int, bytes] = field(default_factory=dict)
    pts: dict[int, list[int]] = field(default_factory=dict)
    random_access: dict[int, list[int]] = field(default_factory=dict)  # packet numbers
    discontinuities: int = 0
    bad_crc: int = 0
    lost_sync: int = 0
    faults: int = 0


def _sections(packets: np.ndarray, rows: np.ndarray, start: np.ndarray, out: Stream) -> Iterator[bytes]:
    """The sections of a table's packets, each of which may go over several, with their CRC checked."""
    open_ = b""

    def closed() -> Iterator[bytes]:
        nonlocal open_
        while len(open_) >= 3 and open_[0] != 255:
            size = 3 + ((open_[1] & 15) << 8 | open_[2])
            if len(open_) < size:
                return
            section, open_ = open_[:size], open_[size:]
            if size < 12 or crc32_mpeg(section):
                out.bad_crc += 1
            else:
                yield section
        if open_[:1] == b"\xff":  # stuffing
            open_ = b""

    for i in rows:
        body = packets[i, start[i] :].tobytes()
        if packets[i, 1] & 0x40:
            pointer = body[0] if body else 255
            if 1 + pointer > len(body):
                out.faults += 1
                open_ = b""
                continue
            if open_:
                open_ += body[1 : 1 + pointer]
                yield from closed()
            out.bad_crc += bool(open_)  # never finished
            open_ = body[1 + pointer :]
        elif open_:
            open_ += body
        yield from closed()
    out.bad_crc += bool(open_)


def demux(media: bytes | np.ndarray) -> Stream:
    """Parse any transport stream, damaged ones too.

    Packets without sync byte are counted and skipped, and so are those marked as errors and those whose adaptation field does
    not fit. A repeated continuity counter is a duplicate packet and dropped; any other jump is counted, unless the packet says that it is
    meant. Sections with a wrong CRC are counted and not read. What of an elementary stream cannot be parsed is left out and counted.
    """
    data = np.frombuffer(media, np.uint8) if isinstance(media, (bytes, bytearray)) else media
    packets = data[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    out = Stream(lost_sync=int((packets[:, 0] != 0x47).sum()) + (len(data) % PACKET > 0))
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    adapts, carries = packets[:, 3] & 0x20 > 0, packets[:, 3] & 0x10 > 0
    size = packets[:, 4].astype(np.int32)
    start = np.where(adapts, 5 + size, 4)
    ok = packets[:, 0] == 0x47
    damaged = ok & ((packets[:, 1] & 0x80 > 0) | adapts & (size > np.where(carries, PACKET - 6, PACKET - 5)))
    out.faults = int(damaged.sum())
    ok &= ~damaged
    meant = adapts & (size > 0) & (packets[:, 5] & 0x80 > 0)
    for section in _sections(packets, np.flatnonzero(ok & carries & (pid == 0)), start, out):
        for at in range(8, len(section) - 7, 4):
            if number := section[at] << 8 | section[at + 1]:
                out.programs[number] = (section[at + 2] & 31) << 8 | section[at + 3]
    for where in sorted({*out.programs.values()}):
        for section in _sections(packets, np.flatnonzero(ok & carries & (pid == where)), start, out):
            at, end = 12 + ((section[10] & 15) << 8 | section[11]), len(section) - 4
            while at + 5 <= end:
                out.streams[(section[at + 1] & 31) << 8 | section[at + 2]] = section[at]
                at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    for where in out.streams:
        rows = np.flatnonzero(ok & (pid == where) & carries)
        counters = packets[rows, 3] & 15
        step = (counters[1:].astype(np.int16) - counters[:-1]) & 15
        out.discontinuities += int(((step > 1) & ~meant[rows[1:]]).sum())
        rows = rows[np.concatenate([[True], (step != 0) | meant[rows[1:]]])] if len(rows) else rows
        out.random_access[where] = [int(i) for i in rows if adapts[i] and packets[i, 4] and packets[i, 5] & 0x40]
        begins = np.flatnonzero(packets[rows, 1] & 0x40)
        units, stamps = [], []
        for k, b in enumerate(begins):
            own = rows[b : begins[k + 1] if k + 1 < len(begins) else len(rows)]
            plain = start[own] == 4
            pes = packets[own][:, 4:].reshape(-1) if plain.all() else np.concatenate([packets[i, start[i] :] for i in own[:1]] + ([packets[own[1:-1]][:, 4:].reshape(-1)] if plain[1:-1].all() else [packets[i, start[i] :] for i in own[1:-1]]) + [packets[i, start[i] :] for i in own[1:][-1:]])
            head = pes[:14].tobytes()
            if head[:3] != b"\x00\x00\x01" or len(head) < 9 or len(pes) < 9 + head[8] or head[7] & 0x80 and len(head) < 14:
                out.discontinuities += 1
                continue
            if head[7] & 0x80:
                stamps.append((head[9] >> 1 & 7) << 30 | head[10] << 22 | head[11] >> 1 << 15 | head[12] << 7 | head[13] >> 1)
            size_ = head[4] << 8 | head[5]
            if size_ and len(pes) < 6 + size_:  # cut short
                out.faults += 1
            units.append(pes[9 + head[8] : 6 + size_ if size_ else None].tobytes())
        out.payload[where], out.pts[where] = b"".join(units), stamps
    return out


STORED = "struct<n_bytes:bigint,media:binary>"
FACTS = "struct<payload:binary,feature:string>"


def _store(texts: pa.Array) -> pa.Array:
    """Pad each text's bytes and store them as a transport stream."""
    sizes, media = [], []
    for text in texts:
        data = text.as_py().encode() if text.is_valid else b""
        sizes.append(len(data))
        padded = data.ljust(max(1, -(-len(data) // PAD)) * PAD, b"\xff")
        media.append(mux(padded).tobytes())
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["n_bytes", "media"])


def _read(media: pa.Array) -> pa.Array:
    """Parse stored streams: the payload read back, and a summary of tables, timestamps and access points."""
    payloads, features = [], []
    for stored in media:
        s = demux(stored.as_py() or b"")
        payloads.append(s.payload.get(DATA_PID, b""))
        stamps, points = s.pts.get(DATA_PID, []), s.random_access.get(DATA_PID, [])
        marks = zlib.crc32(b"".join(x.to_bytes(8, "big") for pair in zip(stamps, points) for x in pair))
        features.append(
            f"programs={len(s.programs)};streams={','.join(f'{p}:{t}' for p, t in sorted(s.streams.items()))};units={len(stamps)};pts={stamps[0] if stamps else ''}-{stamps[-1] if stamps else ''}"
            f";access_points={len(points)};index={marks:08x};discontinuities={s.discontinuities};bad_crc={s.bad_crc};lost_sync={s.lost_sync};faults={s.faults}"
        )
    return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(features, pa.string())], ["payload", "feature"])


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with struct columns ``stored`` (n_bytes, media) and ``facts`` (payload, feature).

    Columns of these names are an error, so that none is lost."""
    free(docs, "stored", "facts")
    store, read = F.arrow_udf(_store, STORED), F.arrow_udf(_read, FACTS)
    return docs.withColumn("stored", store(F.col(text))).withColumn("facts", read(F.col("stored.media")))


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a transport stream and read back; digests of both forms."""
    docs = text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    payload, media = F.col("facts.payload"), F.col("stored.media")
    return docs.select(
        "doc_id",
        F.col("stored.n_bytes").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"),
        F.col("facts.feature").alias("feature"),
    )
