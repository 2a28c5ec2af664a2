"""Media columns: payloads stored as MPEG transport streams, parsed back and described.

``pack`` writes a payload of 8-bit samples as one elementary stream: a program
association table, a program map table and packetised elementary packets (PES)
of up to 16 frames of 576 samples, each with a 33-bit time stamp; the first
packet of every PES carries a clock reference and the random-access flag.
``unpack`` trusts only the bytes: it finds the program map through the
association table (checking both tables' CRCs), the elementary stream through
the map, checks continuity counters, joins packets and reads time stamps.

Defined cases: null and empty texts give one frame of bytes 255; equal texts give
equal bytes; repeated rows are stored each; extra columns stay, those named like an
added one as input_NAME. A packet that is sent twice in a row, as the standard allows,
counts once, and packets without payload are passed over; a stream whose counters
skip otherwise reports the skips as gaps. Long payloads are packed in one pass of array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, renames, slices, texts_of

PACKET, FRAME, FRAMES = 188, 576, 16
#: 90 kHz ticks of one frame at 48,000 samples a second.
TICKS = FRAME * 90_000 // 48_000
PMT_PID, MEDIA_PID, PROGRAM, PRIVATE = 0x1000, 0x0101, 1, 0x06


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, no reflection, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _table(pid: int, table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", crc32_mpeg(section))
    return (struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


TABLES = _table(0, 0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)) + _table(
    PMT_PID, 2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE, 0xE000 | MEDIA_PID, 0xF000)
)


def payload_of(text: str) -> bytes:
    """UTF-8 bytes of a text, padded with 255 to a positive multiple of a frame."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pack(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for at in range(0, len(payload), FRAME * FRAMES):
        data = payload[at : at + FRAME * FRAMES]
        pts = at // FRAME * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + struct.pack(">HBBB", len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data
        # First packet: adaptation field of 8 bytes with random access and clock, then 176 bytes.
        field = bytes([7, 0x50]) + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        first, rest = pes[:176], pes[176:]
        n = 1 + -(-len(rest) // 184)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:] = np.frombuffer(field + first, np.uint8)
        full, tail = divmod(len(rest), 184)
        packets[1 : 1 + full, 4:] = np.frombuffer(rest[: full * 184], np.uint8).reshape(full, 184)
        if tail:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - tail
            if tail < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - tail :] = np.frombuffer(rest[full * 184 :], np.uint8)
        counter += n
        out.append(packets.tobytes())
    return b"".join(out)


class Stream(NamedTuple):
    payload: bytes
    stamps: list[int]
    random_access: list[int]
    gaps: int
    program: int
    pid: int


def _section(packets: np.ndarray, pids: np.ndarray, pid: int) -> bytes:
    """The first whole table section on a PID, which may go over several packets."""
    own = packets[(pids == pid) & (packets[:, 3] & 0x10 > 0)]
    begun = np.flatnonzero(own[:, 1] & 0x40 > 0)
    if not len(begun):
        raise ValueError(f"no table on PID {pid}")
    held = b""
    for k in range(begun[0], len(own)):
        raw = own[k].tobytes()
        data = raw[5 + raw[4] if raw[3] & 0x20 else 4 :]
        if k == begun[0]:
            data = data[1 + data[0] :]
        elif raw[1] & 0x40:
            data = data[1 : 1 + data[0]]
        held += data
        size = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) >= 3 else PACKET
        if len(held) >= size:
            return held[:size]
        if k > begun[0] and raw[1] & 0x40:
            break
    raise ValueError(f"table on PID {pid} is cut")


_tables: dict[tuple[bytes, int], tuple[int, int]] = {}


def _entry(section: bytes, pid: int, skip: int, what: str) -> tuple[int, int]:
    """The first entry of a table from a place on: (number or type, PID). Sections that were read before are known by all their bytes."""
    if (found := _tables.get((section, pid))) is None:
        if crc32_mpeg(section):
            raise ValueError(f"table on PID {pid} is damaged")
        at, end = skip, len(section) - 4
        if what == "program":  # number 0 is the network's
            while at + 4 <= end and section[at : at + 2] == b"\0\0":
                at += 4
            if at + 4 > end:
                raise ValueError("no program")
            found = struct.unpack(">HH", section[at : at + 4])
        else:
            at += struct.unpack(">H", section[10:12])[0] & 0x0FFF
            if at + 5 > end:
                raise ValueError("a program without streams")
            found = section[at], struct.unpack(">H", section[at + 1 : at + 3])[0]
        if len(_tables) >= 64:
            _tables.clear()
        found = _tables[section, pid] = found[0], found[1] & 0x1FFF
    return found


def _program(packets: np.ndarray) -> tuple[int, int]:
    """(program number, PID of its first elementary stream) of the first program, through both tables."""
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    number, map_pid = _entry(_section(packets, pids, 0), 0, 8, "program")
    return number, _entry(_section(packets, pids, map_pid), map_pid, 12, "stream")[1]


def unpack(media: bytes) -> Stream:
    """What the first elementary stream of a transport stream's first program holds; a stamp for each PES packet that has one."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    program, pid = _program(packets)
    own = packets[((packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]) == pid]
    own = own[own[:, 3] & 0x10 > 0]
    again = np.zeros(len(own), bool)
    # A copy may differ in its clock reference alone, which stands in bytes 6 to 11 of a packet that has one.
    clock = (own[:, 3] & 0x20 > 0) & (own[:, 4] >= 7) & (own[:, 5] & 0x10 > 0)
    alike = own[1:] == own[:-1]
    alike[:, 6:12] |= clock[1:, None]
    again[1:] = alike.all(1)
    own = own[~again]
    counters = own[:, 3] & 15
    gaps = int((np.diff(counters.astype(np.int64)) % 16 != 1).sum())
    adapted = own[:, 3] & 0x20 > 0
    skip = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    body = own[np.arange(PACKET) >= skip[:, None]]
    ends = np.cumsum(PACKET - skip)
    begun = np.flatnonzero(own[:, 1] & 0x40 > 0)
    data, stamps, access = [], [], []
    for i, k in enumerate(begun.tolist()):
        a = int(ends[k] - (PACKET - skip[k]))
        b = int(ends[begun[i + 1] - 1]) if i + 1 < len(begun) else len(body)
        pes = body[a:b].tobytes()
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("not a PES packet")
        length = struct.unpack(">H", pes[4:6])[0]
        if pes[7] & 0x80:
            p = pes[9:14]
            stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        if flags[k] & 0x40:
            access.append(k)
        # A length of 0 means up to the next packet's start.
        data.append(pes[9 + pes[8] : 6 + length if length else len(pes)])
    return Stream(b"".join(data), stamps, access, gaps, program, pid)


def feature(s: Stream) -> str:
    """Stream facts and whole-number sample statistics, from what was read back."""
    x = np.frombuffer(s.payload, np.uint8).astype(np.int64)
    turns = int((np.diff(x) != 0).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"program={s.program};pid={s.pid};pes={len(s.stamps)};first={s.stamps[0]};last={s.stamps[-1]};rap={len(s.random_access)};gaps={s.gaps};sum={int(x.sum())};energy={int((x * x).sum())};changes={turns};crossings={crossings}"


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(df: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """Adds the columns of MEDIA, and with keep_media the stream itself, to a table; the text goes."""
    added = T._parse_datatype_string(MEDIA + (", media binary, time_stamps array<long>, random_access array<long>" if keep_media else ""))
    clash = renames(df.columns, added.names)
    df, text = apart(df, added.names), clash.get(text, text)
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in kept], *added])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for t in texts_of(batch, text):
                media = pack(payload_of(t))
                s = unpack(media)
                row = (len(t.encode()), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s))
                rows.append((*row, media, s.stamps, s.random_access) if keep_media else row)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *cols], names=[*kept, *added.names])

    return df.select(*kept, text).mapInArrow(run, schema)
