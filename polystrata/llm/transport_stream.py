"""MPEG transport streams in binary columns: bytes are packetised, and streams are parsed back with their timing.

A payload is cut into access units; each is one PES packet with a presentation
time stamp, carried by 188-byte packets of one private-data stream. A program
association table and a program map table, each with its CRC, go before every
random-access unit; that unit's first packet has the random-access flag and a
clock reference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

PACKET, UNIT = 188, 576
PMT_PID, DATA_PID, STREAM_TYPE, PROGRAM = 0x100, 0x101, 0x06, 1
#: Bytes of an access unit, 90 kHz ticks between units, units between random-access points.
UNIT_BYTES, TICKS, GROUP = 32 * UNIT, 3600, 8

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else _c << 1
    _CRC[_i] = _c


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ b])
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([0x47, 0x40 | (pid >> 8), pid & 255, 0x10 | (counter & 15), 0]) + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([(mark << 4) | ((t >> 29) & 14) | 1, (t >> 22) & 255, ((t >> 14) & 254) | 1, (t >> 7) & 255, ((t << 1) & 254) | 1])


def _clock(t: int) -> bytes:
    return ((t & ((1 << 33) - 1)) << 15 | 0x7E00).to_bytes(6, "big")


def _packets(pid: int, pes: bytes, counter: int, clock: int | None) -> bytes:
    """One PES packet in transport packets; `clock` makes the first a random-access point. Stuffing goes into the first and last adaptation fields."""
    first_field = b"" if clock is None else bytes([7, 0x50]) + _clock(clock)
    first = PACKET - 4 - len(first_field)
    if len(pes) < first:
        room = PACKET - 4 - len(pes)
        if first_field:
            first_field = bytes([room - 1]) + first_field[1:] + b"\xff" * (room - len(first_field))
        else:
            first_field = b"\x00" if room == 1 else bytes([room - 1, 0]) + b"\xff" * (room - 2)
        first = len(pes)
    out = [bytes([0x47, 0x40 | (pid >> 8), pid & 255, (0x30 if first_field else 0x10) | (counter & 15)]) + first_field + pes[:first]]
    rest = pes[first:]
    full = len(rest) // 184
    if full:
        block = np.empty((full, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = 0x47, pid >> 8, pid & 255
        block[:, 3] = 0x10 | ((counter + 1 + np.arange(full)) & 15)
        block[:, 4:] = np.frombuffer(rest, np.uint8, full * 184).reshape(full, 184)
        out.append(block.tobytes())
    tail = rest[full * 184 :]
    if tail:
        room = 184 - len(tail)
        field_ = b"\x00" if room == 1 else bytes([room - 1, 0]) + b"\xff" * (room - 2)
        out.append(bytes([0x47, pid >> 8, pid & 255, 0x30 | ((counter + 1 + full) & 15)]) + field_ + tail)
    return b"".join(out)


def write_stream(payload: bytes) -> bytes:
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, t = payload[at : at + UNIT_BYTES], 90_000 + unit * TICKS
        clock = None
        if unit % GROUP == 0:
            out += [_table_packet(0, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables, clock = tables + 1, t - TICKS
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + data
        made = _packets(DATA_PID, pes, counter, clock)
        counter += len(made) // PACKET
        out.append(made)
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. Damage is counted, never raised."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int | None, bool, bytes]] = field(default_factory=list)
    packets: int = 0
    lost_sync: int = 0
    discontinuities: int = 0
    bad_sections: int = 0
    clocks: list[int] = field(default_factory=list)

    def payload(self) -> bytes:
        return b"".join(u[3] for u in self.units)


def _read_section(s: Stream, pid: int, data: bytes) -> None:
    at = 1 + data[0] if data else 0
    if len(data) < at + 3:
        s.bad_sections += 1
        return
    size = 3 + ((data[at + 1] & 15) << 8 | data[at + 2])
    section = data[at : at + size]
    if size < 12 or len(section) < size or crc32_mpeg(section):
        s.bad_sections += 1
        return
    if pid == 0 and section[0] == 0:
        for i in range(8, size - 4, 4):
            number = int.from_bytes(section[i : i + 2], "big")
            if number:
                s.programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
    elif section[0] == 2:
        i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while i + 5 <= size - 4:
            s.streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
            i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)


def _close(s: Stream, pid: int, parts: list[bytes], random: bool) -> None:
    pes = b"".join(parts)
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
        return
    t = None
    if pes[7] & 0x80 and len(pes) >= 14:
        t = ((pes[9] >> 1) & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1
    size = int.from_bytes(pes[4:6], "big")
    s.units.append((pid, t, random, pes[9 + pes[8] : 6 + size if size else len(pes)]))


def read_stream(data: bytes) -> Stream:
    """Parse program tables, check continuity counters, reassemble PES packets; packets without sync byte are counted and skipped."""
    s, open_, counters = Stream(), {}, {}
    whole = len(data) // PACKET
    heads = np.frombuffer(data, np.uint8, whole * PACKET).reshape(whole, PACKET)[:, :4] if whole else np.empty((0, 4), np.uint8)
    s.packets = whole
    s.lost_sync = int((heads[:, 0] != 0x47).sum()) + (len(data) % PACKET > 0)
    pids = ((heads[:, 1].astype(int) & 0x1F) << 8 | heads[:, 2]).tolist()
    sync, starts, flags = (heads[:, 0] == 0x47).tolist(), (heads[:, 1] & 0x40).tolist(), heads[:, 3].tolist()
    for n in range(whole):
        if not sync[n]:
            continue
        pid, flag, at = pids[n], flags[n], n * PACKET + 4
        end, random = at + 184, False
        if flag & 0x20:
            size = data[at]
            if size:
                random = bool(data[at + 1] & 0x40)
                if data[at + 1] & 0x10 and size >= 7:
                    s.clocks.append(int.from_bytes(data[at + 2 : at + 8], "big") >> 15)
            at += 1 + size
        if not flag & 0x10:
            continue
        if pid in counters and (counters[pid] + 1) & 15 != flag & 15:
            s.discontinuities += 1
        counters[pid] = flag & 15
        if pid == 0 or pid in s.programs.values():
            if starts[n]:
                _read_section(s, pid, data[at:end])
        elif pid in s.streams:
            if starts[n]:
                if pid in open_:
                    _close(s, pid, *open_[pid])
                open_[pid] = ([data[at:end]], random)
            elif pid in open_:
                open_[pid][0].append(data[at:end])
    for pid, (parts, random) in open_.items():
        _close(s, pid, parts, random)
    return s


def pad(text: object) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def feature(s: Stream) -> str:
    """Program tables, units, damage, times and random-access points (unit:time) in one line."""
    access = [(i, u[1]) for i, u in enumerate(s.units) if u[2]]
    points = hashlib.sha256(",".join(f"{i}:{t}" for i, t in access).encode()).hexdigest()[:16]
    times = [u[1] for u in s.units if u[1] is not None]
    programs = ",".join(f"{a}>{b:x}" for a, b in sorted(s.programs.items()))
    streams = ",".join(f"{a:x}={b:x}" for a, b in sorted(s.streams.items()))
    return f"programs={programs};streams={streams};packets={s.packets};units={len(s.units)};lost={s.lost_sync};gaps={s.discontinuities};crc={s.bad_sections};pts={min(times, default=-1)}-{max(times, default=-1)};access={len(access)}:{points}"


def store_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, stream binary: the padded UTF-8 bytes as a transport stream.

    Null and empty texts are a payload of 576 bytes 255. One row out for each
    row in; ids may repeat or be null; other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                made = [pad(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [n for _, n in made], "stream": [write_stream(p) for p, _ in made]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_bytes long, stream binary")


def read_media(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, stream) -> sizes, digests, features and the access points (unit, time) of each stream."""
    ship(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, n, data in zip(pdf["doc_id"], pdf["n_bytes"], pdf["stream"]):
                s = read_stream(data)
                p = s.payload()
                points = [{"unit": i, "pts": u[1]} for i, u in enumerate(s.units) if u[2]]
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), points))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points"])

    return media.mapInPandas(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_points array<struct<unit:long,pts:long>>"
    )
