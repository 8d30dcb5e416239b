"""Media columns as MPEG transport streams.

A stream has packets of 188 bytes: program tables (association and map, each with its CRC) before every random-access point, then the
packets of one elementary stream. An access unit is one elementary packet with a timestamp; its first transport packet carries the clock
reference and, at a random-access point, the indicator for it. The reader parses the program tables, checks their CRCs and the continuity
counters, puts elementary packets together again, and keeps their timestamps with the random-access points.

The payload of a row is its text as UTF-8, with bytes 32 appended up to a positive multiple of 192; null texts count as empty, so every row
has a stream. Equal texts give equal streams. Further columns are left out; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.shared import map_batches, table, written

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
TABLE_POLYNOMIAL = 0x04C11DB7
PRIVATE_DATA_TYPE, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000

# Choices of this writer.
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x100, 1
UNIT = 192 * 16
UNITS_A_RANDOM_ACCESS = 4
UNIT_TICKS = CLOCK // 25
FIRST_TICK = CLOCK
ALIGN = 192


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ TABLE_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


@lru_cache(1024)
def table_crc(section: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % ALIGN if raw else ALIGN)


def _new_section(table_id: int, number: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + table_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter])
    return (head + b"\0" + section).ljust(PACKET, b"\xff")


@lru_cache(32)
def _tables(counter: int) -> bytes:
    pat = _new_section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _new_section(0x02, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return _table_packet(PAT_PID, counter, pat) + _table_packet(PMT_PID, counter, pmt)


def _timestamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | (t >> 30) << 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def to_stream(payload: bytes) -> bytes:
    """A transport stream of the payload's access units."""
    out, counter, tables = [], 0, 0
    first_media, media = bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 0xFF]), bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF])
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, ticks, access = payload[at : at + UNIT], FIRST_TICK + k * UNIT_TICKS, k % UNITS_A_RANDOM_ACCESS == 0
        if access:
            out.append(_tables(tables & 15))
            tables += 1
        pes = bytes([0, 0, 1, PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(ticks) + unit
        clock = bytes([0x50 if access else 0x10]) + ((ticks & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")
        n, pos = len(pes), 0
        while pos < n:
            field_bytes = clock if pos == 0 else b""
            room = PACKET - 4 - (len(field_bytes) + 1 if field_bytes else 0)
            if n - pos < room:  # the rest is stuffing in the adaptation field
                lack = room - (n - pos)
                if field_bytes:
                    field_bytes += b"\xff" * lack
                else:
                    field_bytes = b"\0" + b"\xff" * (lack - 2) if lack > 1 else b""
                take, has_field = n - pos, True
            else:
                take, has_field = room, bool(field_bytes)
            out.append(first_media if pos == 0 else media)
            if has_field:
                out.append(bytes([0x30 | counter, len(field_bytes)]) + field_bytes)
            else:
                out.append(bytes([0x10 | counter]))
            out.append(pes[pos : pos + take])
            counter = counter + 1 & 15
            pos += take
    return b"".join(out)


@dataclass
class Stream:
    """What the reader found."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    bad_tables: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    lost_sync: int = 0
    damaged_packets: int = 0
    bad_units: int = 0
    units: list[tuple[int | None, bool, bytes, bool]] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(u[2] for u in self.units)


def _section(section: bytes, found: Stream) -> bytes | None:
    """A complete section with a right CRC; otherwise it is counted as bad."""
    if len(section) < 12 or table_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
        found.bad_tables += 1
        return None
    return section


def _sections_of(body: bytes, start: bool, pid: int, open_sections: dict[int, bytes], found: Stream) -> bytes | None:
    """Gather a section, which may be longer than a packet; gives it when it is complete."""
    if start:
        if open_sections.pop(pid, None) is not None:
            found.bad_tables += 1
        open_sections[pid] = body[1 + body[0] :]
    elif pid in open_sections:
        open_sections[pid] += body
    held = open_sections.get(pid)
    if held is None or len(held) < 3 or len(held) < (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
        return None
    del open_sections[pid]
    return _section(held[:size], found)


def _unit(found: Stream, parts: list[bytes], access: bool) -> None:
    """An elementary packet as a unit: timestamp, random access, bytes, and whether all of it arrived."""
    pes = b"".join(parts)
    if len(pes) < 9 or pes[:3] != b"\0\0\1":
        found.bad_units += 1
        return
    size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
    has_time = pes[7] & 0x80 and pes[8] >= 5 and len(pes) >= 14
    end = 6 + size if size else len(pes)
    whole = len(pes) >= max(end, skip)
    found.bad_units += not whole
    found.units.append((_ticks(pes[9:14]) if has_time else None, access, pes[skip:end], whole))


def _next_sync(data: bytes, at: int) -> int:
    """The next place where packets begin: a sync byte with another one a packet later, or with less than a packet after it."""
    n = len(data)
    while (at := data.find(bytes([SYNC]), at)) >= 0:
        if at + PACKET >= n or data[at + PACKET] == SYNC:
            return at
        at += 1
    return n


def parse_stream(data: bytes) -> Stream:
    """Parse a transport stream; never raises on damaged streams, but counts what is wrong: lost sync, packets with the error bit (left out), jumps
    of continuity counters where no discontinuity is announced, sections that are cut or have a wrong CRC, units that are no elementary packets or
    of which a part is missing (the latter are kept, but not marked whole)."""
    found, last, at, n = Stream(), {}, 0, len(data)
    open_parts: dict[int, list] = {}
    opened_access: dict[int, bool] = {}
    open_sections: dict[int, bytes] = {}
    while at + PACKET <= n:
        if data[at] != SYNC:
            found.lost_sync += 1
            at = _next_sync(data, at + 1)
            continue
        b1, b3 = data[at + 1], data[at + 3]
        pid, start, kind, counter = (b1 & 0x1F) << 8 | data[at + 2], bool(b1 & 0x40), b3 >> 4 & 3, b3 & 15
        found.packets += 1
        if b1 & 0x80:
            found.damaged_packets += 1
            at += PACKET
            continue
        pos, access = at + 4, False
        if kind & 2:
            size = data[pos]
            access = bool(size and data[pos + 1] & 0x40)
            if size and data[pos + 1] & 0x80:
                last.pop(pid, None)
            pos += 1 + size
        body = data[pos : at + PACKET] if kind & 1 else b""
        at += PACKET
        if kind & 1:
            if pid in last:
                if counter == last[pid]:
                    found.duplicates += 1
                    continue
                found.discontinuities += counter != (last[pid] + 1 & 15)
            last[pid] = counter
        if not body:
            continue
        if pid == PAT_PID:
            if s := _sections_of(body, start, pid, open_sections, found):
                found.programs.update((int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF, int.from_bytes(s[i : i + 2], "big")) for i in range(8, len(s) - 4, 4))
        elif pid in found.programs:
            if s := _sections_of(body, start, pid, open_sections, found):
                i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
                while i < len(s) - 4:
                    found.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
        elif pid in found.streams:
            if start:
                if pid in open_parts:
                    _unit(found, open_parts[pid], opened_access[pid])
                open_parts[pid], opened_access[pid] = [body], access
            elif pid in open_parts:
                open_parts[pid].append(body)
    for pid, parts in open_parts.items():
        _unit(found, parts, opened_access[pid])
    found.bad_tables += len(open_sections)
    return found


def store_media(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes of the text, and its transport stream as ``media``."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "n_bytes": [len((t or "").encode()) for t in texts], "media": [to_stream(payload_of(t)) for t in texts]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, n_bytes long, media binary", "text")


POINTS = "random_access_points array<struct<ticks:long,at:long>>, first_ticks long, last_ticks long"
MEDIA_FACTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string,"
    f" packets long, discontinuities int, bad_tables int, {POINTS}"
)


def read_media(media: DataFrame) -> DataFrame:
    """Per row of ``store_media``: what the parsed stream holds, with timestamps and random-access points (byte places in the payload)."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in MEDIA_FACTS.split(", ")}
        for doc_id, n_bytes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = parse_stream(data)
            payload, at, points = s.payload, 0, []
            for ticks, access, unit, _ in s.units:
                if access:
                    points.append({"ticks": ticks, "at": at})
                at += len(unit)
            times = [u[0] for u in s.units if u[0] is not None] or [None]
            row = {
                "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
                "feature": f"packets={s.packets};units={len(s.units)};random_access={len(points)};ticks={times[0]}-{times[-1]};types={','.join(map(str, sorted(s.streams.values())))};longest={max((len(u[2]) for u in s.units), default=0)};whole={sum(u[3] for u in s.units)}",
                "packets": s.packets, "discontinuities": s.discontinuities, "bad_tables": s.bad_tables, "random_access_points": points, "first_ticks": times[0], "last_ticks": times[-1],
            }
            for k, v in row.items():
                out[k].append(v)
        return out

    return map_batches(media.select("doc_id", "n_bytes", "media"), work, MEDIA_FACTS, "media")


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a transport stream and read it back."""
    return read_media(written(store_media(table(spark, sf_dir, "documents")), "media"))
