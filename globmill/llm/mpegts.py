"""Media columns: MPEG transport streams.

write_stream() puts a payload into elementary packets (PES, private stream 1) of one program: a program association
and a program map table come first, each elementary packet has a time stamp and starts with a random-access point and
a clock reference, and all transport packets have 188 bytes with a continuity counter by PID. read_stream() parses any
such stream: it follows the tables to the programs' elementary streams, checks the counters (repeated packets are left
out, gaps are reported), puts elementary packets together and lists time stamps and random-access points.

Defined results: the payload of a null text is that of an empty one; repeated rows have a stream each; an empty table
gives an empty result; extra columns stay as they are, but one with the name of the media column gives way. A stream that is
cut, has lost packets or a wrong table check sum is read as far as it goes, and its faults are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

# Fixed values of the format: packet size, sync byte, PIDs and stream types used here.
PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0, 0x1000, 0x0100, 0xBD, 0x06
#: Payload bytes of one elementary packet (its length field has 16 bits) and the 90 kHz ticks between two of them.
PES_BYTES, TICKS = 64_000, 3_600


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        out = np.where(out & np.uint32(0x80000000), (out << np.uint32(1)) ^ np.uint32(0x04C11DB7), out << np.uint32(1))
    return out


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    """The check sum of table sections (polynomial 04C11DB7, highest bit first)."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, key >> 8, key & 255, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
)


def _stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 255, (t >> 14) & 255 | 1, (t >> 7) & 255, (t << 1) & 255 | 1])


def write_stream(payload: bytes, pes_bytes: int = PES_BYTES, ticks: int = TICKS) -> bytes:
    """A transport stream of one program with one private elementary stream."""
    out, counter = [_TABLES], 0
    for k in range(0, max(1, len(payload)), pes_bytes):
        part, t = payload[k : k + pes_bytes], (k // pes_bytes) * ticks & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(t) + part
        # first packet: adaptation field of 8 bytes with the random-access mark and the clock reference
        first = 176 if len(pes) >= 176 else len(pes)
        clock = bytes([t >> 25, (t >> 17) & 255, (t >> 9) & 255, (t >> 1) & 255, (t & 1) << 7 | 0x7E, 0])
        head = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, 183 - first, 0x50]) + clock
        out.append(head.ljust(PACKET - first, b"\xff") + pes[:first])
        rest, last = divmod(len(pes) - first, 184)
        if rest:
            body = np.empty((rest, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            body[:, 3] = 0x10 | (counter + 1 + np.arange(rest)) & 15
            body[:, 4:] = np.frombuffer(pes, np.uint8, rest * 184, first).reshape(rest, 184)
            out.append(body.tobytes())
        counter += 1 + rest
        if last:
            head = bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, 183 - last]) + (b"\0" if last < 183 else b"")
            out.append(head.ljust(PACKET - last, b"\xff") + pes[len(pes) - last :])
            counter += 1
        counter &= 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program -> PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID -> stream type
    payload: dict[int, bytes] = field(default_factory=dict)  # PID -> payload of its elementary packets
    stamps: dict[int, list[int]] = field(default_factory=dict)  # PID -> time stamps
    access: dict[int, list[int]] = field(default_factory=dict)  # PID -> numbers of packets with the random-access mark
    gaps: int = 0
    repeats: int = 0
    bad_sections: int = 0
    cut: int = 0


def _sections(data: bytes, starts: list[int], out: Stream) -> Iterator[bytes]:
    for at in starts:
        at += 1 + data[at] if at < len(data) else 0
        if at + 3 > len(data):
            out.bad_sections += 1
            continue
        size = 3 + ((data[at + 1] & 15) << 8 | data[at + 2])
        got = data[at : at + size]
        if len(got) == size >= 12 and section_crc(got) == 0:
            yield got
        else:
            out.bad_sections += 1


def read_stream(data: bytes) -> Stream:
    """Parse a transport stream."""
    out = Stream(packets=len(data) // PACKET, cut=len(data) % PACKET)
    p = np.frombuffer(data, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    good = p[:, 0] == SYNC
    out.cut += int((~good).sum())
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    control, adapt = p[:, 3] >> 4 & 3, p[:, 4].astype(np.int64)
    start = np.where(control == 3, 5 + adapt, 4)
    usable = good & (control & 1 == 1) & (start <= PACKET)

    def joined(x: int) -> tuple[bytes, list[int], np.ndarray]:
        """Payload bytes of a PID, where its units start, and the numbers of the packets used."""
        at = np.nonzero(usable & (pid == x))[0]
        if len(at) > 1:
            step = (p[at[1:], 3].astype(np.int16) - p[at[:-1], 3]) & 15
            same = (step == 0) & (p[at[1:]] == p[at[:-1]]).all(1) if (step == 0).any() else np.zeros(len(step), bool)
            out.repeats += int(same.sum())
            out.gaps += int(((step != 1) & ~same).sum())
            at = at[np.r_[True, ~same]]
        begin = start[at]
        keep = np.arange(PACKET)[None, :] >= begin[:, None] if len(at) and (begin != 4).any() else None
        plain = p[at, 4:].tobytes() if keep is None else p[at][keep].tobytes()
        ends = np.cumsum(PACKET - begin)
        units = np.nonzero(p[at, 1] & 0x40)[0]
        return plain, (ends[units] - (PACKET - begin[units])).tolist(), at

    data0, starts, _ = joined(PAT_PID)
    for s in _sections(data0, starts, out):
        for k in range(8, len(s) - 4, 4):
            if number := s[k] << 8 | s[k + 1]:
                out.programs[number] = (s[k + 2] & 31) << 8 | s[k + 3]
    for map_pid in sorted(set(out.programs.values())):
        data0, starts, _ = joined(map_pid)
        for s in _sections(data0, starts, out):
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                out.streams[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for x in sorted(out.streams):
        body, starts, at = joined(x)
        marked = at[(control[at] == 3) & (adapt[at] > 0) & (p[at, 5] & 0x40 > 0)]
        out.access[x], out.stamps[x], parts = marked.tolist(), [], []
        for begin, end in zip(starts, [*starts[1:], len(body)], strict=True):
            unit = body[begin:end]
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                out.cut += 1
                continue
            size = unit[4] << 8 | unit[5]
            if size and len(unit) < 6 + size:
                out.cut += 1
            if unit[7] & 0x80 and len(unit) >= 14:
                out.stamps[x].append((unit[9] >> 1 & 7) << 30 | unit[10] << 22 | unit[11] >> 1 << 15 | unit[12] << 7 | unit[13] >> 1)
            parts.append(unit[9 + unit[8] : 6 + size if size else None])
        out.payload[x] = b"".join(parts)
    return out


def muxed(payload: Column) -> Column:
    """Binary payloads as transport streams."""

    @F.pandas_udf("binary")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([write_stream(b or b"") for b in x], index=x.index, dtype=object)

    return written(payload)


STREAM = "payload binary, packets long, programs int, streams int, gaps long, repeats long, bad_sections long, cut long, stamps array<long>, access array<long>"


def demuxed(media: Column) -> Column:
    """Transport streams read back: payload of all elementary streams in the order of PIDs, tables, faults, time stamps and random-access points."""

    @F.pandas_udf(STREAM)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for b in x:
                s = read_stream(b or b"")
                rows.append((b"".join(s.payload[k] for k in sorted(s.payload)), s.packets, len(s.programs), len(s.streams), s.gaps, s.repeats, s.bad_sections, s.cut, [t for k in sorted(s.stamps) for t in s.stamps[k]], [a for k in sorted(s.access) for a in s.access[k]]))
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in STREAM.split(", ")], index=x.index)

    return parsed(media)


def padded(text: Column) -> Column:
    """A text's bytes in UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    missing = F.when(F.length(raw) == 0, 64).otherwise(F.pmod(-F.length(raw), F.lit(64)))
    return F.concat(raw, F.substring(F.lit(b"\0" * 64), F.lit(1), missing))




def media_documents(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a media column: the text's padded bytes as a transport stream."""
    return docs.withColumn(media, muxed(padded(F.col(text))))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a transport stream, read it back and derive digests and features."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    x = media_documents(docs).drop("text").withColumn("s", demuxed(F.col("media")))
    feature = F.concat_ws(
        ";",
        *[F.concat(F.lit(f"{k}="), F.col(f"s.{k}").cast("string")) for k in ("packets", "programs", "streams", "gaps", "repeats", "bad_sections", "cut")],
        F.concat(F.lit("pes="), F.size("s.stamps").cast("string")),
        F.concat(F.lit("last_pts="), F.coalesce(F.array_max("s.stamps"), F.lit(-1)).cast("string")),
        F.concat(F.lit("access="), F.substring(F.sha2(F.concat_ws(",", F.transform("s.access", lambda a: a.cast("string"))), 256), 1, 16)),
    )
    return x.select(
        "doc_id",
        "n_bytes",
        F.length("s.payload").cast("long").alias("payload_bytes"),
        F.sha2("s.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("s.payload"), -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        # each random-access point: its time stamp and where its transport packet begins
        F.arrays_zip(F.col("s.stamps").alias("pts"), F.col("s.access").alias("at")).alias("access_points"),
    )
