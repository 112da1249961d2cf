"""FIT activity files: the binary files of bike computers, by the public format."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources.files import listing

#: Seconds from 1970 to the format's epoch, and semicircles a degree (fixed values).
EPOCH = 631_065_600
SEMICIRCLES = 2**31 / 180
#: Base type -> struct letter and the value that says invalid (fixed values).
BASE = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0)}
FILE_ID, SESSION, SPORT, RECORD = 0, 18, 12, 20
CYCLING, E_BIKING, GENERIC = 2, 21, 0
ACTIVITY = 4


def _crc_table() -> list[int]:
    """What each byte does to the check value: a reflected CRC with polynomial 0xA001."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xA001 if byte & 1 else 0)
        out.append(byte)
    return out


_CRC = _crc_table()


def checksum(data: bytes) -> int:
    """The format's 16-bit check value."""
    crc = 0
    for byte in data:
        crc = crc >> 8 ^ _CRC[(crc ^ byte) & 0xFF]
    return crc


def messages(data: bytes) -> Iterator[tuple[int, dict[int, float]]]:
    """(message number, field number -> value) of each data message."""
    header = data[0]
    size = struct.unpack_from("<I", data, 4)[0]
    if data[8:12] != b".FIT" or len(data) < header + size + 2:
        raise ValueError("not a whole FIT file")
    if checksum(data[: header + size]) != struct.unpack_from("<H", data, header + size)[0]:
        raise ValueError("check value differs")
    kinds: dict[int, tuple] = {}
    at, end, stamp = header, header + size, 0
    while at < end:
        lead = data[at]
        at += 1
        if lead & 0x80:  # a data message with its time in the lead byte
            kind, offset = lead >> 5 & 3, lead & 31
            stamp += (offset - stamp) & 31
        else:
            kind, offset = lead & 15, None
        if lead & 0xC0 == 0x40:
            order = ">" if data[at + 1] else "<"
            number, n = struct.unpack_from(order + "HB", data, at + 2)
            at += 5
            fields = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
            at += 3 * n
            extra = 0
            if lead & 0x20:
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            kinds[kind] = (order, number, fields, extra)
            continue
        order, number, fields, extra = kinds[kind]
        values: dict[int, float] = {}
        for field, width, base in fields:
            letter, none = BASE.get(base, (None, None))
            if letter and width == struct.calcsize("<" + letter):
                v = struct.unpack_from(order + letter, data, at)[0]
                if v != none and not (isinstance(v, float) and math.isnan(v)):
                    values[field] = v
            at += width
        at += extra
        if 253 in values:
            stamp = int(values[253])
        elif offset is not None:
            values[253] = stamp
        yield number, values


def is_ride(file_type: int | None, sports: set[int]) -> bool:
    return file_type in (None, ACTIVITY, 255) and (not sports or bool(sports & {CYCLING, E_BIKING, GENERIC}))


def metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def decode(data: bytes) -> tuple[str, list[tuple]]:
    """Outcome and points (started_ms, seq, lat, lng, distance_m, time_s, ele_m).

    failed: unreadable now, to be tried again; invalid: not a ride; decoded.
    """
    try:
        file_type, sports, rows = None, set(), []
        for number, v in messages(data):
            if number == FILE_ID:
                file_type = v.get(0)
            elif number in (SESSION, SPORT) and (5 if number == SESSION else 0) in v:
                sports.add(int(v[5 if number == SESSION else 0]))
            elif number == RECORD and {0, 1, 253} <= v.keys():
                height = v.get(78, v.get(2))
                rows.append((v[253], v[0] / SEMICIRCLES, v[1] / SEMICIRCLES, v[5] / 100 if 5 in v else None, height / 5 - 500 if height is not None else None))
    except (ValueError, IndexError, KeyError, struct.error):
        return "failed", []
    if not is_ride(file_type, sports) or len(rows) < 2:
        return "invalid", []
    out, run, high, before = [], 0.0, 0.0, None
    for t, lat, lng, dist, ele in rows:
        if before:
            run += metres(*before, lat, lng)
        before = (lat, lng)
        high = max(high, run if dist is None else dist)
        out.append((t, lat, lng, high, ele))
    t0, d0 = out[0][0], out[0][3]
    return "decoded", [((int(t0) + EPOCH) * 1000, k, lat, lng, d - d0, float(t - t0), ele) for k, (t, lat, lng, d, ele) in enumerate(out)]


def encode(points: list[tuple], file_type: int = ACTIVITY, sport: int = CYCLING) -> bytes:
    """A FIT file of points (seconds since 1970, lat, lng, metres or None, height or None), for export and tests."""
    body = struct.pack("<BBBHB3B", 0x40, 0, 0, FILE_ID, 1, 0, 1, 0x00) + struct.pack("<BB", 0, file_type)
    fields = [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (5, 4, 0x86), (2, 2, 0x84)]
    body += struct.pack("<BBBHB", 0x42, 0, 0, RECORD, len(fields)) + b"".join(struct.pack("3B", *f) for f in fields)
    for at, lat, lng, dist, ele in points:
        semi = [0x7FFFFFFF if x is None else round(x * SEMICIRCLES) for x in (lat, lng)]
        body += struct.pack("<BIiiIH", 2, int(at) - EPOCH, *semi, 0xFFFFFFFF if dist is None else math.floor(dist * 100 + 0.5), 0xFFFF if ele is None else math.floor((ele + 500) * 5 + 0.5))
    body += struct.pack("<BBBHB3B", 0x41, 0, 0, SESSION, 1, 5, 1, 0x00) + struct.pack("<BB", 1, sport)
    head = struct.pack("<BBHI4sH", 14, 16, 0, len(body), b".FIT", 0)
    return head + body + struct.pack("<H", checksum(head + body))


POINTS = "path string, outcome string, started_ms bigint, seq int, lat double, lng double, distance_m double, time_s double, ele_m double"
_SCHEMA = pa.schema([("path", pa.string()), ("outcome", pa.string()), ("started_ms", pa.int64()), ("seq", pa.int32()), *[(c, pa.float64()) for c in ("lat", "lng", "distance_m", "time_s", "ele_m")]])


def decoded(files: DataFrame, decoder: Callable[[bytes], tuple[str, list[tuple]]] = decode) -> DataFrame:
    """Points of files (path, content), and one row for each file without.

    decoder: content -> outcome and points, for files of another make.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                outcome, pts = decoder(content.as_py() or b"")
                rows = [(path.as_py(), outcome, *p) for p in pts] or [(path.as_py(), outcome, *[None] * 7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    got = files.select("path", "content").mapInArrow(run, POINTS)
    return got.withColumn("track_id", F.concat(F.lit("fit-"), F.col("started_ms").cast("string")))


def read(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """Points of all .fit files below a path, and one row for each file without.

    since_ms: only of files changed after that; Spark leaves the others unread.
    """
    return decoded(listing(spark, path, "*.[fF][iI][tT]", since_ms))
