"""Encoded polylines: a table function, one row a vertex."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(encoded: str, precision: int = 5) -> list[tuple[float, float]]:
    """Vertices of an encoded line; what is cut off at the end is left out."""
    values: list[int] = []
    value = shift = 0
    for c in encoded:
        bits = ord(c) - 63
        value |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    out: list[tuple[float, float]] = []
    lat = lng = 0
    for dlat, dlng in zip(values[::2], values[1::2], strict=False):
        lat += dlat
        lng += dlng
        out.append((lat / 10**precision, lng / 10**precision))
    return out


def encode(places: list[tuple[float, float]], precision: int = 5) -> str:
    """The encoded line of vertices (lat, lng)."""
    out, before = [], (0, 0)
    for place in places:
        here = tuple(math.floor(x * 10**precision + 0.5) for x in place)
        for now, was in zip(here, before, strict=True):
            value = (now - was) << 1
            value = ~value if now < was else value
            while value >= 32:
                out.append(chr((value & 31 | 32) + 63))
                value >>= 5
            out.append(chr(value + 63))
        before = here
    return "".join(out)


def encoded(vertices_: DataFrame) -> DataFrame:
    """route_id, encoded of vertices (route_id, i, lat, lng)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        return pa.table({"route_id": [key[0].as_py()], "encoded": [encode(list(zip(rows.column("lat").to_pylist(), rows.column("lng").to_pylist(), strict=True)))]})

    named = vertices_.select(F.col("route_id").cast("string").alias("route_id"), "i", "lat", "lng")
    return named.groupBy("route_id").applyInArrow(run, "route_id string, encoded string")


def vertices(routes: DataFrame, precision: int = 5) -> DataFrame:
    """route_id, i, lat, lng of routes (route_id, encoded)."""

    kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(route, i, a, b) for route, line in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (a, b) in enumerate(decode(line or "", precision))]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["route_id", "i", "lat", "lng"])

    return routes.select(F.col("route_id").cast("string"), "encoded").mapInArrow(run, "route_id string, i int, lat double, lng double")
