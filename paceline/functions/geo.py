"""Geodesy as column expressions: distances, headings, cells and geohashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEG = 111_320.0
MATCH_RADIUS_M = 18.0
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lng2 - lng1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial heading, 0 to 360."""
    dl = F.radians(lng2 - lng1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def bearing_diff_deg(a: Column, b: Column) -> Column:
    """Circular difference, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def equirectangular_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    x = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2)) * M_PER_DEG
    y = (lat2 - lat1) * M_PER_DEG
    return F.sqrt(x * x + y * y)


def m_per_deg_lng(ref_lat: Column | float) -> Column:
    lat = F.lit(ref_lat) if isinstance(ref_lat, float) else ref_lat
    return F.greatest(F.lit(1.0), M_PER_DEG * F.cos(F.radians(lat)))


def cell_lat(lat: Column, size_m: float = MATCH_RADIUS_M) -> Column:
    return F.floor(lat / (size_m / M_PER_DEG)).cast("int")


def cell_lng(lng: Column, row: Column, size_m: float = MATCH_RADIUS_M) -> Column:
    """Column number within a row of cells (``cell_lat``): size_m wide at that row's middle latitude."""
    return F.floor(lng / (size_m / m_per_deg_lng((row + 0.5) * (size_m / M_PER_DEG)))).cast("int")


def heading_bin(deg: Column) -> Column:
    """Eight bins of 45 degrees."""
    return F.least(F.lit(7), F.floor(F.pmod(deg, F.lit(360.0)) / 45.0)).cast("int")


def geohash_rows(lat: Column, precision: int) -> Column:
    """Row number of the geohash cell that holds a latitude."""
    bits = 5 * precision // 2
    return F.least(F.lit(2**bits - 1), F.greatest(F.lit(0), F.floor((lat + 90) / 180 * 2**bits))).cast("bigint")


def geohash_cols(lng: Column, precision: int) -> Column:
    bits = 5 * precision - 5 * precision // 2
    return F.least(F.lit(2**bits - 1), F.greatest(F.lit(0), F.floor((lng + 180) / 360 * 2**bits))).cast("bigint")


def geohash_of(row: Column, col: Column, precision: int) -> Column:
    """Text of a geohash cell: bits interleaved, longitude first, five a letter."""
    n = 5 * precision
    n_lat = n // 2
    n_lng = n - n_lat
    letters = []
    for letter in range(precision):
        value = F.lit(0)
        for bit in range(5):
            k = 5 * letter + bit
            source, at = (col, n_lng - 1 - k // 2) if k % 2 == 0 else (row, n_lat - 1 - k // 2)
            value = value + F.shiftright(source, at).bitwiseAND(1) * (1 << (4 - bit))
        letters.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash(lat: Column, lng: Column, precision: int) -> Column:
    return geohash_of(geohash_rows(lat, precision), geohash_cols(lng, precision), precision)


def foot_on_segment(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> dict[str, Column]:
    """Nearest place on a segment in the local plane: t in 0..1 and the distance."""
    kx = m_per_deg_lng(a_lat)
    bx, by = (b_lng - a_lng) * kx, (b_lat - a_lat) * M_PER_DEG
    px, py = (lng - a_lng) * kx, (lat - a_lat) * M_PER_DEG
    long = bx * bx + by * by
    t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * bx + py * by) / long))).otherwise(0.0)
    dx, dy = px - t * bx, py - t * by
    return {"t": t, "perp_m": F.sqrt(dx * dx + dy * dy)}
