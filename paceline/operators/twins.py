"""Twin rides: which rides share route, direction and footprint, judged tile by tile.

Rides meet by the place half-way and a band of lengths.  Where many meet, they
are dealt over chunks, and a tile is two chunks that meet: its task compares
lengths and places, and counts shared cells as products of 0/1 matrices.  So
pairs arise in the tiles, and no pair and no cell of a pair is ever shuffled;
what is shuffled is a ride's own record, once for each tile it is in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.sources.rides import checkpointed

#: About so many rides a side has a tile.
CHUNK = 1024
#: So many cells are counted at once.
COLUMNS = 4096
_STRIDE = 1 << 32
_AROUND = np.array([i * _STRIDE + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
_PLACES = [f"{c}{k}" for k in (1, 2, 3) for c in ("lat", "lng")]


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all rides of a table, the ride each is of, and how many each ride has."""
    n = pc.fill_null(pc.list_value_length(table.column("fine")), 0).to_numpy()
    return pc.list_flatten(table.column("fine")).to_numpy(), np.repeat(np.arange(len(n)), n), n


def _shared(a: tuple, b: tuple) -> np.ndarray:
    """How many cells of each ride of a lie in the widened cells of each ride of b."""
    cells, ride, n = a
    known = np.unique(cells)
    wide, of = (b[0][:, None] + _AROUND).ravel(), np.repeat(b[1], len(_AROUND))
    at = np.searchsorted(known, wide)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == wide[hit]
    at, of, mine = at[hit], of[hit], np.searchsorted(known, cells)
    out = np.zeros((len(n), len(b[2])), np.float32)
    for k in range(0, len(known), COLUMNS):
        width = min(COLUMNS, len(known) - k)
        left, right = np.zeros((len(n), width), np.float32), np.zeros((len(b[2]), width), np.float32)
        for m, pos, rides in ((left, mine, ride), (right, at, of)):
            here = (pos >= k) & (pos < k + width)
            m[rides[here], pos[here] - k] = 1
        out += left @ right.T
    return out


def _near(a: pa.Table, b: pa.Table, length_tolerance: float, place_m: float) -> np.ndarray:
    """Which rides of a and b have about the same length and places."""
    one = {c: a.column(c).to_numpy()[:, None] for c in ["length_m", *_PLACES]}
    two = {c: b.column(c).to_numpy()[None, :] for c in ["length_m", *_PLACES]}
    fine = np.abs(one["length_m"] - two["length_m"]) <= length_tolerance * np.maximum(one["length_m"], two["length_m"])
    for k in (1, 2, 3):
        y1, x1, y2, x2 = one[f"lat{k}"], one[f"lng{k}"], two[f"lat{k}"], two[f"lng{k}"]
        x = (x2 - x1) * np.cos(np.radians((y1 + y2) / 2)) * geo.M_PER_DEG
        y = (y2 - y1) * geo.M_PER_DEG
        fine &= np.sqrt(x * x + y * y) <= place_m
    return fine


def _linked(met: np.ndarray) -> list[tuple[int, int]]:
    """Row and column numbers of links that connect what met connects: rows count from 0, columns after them; each a star."""
    m, n = met.shape
    out, left, free = [], met.any(axis=1), np.ones(n, bool)
    while left.any():
        root = int(np.argmax(left))
        edge = np.zeros(m, bool)
        edge[root] = True
        left[root] = False
        while edge.any():
            new = met[edge].any(axis=0) & free
            free &= ~new
            out += [(root, m + int(k)) for k in np.flatnonzero(new)]
            edge = met[:, new].any(axis=1) & left if new.any() else np.zeros(m, bool)
            left &= ~edge
            out += [(root, int(k)) for k in np.flatnonzero(edge)]
    return out


def judged(table: pa.Table, cover: float, length_tolerance: float, place_m: float, links: bool) -> pa.Table:
    """a, b of a tile's twins, or of links that connect them.

    table: rides of both sides (``side`` 0 and 1); one side 0 row of a ride may
    meet only larger ids (``here``), and a pair needs an asked ride.
    """
    a, b = (table.filter(pc.equal(table.column("side"), s)) for s in (0, 1))
    ids = [t.column("track_id").to_pylist() for t in (a, b)]
    kind = np.int64 if pa.types.is_integer(table.schema.field("track_id").type) else object
    x, y = (np.array(i, kind) for i in ids)
    met = _near(a, b, length_tolerance, place_m) & (~a.column("here").to_numpy()[:, None] | (x[:, None] < y[None, :]))
    met &= a.column("asked").to_numpy()[:, None] | b.column("asked").to_numpy()[None, :]
    rows, cols = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
    met, x, y = met[np.ix_(rows, cols)], x[rows], y[cols]
    if len(rows):
        one, two = _cells(a.take(pa.array(rows))), _cells(b.take(pa.array(cols)))
        for p, q, turned in ((one, two, False), (two, one, True)):
            c, n = _shared(p, q), p[2][:, None]
            enough = (c >= cover * n) & (c > 0)
            met &= enough.T if turned else enough
    if links:
        both = np.concatenate([x, y])
        pairs = np.array(_linked(met), np.int64).reshape(-1, 2)
        u, v = both[pairs[:, 0]], both[pairs[:, 1]]
        u, v = u[u != v], v[u != v]
    else:
        i, j = np.nonzero(met)
        u, v = x[i], y[j]
    less = u < v
    t = table.schema.field("track_id").type
    return pa.table({"a": pa.array(np.where(less, u, v), t), "b": pa.array(np.where(less, v, u), t)})


def tiled(summaries: DataFrame, cells: DataFrame, cover: float, length_tolerance: float, place_m: float, links: bool, asked: DataFrame | None = None) -> DataFrame:
    """a, b with a < b: twins, or with ``links`` pairs that connect the same groups as twins do.

    summaries: as ``library.summaries`` gives them; cells: track_id, row, col.
    asked (track_id): only pairs with one of these; all without.
    """
    row, ratio = geo.cell_lat(F.col("p2.lat"), place_m), math.log(1 / (1 - length_tolerance))
    fine = cells.groupBy("track_id").agg(F.collect_list((F.col("row") + 1) * _STRIDE + F.col("col") + 1).alias("fine"))
    s = summaries.where("length_m > 0").select("track_id", "length_m", *[F.col(f"p{k}.{c}").alias(f"{c}{k}") for k in (1, 2, 3) for c in ("lat", "lng")], row.alias("row"), F.floor(F.log("length_m") / ratio).alias("band"))
    if asked is None:
        s = s.withColumn("asked", F.lit(True))
    else:
        s = s.join(asked.select("track_id").distinct().withColumn("asked_", F.lit(True)), "track_id", "left").withColumn("asked", F.col("asked_").isNotNull()).drop("asked_")
    s = checkpointed(s.join(fine, "track_id"))
    key = ["row", "col", "band"]
    right = s.select("track_id", "row", geo.cell_lng(F.col("lng2"), F.col("row"), place_m).alias("col"), "band")
    # of two neighbours in (band, row, column) the lower one looks for the higher one
    steps = [(b, i, j) for b in (0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if (b, i, j) >= (0, 0, 0)]
    o = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j")) for b, i, j in steps])).alias("o")
    left = s.select("track_id", "row", "lng2", "band", o).withColumns({"row": F.col("row") + F.col("o.i"), "band": F.col("band") + F.col("o.b")})
    here = (F.col("o.b") == 0) & (F.col("o.i") == 0) & (F.col("o.j") == 0)
    left = left.select("track_id", "row", (geo.cell_lng(F.col("lng2"), F.col("row"), place_m) + F.col("o.j")).alias("col"), "band", here.alias("here"))
    # where both sides have rides, in how many chunks each
    chunks = F.ceil(F.count("*") / CHUNK)
    met = checkpointed(right.groupBy(*key).agg(chunks.alias("n1")).join(left.groupBy(*key).agg(chunks.alias("n0")), key))
    deal = lambda n: F.pmod(F.xxhash64("track_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    one = left.join(met, key).select("track_id", *key, "here", F.lit(0).alias("side"), deal("n0").alias("c0"), every("n1").alias("c1"))
    two = right.join(met, key).select("track_id", *key, F.lit(False).alias("here"), F.lit(1).alias("side"), every("n0").alias("c0"), deal("n1").alias("c1"))
    rows = one.unionByName(two).join(s.drop(*key), "track_id")
    kind = dict(s.dtypes)["track_id"]
    work = lambda table: judged(table, cover, length_tolerance, place_m, links)
    return rows.groupBy(*key, "c0", "c1").applyInArrow(work, f"a {kind}, b {kind}")
