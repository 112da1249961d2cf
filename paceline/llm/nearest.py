"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected to a few dimensions by Gaussian (2-stable) rows, so that a
projected squared distance over the true one follows a chi-square law.  A
kd-tree over the projected points, split at medians of a bounded sample, deals
all rows into cells of about ``CELL_ROWS``.  A query takes its projected
neighbours in order of projected distance, measures each on the original
vectors, and stops when the law says that a nearer one has likely been seen: the
chi-square quantile at ``CONFIDENCE`` times the k-th best squared distance lies
below the next projected squared distance.

This runs in two passes, both per cell: the query's own cell gives a first k-th
distance; then every cell whose box may still hold neighbours under the test is
visited, with that bound from the start.  In a cell, a smaller kd-tree hands out
its leaves in order of their boxes' distance, and the rows of those met so far
are measured in order of projected distance.  Queries are dealt out in blocks,
so a cell that all queries visit is many tasks; equal vectors are one point with
its k + 1 smallest ids, all that an answer can hold; a cell with many more rows
than ``CELL_ROWS`` (the sample of splits is bounded) is several rows, each
searched by itself.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; rows with a null vec_id take no
part; of rows with one vec_id the smallest vector counts, as a query and as a
candidate; ties in the score go to the smaller vec_id; with fewer candidates all
are given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.llm.common import checkpointed, table

K = 10
DIMS = 10
#: Share of the chi-square law under which a nearer vector would have been met.
CONFIDENCE = 0.985
CELL_ROWS = 2048
#: Rows of a leaf of the tree inside a cell.
LEAF_ROWS = 64
#: The tree's splits are medians of about so many rows.
SAMPLE_ROWS = 65_536
#: Queries of one task's visit to a cell.
BLOCK = 512
EVERY = 100


def chi_square_quantile(p: float, m: int) -> float:
    """Wilson and Hilferty's approximation."""
    z, c = NormalDist().inv_cdf(p), 2 / (9 * m)
    return m * (1 - c + z * c**0.5) ** 3


class Tree:
    """A kd-tree's splits, fitted on sample points; ``cells`` deals points to leaves."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.axis: list[int] = []
        self.at: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        m = sample.shape[1] if len(sample) else DIMS
        self._grow(sample, n_cells, np.full(m, -np.inf), np.full(m, np.inf))
        self.box_lo, self.box_hi = np.array(self.lo), np.array(self.hi)

    def _grow(self, pts: np.ndarray, cells: int, lo: np.ndarray, hi: np.ndarray) -> int:
        """Returns the node's number, or the leaf's as -1 - leaf."""
        if cells <= 1 or len(pts) < 2:
            self.lo.append(lo)
            self.hi.append(hi)
            return -len(self.lo)
        d = int(np.argmax(pts.max(0) - pts.min(0)))
        at = float(np.median(pts[:, d]))
        me = len(self.axis)
        self.axis.append(d)
        self.at.append(at)
        self.kids.append((0, 0))
        below = pts[:, d] < at
        up_lo, down_hi = lo.copy(), hi.copy()
        up_lo[d] = down_hi[d] = at
        left = self._grow(pts[below], cells // 2, lo, down_hi)
        self.kids[me] = (left, self._grow(pts[~below], cells - cells // 2, up_lo, hi))
        return me

    def cells(self, pts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pts), np.int64)
        todo = [(0 if self.axis else -1, np.arange(len(pts)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                below = pts[rows, self.axis[node]] < self.at[node]
                todo += [(self.kids[node][0], rows[below]), (self.kids[node][1], rows[~below])]
        return out

    def near(self, point: np.ndarray, most: float) -> list[int]:
        """Leaves whose box is within squared distance ``most`` of the point, from the root down."""
        return [leaf for leaf, _ in self.leaves(point, lambda: most)]

    def leaves(self, point: np.ndarray, most) -> Iterator[tuple[int, float]]:
        """(leaf, squared distance of its box) in order of distance, while below most()."""
        heap = [(0.0, 0, 0 if self.axis else -1, ())]
        n = 1
        while heap:
            d, _, node, gaps = heapq.heappop(heap)
            if d > most():
                return
            if node < 0:
                yield -1 - node, d
                continue
            axis = self.axis[node]
            off = point[axis] - self.at[node]
            near, far = self.kids[node] if off < 0 else self.kids[node][::-1]
            old = dict(gaps)
            heapq.heappush(heap, (d, n, near, gaps))
            new = {**old, axis: max(old.get(axis, 0.0), off * off)}
            heapq.heappush(heap, (d - old.get(axis, 0.0) + new[axis], n + 1, far, tuple(new.items())))
            n += 2


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (size[0]["d"] if size else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _reach(bound: float, stretch: float) -> float:
    """The squared projected distance up to which a nearer row than bound may lie."""
    return float("inf") if np.isinf(stretch) else stretch * bound * bound


class Cell:
    """The rows of a cell under a kd-tree of their own."""

    def __init__(self, x: np.ndarray, project: np.ndarray):
        self.x, self.px = x, x @ project
        self.tree = Tree(self.px, max(1, len(x) // LEAF_ROWS))
        leaf = self.tree.cells(self.px)
        self.order = np.argsort(leaf, kind="stable")
        self.cut = np.searchsorted(leaf[self.order], np.arange(leaf.max(initial=0) + 2))

    def search(self, q: np.ndarray, pq: np.ndarray, bound: float, k: int, stretch: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows among the k nearest of q and their distances: projected
        neighbours, leaf by leaf, until the chi-square test holds for the next leaf."""
        got, best = np.empty(0, np.int64), np.empty(0)
        limit = [_reach(bound, stretch)]
        for leaf, _ in self.tree.leaves(pq, lambda: limit[0]):
            rows = self.order[self.cut[leaf] : self.cut[leaf + 1]]
            d = self.px[rows] - pq
            rows = rows[np.einsum("ij,ij->i", d, d) <= limit[0]]
            e = self.x[rows] - q
            got, best = np.append(got, rows), np.append(best, np.sqrt(np.einsum("ij,ij->i", e, e)))
            if len(best) >= k:
                kth = np.partition(best, k - 1)[k - 1]
                keep = best <= kth  # ties stay: ids decide later
                got, best = got[keep], best[keep]
                bound = min(bound, kth)
                limit[0] = _reach(bound, stretch)
        return got, best


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself.

    rows: vec_id, embedding; queries: vec_id of those rows to search for.
    ``exact`` drops the stopping test.
    """
    points = checkpointed(usable(rows).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n = points.count()
    dim = points.select(F.size("embedding")).first()
    d = dim[0] if dim else 1
    project = np.random.default_rng(3).normal(size=(d, DIMS))
    stretch = float("inf") if exact else chi_square_quantile(confidence, DIMS)
    chosen = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).select("embedding")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_matrix(b.column(0)) @ project) if b.num_rows else [], pa.list_(pa.float64()))], ["p"])

    sample = _matrix(chosen.mapInArrow(projected, "p array<double>").toArrow().column(0).combine_chunks())  # DIMS numbers a row of the sample
    tree = Tree(sample if len(sample) else np.empty((0, DIMS)), max(1, n // CELL_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.cells(_matrix(b.column(1)) @ project) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    alike = _alike(points, k + 1)
    placed = checkpointed(alike.select("ids", "embedding").mapInArrow(place, "ids array<bigint>, embedding array<double>, cell bigint"))

    def pack(key, batches):
        x = _matrix(batches.column("embedding").combine_chunks())
        return pa.table({"cell": [key[0].as_py()], "ids": [batches.column("ids").to_pylist()], "x": [x.tobytes()]}, pa.schema([("cell", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64()))), ("x", pa.binary())]))

    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * CELL_ROWS)).alias("parts"))
    parted = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("ids"), "parts"))  # a row a cell, bounded by the sample
    cells = checkpointed(parted.groupBy("cell", "part").applyInArrow(pack, "cell bigint, ids array<array<bigint>>, x binary"))
    asked = points.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = checkpointed(asked.mapInArrow(place, "query_id bigint, embedding array<double>, cell bigint"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, float]] = []
            for row in b.to_pylist():
                ids, cell = row["ids"], Cell(np.frombuffer(row["x"]).reshape(-1, d), project)
                for qid, q, bound in zip(row["qids"], row["qs"], row["bounds"], strict=True):
                    q = np.array(q)
                    # one more: the query itself is among the rows
                    for r, s in zip(*cell.search(q, q @ project, bound, k + 1, stretch), strict=True):
                        out += [(qid, i, float(s)) for i in ids[r] if i != qid]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    def searched(visits: DataFrame) -> DataFrame:
        """visits: query_id, embedding, bound, cell."""
        busy = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        blocks = (
            visits.join(busy, "cell")
            .groupBy("cell", F.pmod(F.xxhash64("query_id"), "blocks").alias("block"))
            .agg(F.collect_list("query_id").alias("qids"), F.collect_list("embedding").alias("qs"), F.collect_list("bound").alias("bounds"))
        )
        return blocks.join(cells, "cell").select("qids", "qs", "bounds", "ids", "x").mapInArrow(visit, "query_id bigint, vec_id bigint, score double")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)

    first = checkpointed(best(searched(asked.withColumn("bound", F.lit(float("inf"))))))
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    known = asked.withColumnRenamed("cell", "home").join(kth, "query_id", "left").select("query_id", "embedding", "home", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pq = _matrix(b.column(1)) @ project
            near = [np.array([c for c in tree.near(p, _reach(bound, stretch)) if c != home], np.int64) for p, bound, home in zip(pq, b.column(3).to_numpy(), b.column(2).to_numpy(), strict=True)]
            rows_ = pa.array(np.repeat(np.arange(len(near)), [len(c) for c in near]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows_), b.column(1).take(rows_), b.column(3).take(rows_), pa.array(np.concatenate([*near, np.empty(0, np.int64)]))], ["query_id", "embedding", "bound", "cell"])

    visits = known.mapInArrow(spread, "query_id bigint, embedding array<double>, bound double, cell bigint")
    found = first.select("query_id", "vec_id", "score").unionByName(searched(visits))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _alike(points: DataFrame, most: int) -> DataFrame:
    """embedding, ids: one row a distinct vector with its ``most`` smallest ids."""
    key = F.xxhash64("embedding")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    smallest = lambda c: F.slice(F.array_sort(c), 1, most)
    some = points.groupBy(key.alias("h"), "embedding", part.alias("part")).agg(smallest(F.collect_list("vec_id")).alias("ids"))
    return some.groupBy("h", "embedding").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
