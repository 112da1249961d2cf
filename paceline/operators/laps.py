"""Laps of a route as seconds from node to node, and their fold over laps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.joins import interpolate, interval_join, near_segments
from paceline.operators.road_pace import in_order, seeded_mean

MAX_SPEED = 30.0
MIN_SPEED = 0.5
STEP_M = 25.0


def crossings(laps: DataFrame, route_len_m: float, step_m: float = STEP_M) -> DataFrame:
    """lap_id, k, d, t: when each lap (lap_id, route_dist_m, time_s) passes the nodes between its ends."""
    w = Window.partitionBy("lap_id").orderBy("time_s", "route_dist_m")
    pairs = laps.select("lap_id", F.lag("route_dist_m").over(w).alias("d0"), F.col("route_dist_m").alias("d1"), F.lag("time_s").over(w).alias("t0"), F.col("time_s").alias("t1"))
    pairs = pairs.where("d0 IS NOT NULL AND d1 >= d0")
    ends = laps.groupBy("lap_id").agg(F.min("route_dist_m").alias("lo"), F.max("route_dist_m").alias("hi")).where("lo < hi")
    last = F.least(F.floor(F.col("hi") / step_m), F.lit(int(max(0.0, route_len_m) // step_m)))
    first = F.greatest(F.lit(0), F.ceil(F.col("lo") / step_m))
    nodes = ends.where(first <= last).select("lap_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("k")).withColumn("d", F.col("k") * step_m)
    met = interval_join(nodes, pairs, "lap_id", "d", "d0", "d1", 20 * step_m, "both")
    t = interpolate(F.col("d"), F.col("d0"), F.col("d1"), F.col("t0"), F.col("t1"))
    return met.groupBy("lap_id", "k", "d").agg(F.min(t).alias("t"))


def lap_folds(laps: DataFrame, route_len_m: float, step_m: float = STEP_M) -> DataFrame:
    """lap_id, k, dt_s: seconds from the node before, at MIN_SPEED at least.

    A node passed too fast after the last good one does not count.  Too fast is
    MAX_SPEED, so a node is good when its time less that of riding there at
    MAX_SPEED is no smaller than any before it: a running maximum.  A node
    answers when the one before it is good as well.
    """
    start = laps.groupBy("lap_id").agg(F.min(F.struct("time_s", "route_dist_m")).alias("s")).select("lap_id", (F.col("s.time_s") - F.col("s.route_dist_m") / MAX_SPEED).alias("from"))
    w = Window.partitionBy("lap_id").orderBy("k")
    slack = F.round(F.col("t") - F.col("d") / MAX_SPEED, 9)
    upto = F.greatest(F.round("from", 9), F.max(slack).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    good = crossings(laps, route_len_m, step_m).join(start, "lap_id").withColumn("upto", upto).where(slack >= F.col("upto"))
    took = good.withColumn("was", F.lag("k").over(w)).withColumn("took", F.col("t") - F.lag("t").over(w)).where("was = k - 1")
    return took.select("lap_id", "k", F.least("took", F.lit(step_m / MIN_SPEED)).alias("dt_s"))


def fold_of_laps(folds: DataFrame, order: Column) -> DataFrame:
    """k, dt_s, min_dt_s, last_dt_s, count of each node over laps, oldest first.

    folds: lap_id, k, dt_s and what ``order`` needs.
    """
    return in_order(folds, ["k"], order).groupBy("k").agg(
        seeded_mean("dt_s").alias("dt_s"), F.min("dt_s").alias("min_dt_s"), F.max(F.when(F.col("place") == F.col("places"), F.col("dt_s"))).alias("last_dt_s"), F.count("*").alias("count")
    )


def route_laps(points: DataFrame) -> DataFrame:
    """lap_id, route_dist_m, time_s from a ride's own points: each ride is one lap of its road."""
    return points.select(F.col("track_id").alias("lap_id"), F.col("distance_m").alias("route_dist_m"), "time_s")


#: How near a lap keeps to its route, what it must gain a point, and the jump along the route that ends it.
TOLERANCE_M, ADVANCE_M, JUMP_M = 35.0, 1e-3, 500.0
#: Metres of the route before and after the last place in which the next one is looked for.
BACK_M, AHEAD_M = 50.0, 600.0


def seed_laps(points: DataFrame, segs: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """track_id, route_id, lap, k, route_m, elapsed_s: stretches of routes that rides follow forward.

    points: track_id, seq, route_id, lat, lng, time_s; segs: as ``joins.segments``.
    A point counts if the route passes within tolerance_m of it in a window
    around the last place, further along than that, and no earlier.  A jump of
    more than JUMP_M ends a lap and begins another, timed from 0; laps of one
    point are none.  The segments near a point come from a join on cells; the
    choice among them follows from the points before, so a ride on a route is
    one ordered group.
    """
    asked = points.select(F.struct("track_id", "route_id", "seq").alias("id"), "route_id", "lat", "lng")
    near = near_segments(asked, segs, tolerance_m).where(F.col("perp_m") < tolerance_m)
    found = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("perp_m", "i", "along_m", "lo_m", "hi_m"))).alias("near"))  # segments near one place
    rows = points.select("track_id", "route_id", "seq", "time_s").join(found.select("id.*", "near"), ["track_id", "route_id", "seq"])

    def run(ride: pa.Table) -> pa.Table:
        ride = ride.sort_by("seq")
        out = _seeded(ride.column("time_s").to_pylist(), ride.column("near").to_pylist())
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        same = [pa.array([ride.column(c)[0].as_py()] * len(out), ride.column(c).type) for c in ("track_id", "route_id")]
        return pa.table([*same, *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)]], names=["track_id", "route_id", "lap", "k", "route_m", "elapsed_s"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("track_id", "route_id").applyInArrow(run, f"track_id {kind['track_id']}, route_id {kind['route_id']}, lap int, k int, route_m double, elapsed_s double")


def _seeded(times: list[float], near: list[list[dict]]) -> list[tuple[int, int, float, float]]:
    laps: list[list[tuple[float, float]]] = [[]]
    for time, around in zip(times, near, strict=True):
        lap = laps[-1]
        place = lap[-1][0] if lap else None
        here = around if place is None else [s for s in around if s["hi_m"] >= place - BACK_M and s["lo_m"] <= place + AHEAD_M]
        if not here:
            continue
        along = here[0]["along_m"]
        if lap and (along <= place + ADVANCE_M or along - place <= JUMP_M and time < lap[-1][1]):
            continue
        if lap and along - place > JUMP_M:
            laps.append(lap := [])
        lap.append((along, time))
    whole = [lap for lap in laps if len(lap) > 1]
    return [(n, k, along, time - lap[0][1]) for n, lap in enumerate(whole) for k, (along, time) in enumerate(lap)]
