"""Where along its route a live ride is, and where its ghost's marker stands.

What geometry can say about a tick is worked out for all ticks at once by a join
on cells: the segments near it that run its way, without grouping the ticks.  What depends on the ticks
before is a small choice among those, a ride at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.operators.joins import distance_at, near_lists, time_at
from paceline.sources.rides import checkpointed

#: Metres around the last place in which the next one is looked for; the part ahead grows with the odometer.
BACK_M, AHEAD_M, MOST_AHEAD_M = 120.0, 300.0, 400.0
MAX_PERP_M, MAX_TURN_DEG = 40.0, 45.0
#: Moving ticks without a place after which the whole route is asked.
LOST_TICKS = 5
GAP_M, SPAN_M = 75.0, 200.0
#: A ride within so many metres of the end has finished, if it rode all but the margin.
END_M, MARGIN_M = 50.0, 3000.0


def tracked(ticks: DataFrame, segs: DataFrame) -> DataFrame:
    """ride_id, seq, place_m, reliable: metres along the route, the last known one while there is none.

    ticks: ride_id, seq, route_id, lat, lng, heading (null: unknown), odo_m,
    moving, fresh; segs: as ``joins.segments``.  A ride whose route is unknown
    has no place.
    """
    fits = lambda s: (s["perp_m"] <= MAX_PERP_M) & (F.col("heading").isNull() | (geo.bearing_diff_deg(s["heading"], F.col("heading")) <= MAX_TURN_DEG))
    told = lambda s: F.struct(*[s[c].alias(c) for c in ("perp_m", "i", "along_m", "lo_m", "hi_m")])
    found = near_lists(ticks, segs, MAX_PERP_M).withColumn("near", F.array_sort(F.transform(F.filter("near", fits), told)))  # segments near one place
    total = segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m"))
    rows = found.join(total, "route_id", "left")
    rows = rows.select("ride_id", "seq", "odo_m", F.col("heading").isNotNull().alias("headed"), "moving", "fresh", "total_m", "near")

    def run(ride: pa.Table) -> pa.Table:
        ride = ride.sort_by("seq")
        out = _followed(list(zip(*(ride.column(c).to_pylist() for c in ("odo_m", "headed", "moving", "fresh", "total_m", "near")), strict=True)))
        place, reliable = zip(*out, strict=True)
        return pa.table({"ride_id": ride.column("ride_id"), "seq": ride.column("seq"), "place_m": pa.array(place, pa.float64()), "reliable": pa.array(reliable, pa.bool_())})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("ride_id").applyInArrow(run, f"ride_id {kind['ride_id']}, seq {kind['seq']}, place_m double, reliable boolean")


def _followed(ticks: list[tuple]) -> list[tuple[float | None, bool]]:
    place = odo_then = None
    lost, out = 0, []
    for odo, headed, moving, fresh, total, near in ticks:
        if fresh:
            near = near or []
            if place is None:
                hit = near[:1]
            else:
                reach = place + AHEAD_M + min(max(odo - odo_then, 0.0), MOST_AHEAD_M)
                hit = [s for s in near if s["hi_m"] >= place - BACK_M and s["lo_m"] <= reach][:1]
            if not hit and place is not None and headed and moving:
                lost = min(lost + 1, LOST_TICKS)
                hit = near[:1] if lost == LOST_TICKS and _one_place([s["along_m"] for s in near], total) else []
            if hit:
                place, odo_then, lost = hit[0]["along_m"], odo, 0
        out.append((place, lost < LOST_TICKS))
    return out


def _one_place(along: list[float], total: float) -> bool:
    """Whether the places lie together on the loop."""
    along = sorted(along)
    if not along:
        return False
    gaps = [b - a for a, b in zip(along, along[1:], strict=False)] + [along[0] + total - along[-1]]
    return sum(g > GAP_M for g in gaps) < 2 and total - max(gaps) <= SPAN_M


def markers(places: DataFrame, curve: DataFrame) -> DataFrame:
    """ride_id, seq, marker_m: where on the route the ghost is drawn.

    places: what ``tracked`` gives, with route_id, odo_m and lead_s; curve:
    route_id, k, distance_m, time_s.  The ghost is where it was lead_s before it
    came to the rider's place; off the route the last reliable marker stays, and
    on a second lap there is none.
    """
    named = checkpointed(places.withColumn("id", F.struct("ride_id", "seq")))  # asked several times below
    total = curve.groupBy("route_id").agg(F.max("distance_m").alias("total_m"))
    here = time_at(named.where("place_m IS NOT NULL").select("id", "route_id", F.col("place_m").alias("distance_m")), curve, "route_id")
    then = named.join(here, "id").select("id", "route_id", F.greatest(F.lit(0.0), F.col("time_s") - F.col("lead_s")).alias("time_s"))
    ghost = distance_at(then, curve, "route_id").withColumnRenamed("distance_m", "ghost_m")
    w = Window.partitionBy("ride_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    full = F.greatest(F.col("total_m") - MARGIN_M, F.col("total_m") * 0.5)
    ends = (F.col("total_m") > 2 * END_M) & (F.col("total_m") - F.col("place_m") <= END_M) & (F.col("odo_m") >= full)
    rows = named.join(total, "route_id", "left").join(ghost, "id", "left").withColumn("finished", F.max(F.coalesce(ends, F.lit(False))).over(w))
    again = F.max(F.coalesce(F.col("finished") & (F.col("place_m") < F.col("total_m") * 0.5), F.lit(False))).over(w)
    held = F.last(F.when(F.col("reliable"), F.col("ghost_m")), ignorenulls=True).over(w)
    return rows.select("ride_id", "seq", F.when(again, F.lit(None)).when(F.col("reliable"), F.col("ghost_m")).otherwise(held).alias("marker_m"))
