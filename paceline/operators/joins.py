"""Joins that Spark has no name for, planned as equi-joins plus an exact filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.sources.rides import checkpointed


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, lo: str, hi: str, bucket: float, closed: str = "right") -> DataFrame:
    """Points matched with the intervals of the same key that hold them.

    An interval is spread over the buckets it touches, so the join is by equal
    (key, bucket); ``closed`` says which end belongs: right, left or both.
    """
    spread = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    placed = points.withColumn("__b", F.floor(F.col(at) / bucket))
    both = placed.join(spread, [key, "__b"])
    x, a, z = F.col(at), F.col(lo), F.col(hi)
    inside = {"right": (x > a) & (x <= z), "left": (x >= a) & (x < z), "both": (x >= a) & (x <= z)}[closed]
    return both.where(inside).drop("__b")


def interpolate(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.when(x1 > x0, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(y0)


def segments(vertices: DataFrame) -> DataFrame:
    """Segments of routes: route_id, i, both ends, lo_m, hi_m and heading.

    vertices: route_id, i, lat, lng.
    """
    w = Window.partitionBy("route_id").orderBy("i")
    nxt = vertices.select("route_id", "i", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.lead("lat").over(w).alias("b_lat"), F.lead("lng").over(w).alias("b_lng")).where("b_lat IS NOT NULL")
    ends = [F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")]
    long = nxt.withColumn("long_m", geo.haversine_m(*ends)).withColumn("heading", geo.bearing_deg(*ends))
    hi = F.sum("long_m").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return long.withColumn("hi_m", hi).withColumn("lo_m", F.col("hi_m") - F.col("long_m"))


#: Metres of a route that are one key where points meet segments by their band.
BAND_M = 500.0


def feet(points: DataFrame, segs: DataFrame, on: str | list[str] = "route_id") -> DataFrame:
    """Every (point, segment) of the same route with perp_m and along_m.

    points: id, route_id, lat, lng and more.  A route has a few hundred segments.
    """
    both = points.join(segs, on)
    foot = geo.foot_on_segment(F.col("lat"), F.col("lng"), *[F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")])
    return both.withColumn("t", foot["t"]).withColumn("perp_m", foot["perp_m"]).withColumn("along_m", F.col("lo_m") + F.col("t") * F.col("long_m"))


#: Metres of the first ring of cells, how much wider the next one is, and beyond what a point meets its whole route.
RING_M, WIDER, FAR_M = 50.0, 8.0, 200_000.0


def project_nearest(points: DataFrame, segs: DataFrame) -> DataFrame:
    """id, perp_m, along_m, i of the nearest segment; the first of equals.

    Rings of cells: a point meets the segments within RING_M of it; where there
    are none it is asked again with a ring WIDER times as wide.  What a ring
    holds is nearer than all outside it, so a point with an answer is done.  ids
    are unique; a ring is written once, and its points are neither sorted nor grouped.
    """
    asked, ring, found = points.select("id", "route_id", "lat", "lng"), RING_M, None
    while ring <= FAR_M:
        got = checkpointed(nearest_of(near_lists(asked, segs, ring), ring, "perp_m", "i", "along_m", "heading"))
        done = got.where("m IS NOT NULL").select("id", "m")
        found = done if found is None else found.unionByName(done)
        asked = got.where("m IS NULL").drop("m")
        if asked.isEmpty():
            break
        ring *= WIDER
    else:
        found = found.unionByName(feet(asked, segs).groupBy("id").agg(F.min(F.struct("perp_m", "i", "along_m", "heading")).alias("m")))
    return found.select("id", "m.perp_m", "m.along_m", "m.i", F.col("m.heading").alias("seg_heading"))


def _spread(segs: DataFrame, size: float) -> DataFrame:
    """A row of a segment for each cell (ci, cj), size wide, of its box widened by as much."""
    wide = size / geo.M_PER_DEG
    far = F.greatest(F.abs("a_lat"), F.abs("b_lat")) + wide
    lngs = size / geo.m_per_deg_lng(far)
    rows = F.sequence(geo.cell_lat(F.least("a_lat", "b_lat") - wide, size), geo.cell_lat(F.greatest("a_lat", "b_lat") + wide, size))
    spread = segs.withColumn("ci", F.explode(rows))
    cols = F.sequence(geo.cell_lng(F.least("a_lng", "b_lng") - lngs, F.col("ci"), size), geo.cell_lng(F.greatest("a_lng", "b_lng") + lngs, F.col("ci"), size))
    return spread.withColumn("cj", F.explode(cols))


def _celled(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("ci", geo.cell_lat(F.col("lat"), size)).withColumn("cj", geo.cell_lng(F.col("lng"), F.col("ci"), size))


def near_lists(points: DataFrame, segs: DataFrame, tolerance_m: float) -> DataFrame:
    """points with ``near``: i, lo_m, hi_m, heading, perp_m and along_m of the segments of the same route whose cells hold the point.

    Those within tolerance_m are among them.  A cell's segments are one row, so
    a point meets one row at most and needs no grouping afterwards; near is null
    where its cell has none.
    """
    kx = geo.m_per_deg_lng(F.col("a_lat"))
    bx, by = (F.col("b_lng") - F.col("a_lng")) * kx, (F.col("b_lat") - F.col("a_lat")) * geo.M_PER_DEG
    flat = segs.withColumns({"kx": kx, "bx": bx, "by": by, "sq": bx * bx + by * by})
    held = F.struct("i", "lo_m", "hi_m", "long_m", "heading", "a_lat", "a_lng", "kx", "bx", "by", "sq")
    cells = _spread(flat.select("route_id", "a_lat", "a_lng", "b_lat", "b_lng", held.alias("s")), tolerance_m)
    cells = cells.groupBy("route_id", "ci", "cj").agg(F.collect_list("s").alias("cell"))
    both = _celled(points, tolerance_m).join(cells, ["route_id", "ci", "cj"], "left").drop("ci", "cj")
    # the same terms as geo.foot_on_segment, each worked out once
    placed = F.transform("cell", lambda s: F.struct(s.alias("s"), ((F.col("lng") - s["a_lng"]) * s["kx"]).alias("px"), ((F.col("lat") - s["a_lat"]) * geo.M_PER_DEG).alias("py")))
    t = lambda x: F.when(x["s"]["sq"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x["px"] * x["s"]["bx"] + x["py"] * x["s"]["by"]) / x["s"]["sq"]))).otherwise(0.0)
    timed = F.transform(placed, lambda x: F.struct(x["s"].alias("s"), x["px"].alias("px"), x["py"].alias("py"), t(x).alias("t")))
    off = F.transform(timed, lambda x: F.struct(x["s"].alias("s"), x["t"].alias("t"), (x["px"] - x["t"] * x["s"]["bx"]).alias("dx"), (x["py"] - x["t"] * x["s"]["by"]).alias("dy")))
    near = F.transform(
        off,
        lambda x: F.struct(
            *[x["s"][c].alias(c) for c in ("i", "lo_m", "hi_m", "heading")],
            F.sqrt(x["dx"] * x["dx"] + x["dy"] * x["dy"]).alias("perp_m"),
            (x["s"]["lo_m"] + x["t"] * x["s"]["long_m"]).alias("along_m"),
        ),
    )
    return both.withColumn("near", near).drop("cell")


def nearest_of(points: DataFrame, tolerance_m: float, *fields: str) -> DataFrame:
    """points of ``near_lists`` with ``m``, the least of these fields within tolerance_m, in place of near; null where there is none."""
    few = F.filter("near", lambda x: x["perp_m"] <= tolerance_m)
    return points.withColumn("m", F.array_min(F.transform(few, lambda x: F.struct(*[x[c].alias(c) for c in fields])))).drop("near")


def near_segments(points: DataFrame, segs: DataFrame, tolerance_m: float) -> DataFrame:
    """(point, segment) of the same route within tolerance_m, with perp_m and along_m.

    A segment is spread over the cells, tolerance_m wide, of its box widened by
    the tolerance, so only near pairs meet.
    """
    both = _celled(points, tolerance_m).join(_spread(segs, tolerance_m), ["route_id", "ci", "cj"])
    foot = geo.foot_on_segment(F.col("lat"), F.col("lng"), *[F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")])
    return both.withColumn("t", foot["t"]).withColumn("perp_m", foot["perp_m"]).withColumn("along_m", F.col("lo_m") + F.col("t") * F.col("long_m")).where(F.col("perp_m") <= tolerance_m)


def project_near_cells(points: DataFrame, segs: DataFrame, tolerance_m: float) -> DataFrame:
    """Like project_nearest where that is below tolerance_m; points farther away have no row."""
    got = nearest_of(near_lists(points, segs, tolerance_m), tolerance_m, "perp_m", "i", "along_m").where(F.col("m.perp_m") < tolerance_m)
    return got.select("id", "m.perp_m", "m.along_m", "m.i")


def project_window(points: DataFrame, segs: DataFrame, back_m: float, fwd_m: float, max_perp_m: float | None = None, max_turn_deg: float | None = None) -> DataFrame:
    """Nearest segment among those that meet [around - back, around + fwd].

    points: id, route_id, lat, lng, around_m (and heading for max_turn_deg).
    """
    named = segs.withColumnRenamed("heading", "seg_heading")
    if max_perp_m is None:  # by stretches of the route that the band touches
        stretch = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BAND_M), F.floor(hi / BAND_M)))
        asked = points.withColumn("stretch", stretch(F.col("around_m") - back_m, F.col("around_m") + fwd_m))
        got = feet(asked, named.withColumn("stretch", stretch(F.col("lo_m"), F.col("hi_m"))), ["route_id", "stretch"])
    else:  # by cells
        got = near_segments(points, named, max_perp_m)
    got = got.where((F.col("hi_m") >= F.col("around_m") - back_m) & (F.col("lo_m") <= F.col("around_m") + fwd_m))
    if max_turn_deg is not None:
        got = got.where(geo.bearing_diff_deg(F.col("seg_heading"), F.col("heading")) <= max_turn_deg)
    if max_perp_m is not None:
        got = got.where(F.col("perp_m") <= max_perp_m)
    best = got.groupBy("id").agg(F.min(F.struct("perp_m", "i", "along_m")).alias("m"))
    return best.select("id", "m.perp_m", "m.along_m", "m.i")


def project_unambiguous(points: DataFrame, segs: DataFrame, max_perp_m: float, max_turn_deg: float, gap_m: float, extent_m: float) -> DataFrame:
    """The nearest gated segment, where all gated ones form one cluster along the loop."""
    gated = near_segments(points, segs.withColumnRenamed("heading", "seg_heading"), max_perp_m).where((F.col("perp_m") <= max_perp_m) & (geo.bearing_diff_deg(F.col("seg_heading"), F.col("heading")) <= max_turn_deg))
    total = segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m"))
    w = Window.partitionBy("id").orderBy("along_m", "i")
    gaps = gated.join(total, "route_id").withColumn("gap", F.col("along_m") - F.lag("along_m").over(w))
    one = gaps.groupBy("id").agg(
        F.min(F.struct("perp_m", "i", "along_m")).alias("m"),
        F.coalesce(F.sum(F.when(F.col("gap") > gap_m, 1).otherwise(0)), F.lit(0)).alias("wide"),
        F.max("gap").alias("widest"),
        (F.min("along_m") + F.first("total_m") - F.max("along_m")).alias("wrap"),
        F.first("total_m").alias("total_m"),
    )
    extent = F.col("total_m") - F.greatest(F.coalesce("widest", F.lit(0.0)), F.col("wrap"))
    fine = (F.col("wide") + F.when(F.col("wrap") > gap_m, 1).otherwise(0) < 2) & (extent <= extent_m)
    return one.where(fine).select("id", "m.perp_m", "m.along_m", "m.i")


def curve_intervals(curve: DataFrame, key: str = "curve_id") -> DataFrame:
    """Pairs of neighbouring samples (d0, t0), (d1, t1) of each curve, by place."""
    w = Window.partitionBy(key).orderBy("k")
    return curve.select(
        key, F.lag("distance_m").over(w).alias("d0"), F.col("distance_m").alias("d1"), F.lag("time_s").over(w).alias("t0"), F.col("time_s").alias("t1")
    ).where("d0 IS NOT NULL")


def time_at(queries: DataFrame, curve: DataFrame, key: str = "curve_id", bucket_m: float = 500.0) -> DataFrame:
    """id, time_s of distances (id, curve_id, distance_m) on curves; clamped at both ends."""
    ends = curve.groupBy(key).agg(F.min(F.struct("distance_m", "time_s")).alias("a"), F.max(F.struct("distance_m", "time_s")).alias("z"))
    asked = queries.join(ends, key)
    x = F.col("distance_m")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    edge = F.when(odd | (x <= F.col("a.distance_m")), F.col("a.time_s")).when(x >= F.col("z.distance_m"), F.col("z.time_s"))
    flat = asked.withColumn("edge", edge)
    inner = interval_join(flat.where("edge IS NULL").select("id", key, "distance_m"), curve_intervals(curve, key), key, "distance_m", "d0", "d1", bucket_m)
    found = inner.select("id", interpolate(F.col("distance_m"), F.col("d0"), F.col("d1"), F.col("t0"), F.col("t1")).alias("time_s"))
    return flat.where("edge IS NOT NULL").select("id", F.col("edge").alias("time_s")).unionByName(found)


def distance_at(queries: DataFrame, curve: DataFrame, key: str = "curve_id", bucket_s: float = 300.0) -> DataFrame:
    """id, distance_m of times (id, curve_id, time_s): the first place reached by then."""
    ends = curve.groupBy(key).agg(F.min(F.struct("time_s", "distance_m")).alias("a"), F.max(F.struct("time_s", "distance_m")).alias("z"))
    asked = queries.join(ends, key)
    x = F.col("time_s")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    edge = F.when(odd | (x <= F.col("a.time_s")), F.col("a.distance_m")).when(x > F.col("z.time_s"), F.col("z.distance_m"))
    flat = asked.withColumn("edge", edge)
    pairs = curve_intervals(curve, key).where("t1 > t0")
    inner = interval_join(flat.where("edge IS NULL").select("id", key, "time_s"), pairs, key, "time_s", "t0", "t1", bucket_s)
    found = inner.select("id", interpolate(F.col("time_s"), F.col("t0"), F.col("t1"), F.col("d0"), F.col("d1")).alias("distance_m"))
    return flat.where("edge IS NOT NULL").select("id", F.col("edge").alias("distance_m")).unionByName(found)


def sample_at(queries: DataFrame, segs: DataFrame, bucket_m: float = 500.0) -> DataFrame:
    """id, lat, lng, heading at a distance along a route (id, route_id, distance_m); clamped."""
    total = segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m"))
    inside = queries.join(total, "route_id").withColumn("at_m", F.least("total_m", F.greatest(F.lit(0.0), F.col("distance_m"))))
    got = interval_join(inside, segs, "route_id", "at_m", "lo_m", "hi_m", bucket_m, "both")
    first = got.groupBy("id").agg(F.min_by(F.struct("at_m", "lo_m", "hi_m", "a_lat", "b_lat", "a_lng", "b_lng", "heading"), "i").alias("s"))
    f = F.when(F.col("s.hi_m") > F.col("s.lo_m"), (F.col("s.at_m") - F.col("s.lo_m")) / (F.col("s.hi_m") - F.col("s.lo_m"))).otherwise(0.0)
    return first.select(
        "id",
        (F.col("s.a_lat") + f * (F.col("s.b_lat") - F.col("s.a_lat"))).alias("lat"),
        (F.col("s.a_lng") + f * (F.col("s.b_lng") - F.col("s.a_lng"))).alias("lng"),
        F.col("s.heading").alias("heading"),
    )
