"""Route models: coverage, node grid, segments, stitched curve and overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.functions.formats import mmss
from paceline.operators import joins
from paceline.operators.joins import sample_at
from paceline.operators.road_pace import celled, in_order, seeded_mean
from paceline.sources.rides import checkpointed

STEP_M = 25.0
MIN_SEG_M = 300.0
MAX_SPEED = 30.0
BEST_SPEEDUP = 2.0
MIN_LAPS = 2
COVERAGE_MIN = 0.10
#: Metres of a route that are one key where overlays meet what they cover.
STRETCH_M = 5000.0


def grid(segs: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """Nodes of each route every step_m: id, route_id, k, distance_m, lat, lng, heading."""
    total = segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m"))
    nodes = total.select("route_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("total_m") / step_m).cast("int"))).alias("k"))
    asked = nodes.select(F.concat_ws(":", "route_id", "k").alias("id"), "route_id", "k", (F.col("k") * step_m).alias("distance_m"))
    return asked.join(sample_at(asked.select("id", "route_id", "distance_m"), segs), "id")


def node_paces(nodes: DataFrame, samples: DataFrame, tracks: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """route_id, k, dt_s, count, min_dt_s, last_dt_s of nodes with history.

    A node meets the samples of its nine cells; within 18 m and 45 degrees each
    ride gives its nearest sample, oldest ride first.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = nodes.where("k > 0").select("*", around.alias("o"))
    row = geo.cell_lat(F.col("lat")) + F.col("o.i")
    asked = asked.select(
        "route_id", "k", F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"), F.col("heading").alias("n_heading"), row.alias("ci"), (geo.cell_lng(F.col("lng"), row) + F.col("o.j")).alias("cj")
    )
    keyed = celled(samples.select("track_id", "seq", "sub", "lat", "lng", "heading", "tpm"))
    dist = geo.haversine_m(F.col("n_lat"), F.col("n_lng"), F.col("lat"), F.col("lng"))
    near = asked.join(keyed, ["ci", "cj"]).withColumn("dist", F.round(dist, 6))
    near = near.where((F.col("dist") <= geo.MATCH_RADIUS_M) & (geo.bearing_diff_deg(F.col("heading"), F.col("n_heading")) <= 45))
    nearest = near.groupBy("route_id", "k", "track_id").agg(F.min_by("tpm", F.struct("dist", "seq", "sub")).alias("tpm"))
    timed = nearest.join(tracks.select("track_id", "started_ms"), "track_id")
    placed = in_order(timed, ["route_id", "k"], F.struct("started_ms", "track_id"))
    out = placed.groupBy("route_id", "k").agg(seeded_mean("tpm").alias("ema"), F.min("tpm").alias("min"), F.max_by("tpm", "place").alias("last"), F.count("*").alias("count"))
    return out.select("route_id", "k", (step_m * F.col("ema")).alias("dt_s"), "count", (step_m * F.col("min")).alias("min_dt_s"), (step_m * F.col("last")).alias("last_dt_s"))


def node_delta(how: str) -> Column:
    if how == "BEST":
        return F.greatest("min_dt_s", F.col("dt_s") / BEST_SPEEDUP)
    if how == "LAST":
        return F.col("last_dt_s")
    return F.when(F.col("count") >= MIN_LAPS, F.col("dt_s")).otherwise(F.col("last_dt_s"))


def segments_of_nodes(nodes: DataFrame, how: str = "AVERAGE", min_seg_m: float = MIN_SEG_M, step_m: float = STEP_M) -> DataFrame:
    """route_id, start_m, end_m, time_s, curve: runs of nodes with history.

    A run starts one node before its first; curve is the samples (d, t) from there.
    """
    w = Window.partitionBy("route_id").orderBy("k")
    runs = nodes.where("count >= 1 AND k >= 1").withColumn("run", F.col("k") - F.row_number().over(w)).withColumn("delta", node_delta(how))
    in_run = Window.partitionBy("route_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cum = runs.withColumn("t", F.sum("delta").over(in_run))
    out = cum.groupBy("route_id", "run").agg(
        ((F.min("k") - 1) * step_m).alias("start_m"),
        (F.max("k") * step_m).alias("end_m"),
        F.max("t").alias("time_s"),
        F.array_sort(F.collect_list(F.struct(((F.col("k") - F.col("run") - 1) * step_m).alias("d"), F.col("t").alias("t")))).alias("curve"),
    )
    long = F.col("end_m") - F.col("start_m")
    kept = out.where((long >= min_seg_m) & (F.col("time_s") > 0)).where(long / F.col("time_s") <= MAX_SPEED)
    first = F.col("curve")[0]["d"]
    based = F.concat(F.array(F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("t"))), F.transform("curve", lambda s: F.struct((s["d"] - first + step_m).alias("d"), s["t"].alias("t"))))
    return kept.select("route_id", "start_m", "end_m", "time_s", based.alias("curve"))


def coverage(nodes: DataFrame, totals: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """route_id, coverage: share of the route's metres whose step starts on history.

    nodes: route_id, distance_m, hit; the last step counts its true length.
    """
    part = F.when(F.col("hit"), F.least(F.lit(step_m), F.greatest(F.lit(0.0), F.col("total_m") - F.col("distance_m")))).otherwise(0.0)
    both = nodes.join(totals, "route_id")
    return both.groupBy("route_id").agg(F.coalesce(F.try_divide(F.sum(part), F.first("total_m")), F.lit(0.0)).alias("coverage"))


def comparator(share: Column, grade_usable: Column) -> Column:
    """TARGET when neither the gradient model nor a tenth of the route can answer."""
    sane = F.when(share.isNull() | F.isnan(share) | (F.abs(share) == float("inf")), 0.0).otherwise(share)
    return F.when(~grade_usable & (sane < COVERAGE_MIN), "TARGET").otherwise("HISTORY")


def race_pace(kind: Column, verdict: Column, target_ms: Column, road: Column, grade: Column) -> Column:
    """The tier that answers a trusted tick: target, else road, else gradient, else none."""
    return F.when(verdict, F.when(kind == "TARGET", 1 / target_ms).otherwise(F.coalesce(road, grade)))


def stitched_curve(segs: DataFrame, totals: DataFrame, fill_ms: float) -> DataFrame:
    """route_id, k, distance_m, time_s: one curve a route from its segments.

    Segments are clamped to what lies before them, gaps are ridden at fill_ms,
    the inner samples are scaled to the stretch, and a segment above 30 m/s is
    replaced by the fill.  segs: route_id, start_m, end_m, time_s, curve.
    """
    w = Window.partitionBy("route_id").orderBy("start_m", "end_m")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fine = segs.where("end_m > start_m").join(totals, "route_id")
    clamped = fine.withColumn("a", F.least("total_m", F.greatest(F.col("start_m"), F.coalesce(F.max("end_m").over(before), F.lit(0.0))))).withColumn("z", F.least("end_m", "total_m")).where("z > a")
    spans = clamped.withColumn("gap_m", F.col("a") - F.coalesce(F.lag("z").over(w), F.lit(0.0))).withColumn("span", F.col("z") - F.col("a"))
    fast = (F.col("time_s") <= 0) | (F.col("span") / F.col("time_s") > MAX_SPEED)
    timed = spans.withColumn("use_s", F.when(fast, F.col("span") / fill_ms).otherwise(F.col("time_s"))).withColumn("fast", fast)
    cum = timed.withColumn("end_s", F.sum(F.col("gap_m") / fill_ms + F.col("use_s")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start_s", F.col("end_s") - F.col("use_s"))
    long = F.element_at("curve", -1)["d"]
    inner = F.transform(
        F.filter("curve", lambda s: (s["d"] > 0) & (s["d"] < long) & ~F.col("fast")),
        lambda s: F.struct((F.col("a") + s["d"] * (F.col("span") / long)).alias("d"), (F.col("start_s") + s["t"]).alias("t")),
    )
    own = cum.select("route_id", F.concat(F.array(F.struct(F.col("a").alias("d"), F.col("start_s").alias("t"))), inner, F.array(F.struct(F.col("z").alias("d"), F.col("end_s").alias("t")))).alias("s"))
    last = totals.join(cum.groupBy("route_id").agg(F.max("z").alias("z"), F.max("end_s").alias("t")), "route_id", "left").select(
        "route_id", F.col("total_m").alias("d"), (F.coalesce("t", F.lit(0.0)) + (F.col("total_m") - F.coalesce("z", F.lit(0.0))) / fill_ms).alias("t")
    )
    start = totals.select("route_id", F.lit(0.0).alias("d"), F.lit(0.0).alias("t"))
    every = own.select("route_id", F.explode("s").alias("s")).select("route_id", "s.d", "s.t").unionByName(start).unionByName(last)
    one = every.groupBy("route_id", "d").agg(F.min("t").alias("t"))
    return one.select("route_id", F.row_number().over(Window.partitionBy("route_id").orderBy("d")).alias("k"), F.col("d").alias("distance_m"), F.col("t").alias("time_s"))


def uncovered(secondary: DataFrame, primary: DataFrame, min_piece_m: float = 200.0) -> DataFrame:
    """route_id, start_m, end_m, piece_start_m, piece_end_m: what primary leaves of
    each secondary segment, pieces of min_piece_m or more.

    Primary segments that overlap count as one, and those meet secondary ones by
    stretches of the route, so rows grow with the input and not with its pairs.
    """
    w = Window.partitionBy("route_id").orderBy("start_m")
    starts = primary.groupBy("route_id", "start_m").agg(F.max("end_m").alias("end_m"))
    upto = F.max("end_m").over(w.rowsBetween(Window.unboundedPreceding, -1))
    groups = starts.withColumn("g", F.when(upto.isNull() | (F.col("start_m") >= upto), 1).otherwise(0)).withColumn("g", F.sum("g").over(w))
    p = groups.groupBy("route_id", "g").agg(F.min("start_m").alias("p0"), F.max("end_m").alias("p1"))
    at = lambda c: F.floor(F.col(c) / STRETCH_M)
    spread = lambda rows, lo, hi: rows.withColumn("stretch", F.explode(F.sequence(at(lo), F.greatest(at(lo), at(hi)))))
    key = ["route_id", "start_m", "end_m"]
    both = spread(secondary.select(key).distinct(), "start_m", "end_m").join(spread(p, "p0", "p1"), ["route_id", "stretch"])
    first = F.col("stretch") == F.greatest(at("start_m"), at("p0"))  # a pair meets in each stretch of both
    hit = checkpointed(both.where((F.col("p1") > F.col("start_m")) & (F.col("p0") < F.col("end_m")) & first).select(*key, "p0", "p1"))
    none = secondary.join(hit.select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(*key).orderBy("p0", "p1")
    until = F.greatest("start_m", F.coalesce(F.max("p1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_m")))
    before = hit.select(*key, until.alias("a"), F.least("p0", "end_m").alias("z"))
    after = hit.groupBy(*key).agg(F.max("p1").alias("a")).select(*key, "a", F.col("end_m").alias("z"))
    whole = none.select(*key, F.col("start_m").alias("a"), F.col("end_m").alias("z"))
    every = before.unionByName(after).unionByName(whole)
    return every.where(F.col("z") - F.col("a") >= min_piece_m).select(*key, F.col("a").alias("piece_start_m"), F.col("z").alias("piece_end_m"))


def overlay(primary: DataFrame, secondary: DataFrame, min_piece_m: float = 200.0) -> DataFrame:
    """Primary segments, and of each secondary one what primary leaves of it, cut along its curve.

    Segments: seg_id, route_id, start_m, end_m, label, curve (array of d, t,
    rising from 0).  A piece's curve starts at 0 metres and 0 seconds; both cuts
    are looked up on the segment's curve, whose metres are scaled to the route's,
    and times never fall.  Its label has its own time.  A segment that no primary
    one touches stays as it is; pieces shorter than min_piece_m, and those that
    take no time, are dropped.
    """
    kind = [c for c in primary.columns if c in ("seg_id", "route_id", "start_m", "end_m", "label", "curve")]
    pieces = uncovered(secondary.select("route_id", "start_m", "end_m").distinct(), primary, min_piece_m)
    cut = checkpointed(secondary.join(pieces, ["route_id", "start_m", "end_m"]))
    whole = (F.col("piece_start_m") <= F.col("start_m")) & (F.col("piece_end_m") >= F.col("end_m"))
    kept = cut.where(whole).select(kind)
    long = F.element_at("curve", -1)["d"]
    scale = long / (F.col("end_m") - F.col("start_m"))
    parts = cut.where(~whole).withColumns({"d0": (F.col("piece_start_m") - F.col("start_m")) * scale, "d1": (F.col("piece_end_m") - F.col("start_m")) * scale})
    parts = parts.withColumn("id", F.concat_ws(":", "seg_id", "piece_start_m"))
    curves = parts.dropDuplicates(["seg_id"]).select(F.col("seg_id").alias("curve_id"), F.posexplode("curve").alias("k", "s")).select("curve_id", "k", F.col("s.d").alias("distance_m"), F.col("s.t").alias("time_s"))
    asked = lambda at, name: joins.time_at(parts.select("id", F.col("seg_id").alias("curve_id"), F.col(at).alias("distance_m")), curves).withColumnRenamed("time_s", name)
    timed = parts.join(asked("d0", "t0"), "id").join(asked("d1", "t1"), "id")
    inner = timed.select("id", "d0", "d1", "t0", "t1", F.explode("curve").alias("s")).where((F.col("s.d") > F.col("d0")) & (F.col("s.d") < F.col("d1")))
    ends = timed.select("id", F.explode(F.array(F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("t")), F.struct((F.col("d1") - F.col("d0")).alias("d"), (F.col("t1") - F.col("t0")).alias("t")))).alias("s")).select("id", "s.d", "s.t")
    every = inner.select("id", (F.col("s.d") - F.col("d0")).alias("d"), (F.col("s.t") - F.col("t0")).alias("t")).unionByName(ends)
    upto = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    risen = every.groupBy("id", "d").agg(F.min("t").alias("t")).select("id", "d", F.greatest(F.lit(0.0), F.max("t").over(upto)).alias("t"))
    based = risen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "t"))).alias("curve"))
    lasts = F.element_at("curve", -1)["t"]
    label = F.concat(F.regexp_replace("label", " [^ ]*$", ""), F.lit(" "), mmss(lasts))
    trimmed = timed.drop("curve").join(based, "id").where(lasts > 0).withColumn("label", label)
    trimmed = trimmed.select(*[F.col({"start_m": "piece_start_m", "end_m": "piece_end_m"}.get(c, c)).alias(c) for c in kind])
    return primary.select(kind).unionByName(kept).unionByName(trimmed)


def overlap_groups(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """intervals with ``group``: transitively overlapping ones; touching counts."""
    w = Window.partitionBy(key).orderBy(start, end)
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(upto.isNull() | (F.col(start) > upto), 1).otherwise(0)
    return intervals.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(w)).drop("fresh")


def covered_runs(nodes: DataFrame, merge_gap_m: float = 80.0, min_m: float = MIN_SEG_M) -> DataFrame:
    """route_id, start_m, end_m of runs of hit nodes, small gaps merged, short runs dropped."""
    w = Window.partitionBy("route_id").orderBy("k")
    runs = nodes.where("hit").withColumn("run", F.col("k") - F.row_number().over(w)).groupBy("route_id", "run").agg(F.min("distance_m").alias("a"), F.max("distance_m").alias("z"))
    by = Window.partitionBy("route_id").orderBy("a")
    fresh = F.when(F.coalesce(F.col("a") - F.lag("z").over(by) >= merge_gap_m, F.lit(True)), 1).otherwise(0)
    merged = runs.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(by)).groupBy("route_id", "g").agg(F.min("a").alias("start_m"), F.max("z").alias("end_m"))
    return merged.where(F.col("end_m") - F.col("start_m") >= min_m).select("route_id", "start_m", "end_m")
