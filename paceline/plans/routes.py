"""Queries about routes: places on them, projections, node grids and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import formats, geo
from paceline.operators import grade, joins, laps, road_pace, route, samples
from paceline.plans import _sql
from paceline.plans.pace import rounded
from paceline.sources import polyline, rides

QUERIES = {}
ORACLE_SQL = {}

#: Six routes along the roads; odd ones come back beside the way out.
_X = "CASE WHEN r % 2 = 1 AND i > 12 THEN 500 + (24 - i) * 150 ELSE 500 + i * 150 END"
_MM, _SIDE = f"(({_X}) * 1000)", "CASE WHEN r % 2 = 1 AND i > 12 THEN 3000 ELSE 0 END"
_ROADS = f"vertices AS (SELECT r AS route_id, i, {rides.lat_of('r', _MM, '//', _SIDE)} AS lat, {rides.lng_of('r', _MM)} AS lng FROM (SELECT unnest(range(0, 6)) AS r), (SELECT unnest(range(0, 25)) AS i))"
#: The same for the paths of all rides as routes.
_PATHS = "vertices AS (SELECT track_id AS route_id, seq AS i, lat, lng FROM points)"
_SEGS = f"""
v1 AS (SELECT route_id, i, lat AS a_lat, lng AS a_lng, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng FROM vertices WINDOW w AS (PARTITION BY route_id ORDER BY i)),
v2 AS (SELECT *, {_sql.hav('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS long_m, {_sql.bearing('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS seg_heading FROM v1 WHERE b_lat IS NOT NULL),
v3 AS (SELECT *, sum(long_m) OVER (PARTITION BY route_id ORDER BY i) AS hi_m FROM v2),
segs AS (SELECT *, hi_m - long_m AS lo_m FROM v3),
totals AS (SELECT route_id, max(hi_m) AS total_m FROM segs GROUP BY route_id)
"""
VERTICES = f"{_ROADS},{_SEGS}"
PATHS = f"{_PATHS},{_SEGS}"
_BX, _BY = "((b_lng - a_lng) * kx)", "((b_lat - a_lat) * 111320.0::DOUBLE)"
_PX, _PY = "((p.lng - a_lng) * kx)", "((p.lat - a_lat) * 111320.0::DOUBLE)"
FEET = f"""
asked AS (SELECT track_id || ':' || seq AS id, track_id % 6 AS route_id, lat, lng, distance_m AS around_m, heading FROM steps),
f0 AS (SELECT p.id, p.heading, p.around_m, s.*, greatest(1.0::DOUBLE, 111320.0::DOUBLE * cos(radians(a_lat))) AS kx, p.lat, p.lng FROM asked p JOIN segs s USING (route_id)),
f1 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_PX.replace('p.', '')} * {_BX} + {_PY.replace('p.', '')} * {_BY}) / ({_BX} ** 2 + {_BY} ** 2))) AS t FROM f0),
feet AS (SELECT *, sqrt(({_PX.replace('p.', '')} - t * {_BX}) ** 2 + ({_PY.replace('p.', '')} - t * {_BY}) ** 2) AS perp_m, lo_m + t * long_m AS along_m FROM f1)
"""
_BEST = "SELECT id, round(perp_m, 3) AS perp_m, round(along_m, 2) AS along_m, i FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY perp_m, i) AS rn FROM feet WHERE {}) WHERE rn = 1"


def query(sql: str | None = None, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


def routes(spark: SparkSession) -> DataFrame:
    base = spark.range(6).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    return base.select(F.col("r").alias("route_id"), "i", F.expr(rides.lat_of("r", _MM, "div", _SIDE)).alias("lat"), F.expr(rides.lng_of("r", _MM)).alias("lng"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all rides as routes."""
    return rides.points(spark, sf_dir).select(F.col("track_id").alias("route_id"), F.col("seq").alias("i"), "lat", "lng")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = samples.deltas(rides.points(spark, sf_dir))
    return steps.select(F.concat_ws(":", "track_id", "seq").alias("id"), (F.col("track_id") % 6).alias("route_id"), "lat", "lng", F.col("distance_m").alias("around_m"), "heading")


def _plain(asked: DataFrame) -> DataFrame:
    return asked.select("id", "route_id", "lat", "lng")


@query("SELECT route_id, i, round(lo_m, 3) AS lo_m, round(hi_m, 3) AS hi_m, round(seg_heading, 3) AS heading FROM segs", PATHS)
def route_segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of all rides' paths."""
    return rounded(joins.segments(paths(spark, sf_dir)).select("route_id", "i", "lo_m", "hi_m", "heading"), lo_m=3, hi_m=3, heading=3)


@query("SELECT track_id::VARCHAR AS route_id, (row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1)::INT AS i, round(floor(lat * 100000 + 0.5) / 100000, 5) AS lat, round(floor(lng * 100000 + 0.5) / 100000, 5) AS lng FROM points")
def polyline_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rides' paths encoded as polylines, and decoded again."""
    return rounded(polyline.vertices(polyline.encoded(paths(spark, sf_dir))), lat=5, lng=5)


_AT = """
qs AS (SELECT route_id, d, least(total_m, greatest(0, d * 37.5::DOUBLE)) AS at_m FROM totals, (SELECT unnest(range(-1, 110)) AS d)),
at0 AS (SELECT q.route_id, d, at_m, s.*, row_number() OVER (PARTITION BY q.route_id, d ORDER BY s.i) AS rn FROM qs q JOIN (SELECT * RENAME (route_id AS sr) FROM segs) s ON sr = q.route_id AND at_m >= lo_m AND at_m <= hi_m)
"""


@query(
    "SELECT route_id || ':' || d AS id, round(a_lat + (at_m - lo_m) / (hi_m - lo_m) * (b_lat - a_lat), 8) AS lat, round(a_lng + (at_m - lo_m) / (hi_m - lo_m) * (b_lng - a_lng), 8) AS lng, round(seg_heading, 3) AS heading FROM at0 WHERE rn = 1",
    PATHS,
    _AT,
)
def path_sample_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places every 37.5 m along all rides' paths, from before the start to beyond most ends."""
    path = paths(spark, sf_dir)
    asked = path.groupBy("route_id").count().where("count > 1").select("route_id", F.explode(F.sequence(F.lit(-1), F.lit(109))).alias("d"))
    asked = asked.select(F.concat_ws(":", "route_id", "d").alias("id"), "route_id", (F.col("d") * 37.5).alias("distance_m"))
    return rounded(joins.sample_at(asked, joins.segments(path)), lat=8, lng=8, heading=3)


@query(_BEST.format("true"), _sql.STEPS, VERTICES, FEET)
def project_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, _asked(spark, sf_dir))


def _nearest(spark: SparkSession, asked: DataFrame) -> DataFrame:
    got = joins.project_nearest(_plain(asked), joins.segments(routes(spark)))
    return rounded(got.select("id", "perp_m", "along_m", "i"), perp_m=3, along_m=2)


@query(_BEST.format("perp_m < 35"), _sql.STEPS, VERTICES, FEET)
def project_near_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_cells(spark, _asked(spark, sf_dir))


def _near_cells(spark: SparkSession, asked: DataFrame) -> DataFrame:
    return rounded(joins.project_near_cells(_plain(asked), joins.segments(routes(spark)), 35.0), perp_m=3, along_m=2)


_IN_WINDOW = "hi_m >= around_m - 120 AND lo_m <= around_m + 300"


@query(_BEST.format(_IN_WINDOW), _sql.STEPS, VERTICES, FEET)
def project_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, _asked(spark, sf_dir))


def _window(spark: SparkSession, asked: DataFrame) -> DataFrame:
    return rounded(joins.project_window(asked.drop("heading"), joins.segments(routes(spark)), 120, 300), perp_m=3, along_m=2)


@query(_BEST.format(f"{_IN_WINDOW} AND {_sql.turn('seg_heading', 'heading')} <= 45 AND perp_m <= 40"), _sql.STEPS, VERTICES, FEET)
def project_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heading(spark, _asked(spark, sf_dir))


def _heading(spark: SparkSession, asked: DataFrame) -> DataFrame:
    return rounded(joins.project_window(asked, joins.segments(routes(spark)), 120, 300, 40, 45), perp_m=3, along_m=2)


_CLUSTER = f"""
gated AS (SELECT *, along_m - lag(along_m) OVER (PARTITION BY id ORDER BY along_m, i) AS gap FROM feet WHERE {_sql.turn('seg_heading', 'heading')} <= 45 AND perp_m <= 40),
clusters AS (SELECT id, arg_min(perp_m, (perp_m, i)) AS perp_m, arg_min(along_m, (perp_m, i)) AS along_m, arg_min(i, (perp_m, i)) AS i, coalesce(sum((gap > 75)::INT), 0) AS wide,
             coalesce(max(gap), 0) AS widest, min(along_m) + any_value(total_m) - max(along_m) AS wrap, any_value(total_m) AS total_m FROM gated JOIN totals USING (route_id) GROUP BY id)
"""


_ONE_PLACE = "SELECT id, round(perp_m, 3) AS perp_m, round(along_m, 2) AS along_m, i FROM clusters WHERE wide + (wrap > 75)::INT < 2 AND total_m - greatest(widest, wrap) <= 200"


@query(_ONE_PLACE, _sql.STEPS, VERTICES, FEET, _CLUSTER)
def project_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unambiguous(spark, _asked(spark, sf_dir))


def _unambiguous(spark: SparkSession, asked: DataFrame) -> DataFrame:
    got = joins.project_unambiguous(asked.drop("around_m"), joins.segments(routes(spark)), 40, 45, 75, 200)
    return rounded(got, perp_m=3, along_m=2)


_ASOF = "asked AS (SELECT track_id, k, k * 113.7::DOUBLE AS d, k * 47.3::DOUBLE AS t FROM tracks, (SELECT unnest(range(0, 30)) AS k))"


def _curves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pts = rides.points(spark, sf_dir)
    asked = pts.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    return asked.withColumn("id", F.concat_ws(":", "track_id", "k")), pts.select(F.col("track_id").alias("curve_id"), F.col("seq").alias("k"), "distance_m", "time_s")


@query(
    "SELECT a.track_id || ':' || k AS id, round(CASE WHEN n.seq IS NULL THEN m.time_s WHEN b.distance_m = a.d THEN b.time_s ELSE b.time_s + (a.d - b.distance_m) / (n.distance_m - b.distance_m) * (n.time_s - b.time_s) END, 4) AS time_s"
    " FROM asked a ASOF JOIN points b ON a.track_id = b.track_id AND a.d >= b.distance_m LEFT JOIN points n ON n.track_id = b.track_id AND n.seq = b.seq + 1"
    " JOIN (SELECT track_id, max(time_s) AS time_s FROM points GROUP BY track_id) m ON m.track_id = a.track_id",
    _ASOF,
)
def curve_time_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, curve = _curves(spark, sf_dir)
    return rounded(joins.time_at(asked.select("id", F.col("track_id").alias("curve_id"), (F.col("k") * 113.7).alias("distance_m")), curve), time_s=4)


@query(
    "SELECT a.track_id || ':' || k AS id, round(CASE WHEN n.seq IS NULL THEN m.distance_m ELSE b.distance_m + (a.t - b.time_s) / (n.time_s - b.time_s) * (n.distance_m - b.distance_m) END, 4) AS distance_m"
    " FROM asked a ASOF JOIN points b ON a.track_id = b.track_id AND a.t >= b.time_s LEFT JOIN points n ON n.track_id = b.track_id AND n.seq = b.seq + 1"
    " JOIN (SELECT track_id, max(distance_m) AS distance_m FROM points GROUP BY track_id) m ON m.track_id = a.track_id",
    _ASOF,
)
def curve_distance_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, curve = _curves(spark, sf_dir)
    return rounded(joins.distance_at(asked.select("id", F.col("track_id").alias("curve_id"), (F.col("k") * 47.3).alias("time_s")), curve), distance_m=4)


#: The route grid: node k of each route at 25 k metres.
GRID = """
g0 AS (SELECT route_id, k, k * 25.0::DOUBLE AS distance_m FROM totals, LATERAL (SELECT unnest(range(0, floor(total_m / 25)::INT + 1)) AS k)),
g1 AS (SELECT g.route_id, g.k, g.distance_m, s.*, row_number() OVER (PARTITION BY g.route_id, g.k ORDER BY s.i) AS rn
       FROM g0 g JOIN (SELECT * RENAME (route_id AS sr) FROM segs) s ON sr = g.route_id AND distance_m >= lo_m AND distance_m <= hi_m),
nodes AS (SELECT route_id, k, distance_m, a_lat + (distance_m - lo_m) / (hi_m - lo_m) * (b_lat - a_lat) AS lat, a_lng + (distance_m - lo_m) / (hi_m - lo_m) * (b_lng - a_lng) AS lng, seg_heading AS heading FROM g1 WHERE rn = 1)
"""
NODE_PACES = f"""
n0 AS (SELECT n.route_id, n.k, s.track_id, s.seq, s.sub, s.tpm, round({_sql.hav('n.lat', 'n.lng', 's.lat', 's.lng')}, 6) AS dist
       FROM nodes n JOIN samples s ON abs(n.lat - s.lat) < 0.0003 AND abs(n.lng - s.lng) < 0.001 WHERE n.k > 0 AND {_sql.turn('s.heading', 'n.heading')} <= 45),
n1 AS (SELECT route_id, k, track_id, tpm, started_ms FROM n0 JOIN tracks USING (track_id) WHERE dist <= 18 QUALIFY row_number() OVER (PARTITION BY route_id, k, track_id ORDER BY dist, seq, sub) = 1),
n2 AS (SELECT *, row_number() OVER (PARTITION BY route_id, k ORDER BY started_ms, track_id) AS o, count(*) OVER (PARTITION BY route_id, k) AS n FROM n1),
n3 AS (SELECT route_id, k, o, n, tpm AS e FROM n2 WHERE o = 1
       UNION ALL SELECT a.route_id, a.k, a.o, a.n, CASE WHEN b.o < 4 THEN (b.e * b.o + a.tpm) / (b.o + 1) ELSE 0.25::DOUBLE * a.tpm + 0.75::DOUBLE * b.e END FROM n3 b JOIN n2 a ON a.route_id = b.route_id AND a.k = b.k AND a.o = b.o + 1),
node_paces AS (SELECT g.route_id, g.k, 25 * e AS dt_s, count, 25 * min AS min_dt_s, 25 * last AS last_dt_s
               FROM (SELECT route_id, k, min(tpm) AS min, arg_max(tpm, o) AS last, count(*) AS count FROM n2 GROUP BY ALL) g JOIN n3 ON g.route_id = n3.route_id AND g.k = n3.k AND n3.o = n3.n)
"""


def _node_paces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pts = rides.points(spark, sf_dir)
    segs = joins.segments(routes(spark))
    grid = route.grid(segs)
    return segs, grid, route.node_paces(grid, samples.pace_samples(pts), rides.tracks_of(pts))


@query("SELECT route_id, k, round(lat, 8) AS lat, round(lng, 8) AS lng FROM nodes", PATHS, GRID)
def route_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes every 25 m along all rides' paths."""
    return rounded(route.grid(joins.segments(paths(spark, sf_dir))).select("route_id", "k", "lat", "lng"), lat=8, lng=8)


@query("SELECT route_id, k, round(dt_s, 4) AS dt_s, count, round(min_dt_s, 4) AS min_dt_s, round(last_dt_s, 4) AS last_dt_s FROM node_paces", _sql.STEPS, VERTICES, GRID, NODE_PACES)
def route_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_node_paces(spark, sf_dir)[2], dt_s=4, min_dt_s=4, last_dt_s=4)


RUNS = """
q0 AS (SELECT *, k - row_number() OVER (PARTITION BY route_id ORDER BY k) AS run FROM node_paces),
q1 AS (SELECT route_id, (min(k) - 1) * 25.0::DOUBLE AS start_m, max(k) * 25.0::DOUBLE AS end_m, sum(CASE WHEN count >= 2 THEN dt_s ELSE last_dt_s END) AS time_s FROM q0 GROUP BY route_id, run),
runs AS (SELECT * FROM q1 WHERE end_m - start_m >= 300 AND (end_m - start_m) / time_s <= 30)
"""


_RUN_ROWS = "SELECT route_id, start_m, end_m, round(time_s, 3) AS time_s FROM runs"


@query(_RUN_ROWS, _sql.STEPS, VERTICES, GRID, NODE_PACES, RUNS)
def route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the node grid."""
    return _segments(_node_paces(spark, sf_dir)[2])


def _segments(nodes: DataFrame) -> DataFrame:
    return rounded(route.segments_of_nodes(nodes).select("route_id", "start_m", "end_m", "time_s"), time_s=3)


_STITCHED = """
rn AS (SELECT q.route_id, q.run, (min(k) - 1) * 25.0::DOUBLE AS start_m, max(k) * 25.0::DOUBLE AS end_m FROM q0 q GROUP BY q.route_id, q.run),
rs AS (SELECT r.*, n.run, coalesce(sum(r.time_s) OVER w, 0) + (r.start_m - coalesce(sum(r.end_m - r.start_m) OVER w, 0)) / 5.0::DOUBLE AS start_s FROM runs r JOIN rn n USING (route_id, start_m, end_m) WINDOW w AS (PARTITION BY route_id ORDER BY start_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cv AS (SELECT route_id, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t FROM totals UNION ALL SELECT route_id, start_m, start_s FROM rs
       UNION ALL SELECT rs.route_id, k * 25.0::DOUBLE, start_s + sum(CASE WHEN count >= 2 THEN dt_s ELSE last_dt_s END) OVER (PARTITION BY rs.route_id, rs.run ORDER BY k) FROM rs JOIN q0 USING (route_id, run)
       UNION ALL SELECT route_id, total_m, coalesce(s.t, 0) + (total_m - coalesce(s.d, 0)) / 5.0::DOUBLE FROM totals LEFT JOIN (SELECT route_id, sum(end_m - start_m) AS d, sum(time_s) AS t FROM runs GROUP BY route_id) s USING (route_id))
"""


@query("SELECT route_id, (row_number() OVER (PARTITION BY route_id ORDER BY d))::INT AS k, round(d, 3) AS distance_m, round(t, 3) AS time_s FROM (SELECT route_id, d, min(t) AS t FROM cv GROUP BY ALL)", _sql.STEPS, VERTICES, GRID, NODE_PACES, RUNS, _STITCHED)
def route_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route's stitched curve, gaps ridden at 5 m/s."""
    segs, _, nodes = _node_paces(spark, sf_dir)
    total = segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m"))
    return rounded(route.stitched_curve(route.segments_of_nodes(nodes), total, 5.0), distance_m=3, time_s=3)


HITS = f"""
hits AS (SELECT n.*, EXISTS (SELECT 1 FROM (SELECT DISTINCT ci, cj, bin FROM cells) c WHERE c.ci = {_sql.row('n.lat')} AND c.cj = {_sql.col('n.lng', _sql.row('n.lat'))} AND c.bin = least(7, floor({_sql.pmod('n.heading')} / 45.0))) AS hit FROM nodes n),
cover AS (SELECT route_id, sum(CASE WHEN hit THEN least(25, greatest(0, total_m - distance_m)) ELSE 0 END) / any_value(total_m) AS coverage FROM hits JOIN totals USING (route_id) GROUP BY route_id)
"""

def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Length of each route, and its nodes with whether they lie on a cell of any ride."""
    pts = rides.points(spark, sf_dir)
    segs = joins.segments(routes(spark))
    road = road_pace.cells(samples.pace_samples(pts)).select("ci", "cj", "bin").distinct().withColumn("known", F.lit(True))
    keyed = road_pace.celled(route.grid(segs)).withColumn("bin", geo.heading_bin(F.col("heading")))
    hit = keyed.join(road, ["ci", "cj", "bin"], "left").withColumn("hit", F.coalesce("known", F.lit(False)))
    return segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m")), hit.select("route_id", "k", "distance_m", "hit")


@query("SELECT route_id, round(coverage, 6) AS coverage FROM cover", _sql.STEPS, VERTICES, GRID, HITS)
def route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, hit = _hits(spark, sf_dir)
    return rounded(route.coverage(hit, total), coverage=6)


_COMPARED = "SELECT route_id, CASE WHEN NOT (SELECT coalesce(bool_or(metres >= 400 AND bin > 3), false) FROM grades) AND coverage < 0.1 THEN 'TARGET' ELSE 'HISTORY' END AS comparator FROM cover"
_GRADE_PARTS = (_sql.GRADED, _sql.FOOT, _sql.GATES, _sql.FOLDS)


@query(_COMPARED, _sql.STEPS, VERTICES, GRID, HITS, *_GRADE_PARTS)
def race_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, *_hits(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str, total: DataFrame, hit: DataFrame) -> DataFrame:
    pts = rides.points(spark, sf_dir)
    usable = grade.model(grade.folds(pts), rides.tracks_of(pts)).agg(F.coalesce(F.bool_or((F.col("metres") >= 400) & (F.col("bin") > 3)), F.lit(False)).alias("usable"))
    share = route.coverage(hit, total).crossJoin(F.broadcast(usable))  # one row
    return share.select("route_id", route.comparator(F.col("coverage"), F.col("usable")).alias("comparator"))


_MERGED = """
c0 AS (SELECT route_id, distance_m, k - row_number() OVER (PARTITION BY route_id ORDER BY k) AS run FROM hits WHERE hit),
c1 AS (SELECT route_id, run, min(distance_m) AS a, max(distance_m) AS z FROM c0 GROUP BY ALL),
c2 AS (SELECT *, CASE WHEN a - lag(z) OVER w < 80 THEN 0 ELSE 1 END AS fresh FROM c1 WINDOW w AS (PARTITION BY route_id ORDER BY a)),
c3 AS (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY a) AS g FROM c2),
covered AS (SELECT route_id, min(a) AS start_m, max(z) AS end_m FROM c3 GROUP BY route_id, g HAVING max(z) - min(a) >= 300)
"""


@query("SELECT route_id, start_m, end_m FROM covered", _sql.STEPS, VERTICES, GRID, HITS, _MERGED)
def covered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.covered_runs(_hits(spark, sf_dir)[1])


#: Intervals on the routes, from the rides: where each ride's first and last point lie.
_SPANS = "spans AS (SELECT track_id % 6 AS route_id, track_id, (track_id * 7919 % 3000)::DOUBLE AS start_m, (track_id * 7919 % 3000 + 200 + track_id * 31 % 700)::DOUBLE AS end_m FROM tracks)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("track_id") * 7919 % 3000
    return rides.tracks_of(rides.points(spark, sf_dir)).select((F.col("track_id") % 6).alias("route_id"), "track_id", start.cast("double").alias("start_m"), (start + 200 + F.col("track_id") * 31 % 700).cast("double").alias("end_m"))


_GROUPED = (
    "SELECT route_id, g::BIGINT AS grp, count(*) AS n, min(start_m) AS start_m, max(end_m) AS end_m FROM (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY start_m, end_m) AS g FROM ("
    "SELECT *, CASE WHEN start_m <= max(end_m) OVER (PARTITION BY route_id ORDER BY start_m, end_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans)) GROUP BY ALL"
)


@query(_GROUPED, _SPANS)
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(_spans(spark, sf_dir))


def _grouped(spans: DataFrame) -> DataFrame:
    got = route.overlap_groups(spans, "route_id", "start_m", "end_m")
    return got.groupBy("route_id", F.col("group").alias("grp")).agg(F.count("*").alias("n"), F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"))


_PIECES = (
    "SELECT s.route_id, s.start_m, s.end_m, a AS piece_start_m, z AS piece_end_m FROM sec s, LATERAL ("
    "SELECT a, min(z) AS z FROM (SELECT s.start_m AS a UNION SELECT end_m FROM pri p WHERE p.route_id = s.route_id AND p.end_m > s.start_m AND p.end_m < s.end_m) x,"
    " (SELECT s.end_m AS z UNION SELECT start_m FROM pri p WHERE p.route_id = s.route_id AND p.start_m > s.start_m AND p.start_m < s.end_m) y WHERE z >= a"
    " AND NOT EXISTS (SELECT 1 FROM pri p WHERE p.route_id = s.route_id AND p.start_m <= a AND p.end_m > a) GROUP BY a) WHERE z - a >= 200"
)


#: Rides are dealt to routes by track_id % 6, so odd and even ones never meet on a route.
_PRIMARY = "track_id {div} 6 % 2 = 0"


@query(_PIECES, _SPANS, f"pri AS (SELECT * FROM spans WHERE {_PRIMARY.format(div='//')})", f"sec AS (SELECT DISTINCT route_id, start_m, end_m FROM spans WHERE NOT ({_PRIMARY.format(div='//')}))")
def overlay_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the primary half of the rides leaves of the other half; together they hold all."""
    spans, primary = _spans(spark, sf_dir), _PRIMARY.format(div="div")
    return route.uncovered(spans.where(f"NOT ({primary})").select("route_id", "start_m", "end_m").distinct(), spans.where(primary))


_CURVES = f"""
pri AS (SELECT * FROM spans WHERE {_PRIMARY.format(div='//')}),
sec AS (SELECT * FROM spans WHERE NOT ({_PRIMARY.format(div='//')})),
pc AS ({_PIECES.replace("SELECT s.route_id, s.start_m, s.end_m,", "SELECT s.route_id, s.track_id, s.start_m, s.end_m,")}),
cs AS (SELECT *, piece_start_m <= start_m AND piece_end_m >= end_m AS whole, length_mm / 1000.0::DOUBLE / (end_m - start_m) AS scale FROM pc JOIN tracks USING (track_id) WHERE n_points > 1),
ct AS (SELECT *, (piece_start_m - start_m) * scale AS d0, (piece_end_m - start_m) * scale AS d1 FROM cs),
pr AS (SELECT track_id, lag(distance_m) OVER w AS a, distance_m AS z, lag(time_s) OVER w AS ta, time_s AS tz FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
cu AS (SELECT c.*, u.ta + (c.d0 - u.a) / (u.z - u.a) * (u.tz - u.ta) AS t0, v.ta + (c.d1 - v.a) / (v.z - v.a) * (v.tz - v.ta) AS t1
       FROM ct c JOIN pr u ON u.track_id = c.track_id AND c.d0 >= u.a AND c.d0 < u.z JOIN pr v ON v.track_id = c.track_id AND c.d1 > v.a AND c.d1 <= v.z WHERE NOT whole),
cf AS (SELECT track_id, route_id, piece_start_m AS start_m, piece_end_m AS end_m, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t, t1 - t0 AS total FROM cu
       UNION ALL SELECT track_id, route_id, piece_start_m, piece_end_m, d1 - d0, t1 - t0, t1 - t0 FROM cu
       UNION ALL SELECT c.track_id, c.route_id, piece_start_m, piece_end_m, distance_m - d0, time_s - t0, t1 - t0 FROM cu c JOIN points p ON p.track_id = c.track_id AND p.distance_m > d0 AND p.distance_m < d1
       UNION ALL SELECT c.track_id, c.route_id, c.start_m, c.end_m, distance_m, time_s, max(time_s) OVER (PARTITION BY c.track_id) FROM cs c JOIN points p USING (track_id) WHERE whole
       UNION ALL SELECT s.track_id, s.route_id, s.start_m, s.end_m, distance_m, time_s, max(time_s) OVER (PARTITION BY s.track_id) FROM pri s JOIN points p USING (track_id) JOIN tracks k USING (track_id) WHERE n_points > 1)
"""
_TOTAL = "floor(round(total, 6))::BIGINT"


@query(f"SELECT track_id, route_id, start_m, end_m, round(d, 3) AS d, round(t, 3) AS t, 'PR ' || printf('%d:%02d', {_TOTAL} // 60, {_TOTAL} % 60) AS label FROM cf", _SPANS, _CURVES)
def overlay_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary rides, and what they leave of the others with the curve of just that."""
    pts, spans = rides.points(spark, sf_dir), _spans(spark, sf_dir)
    curve = F.array_sort(F.collect_list(F.struct(F.col("distance_m").alias("d"), F.col("time_s").alias("t"))))
    curves = pts.groupBy("track_id").agg(curve.alias("curve"), F.max("time_s").alias("time_s")).where(F.size("curve") > 1)
    label = F.concat(F.lit("PR "), formats.mmss(F.col("time_s")))
    segs = spans.join(curves, "track_id").select(F.col("track_id").cast("string").alias("seg_id"), "track_id", "route_id", "start_m", "end_m", label.alias("label"), "curve")
    primary = _PRIMARY.format(div="div")
    got = route.overlay(segs.where(primary).drop("track_id"), segs.where(f"NOT ({primary})").drop("track_id"))
    return rounded(got.select(F.col("seg_id").cast("bigint").alias("track_id"), "route_id", "start_m", "end_m", "label", F.explode("curve").alias("s")).select("track_id", "route_id", "start_m", "end_m", "s.d", "s.t", "label"), d=3, t=3)


#: Points of which some are off the route for a while and some have a clock that goes back.
_SEEDED = """
sp AS (SELECT id, track_id, route_id, seq, CASE WHEN seq % 31 = 17 THEN time_s - 60 ELSE time_s END AS time_s FROM asked JOIN points ON id = track_id || ':' || seq WHERE seq % 40 < 28 OR track_id % 3 <> 0),
sn AS (SELECT id, list({'along': along_m, 'lo': lo_m, 'hi': hi_m} ORDER BY perp_m, i) AS near FROM feet WHERE perp_m < 35 GROUP BY id),
so AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS o FROM sp JOIN sn USING (id)),
sl(track_id, o, lap, place, last_s, kept) AS (
  SELECT track_id, o, 0, near[1].along, time_s, true FROM so WHERE o = 1
  UNION ALL
  SELECT track_id, o, CASE WHEN kept AND along - place > 500 THEN lap + 1 ELSE lap END, CASE WHEN kept THEN along ELSE place END, CASE WHEN kept THEN time_s ELSE last_s END, kept
  FROM (SELECT *, coalesce(along > place + 0.001 AND (along - place > 500 OR time_s >= last_s), false) AS kept FROM (
    SELECT s.track_id, s.o, s.time_s, l.lap, l.place, l.last_s, list_filter(near, lambda x: x.hi >= l.place - 50 AND x.lo <= l.place + 600)[1].along AS along FROM sl l JOIN so s ON s.track_id = l.track_id AND s.o = l.o + 1))),
sk AS (SELECT *, count(*) OVER (PARTITION BY track_id, lap) AS n, row_number() OVER (PARTITION BY track_id, lap ORDER BY o) - 1 AS k, first_value(last_s) OVER (PARTITION BY track_id, lap ORDER BY o) AS t0 FROM sl WHERE kept)
"""


@query("SELECT track_id, track_id % 6 AS route_id, (dense_rank() OVER (PARTITION BY track_id ORDER BY lap) - 1)::INT AS lap, k::INT AS k, round(place, 2) AS route_m, round(last_s - t0, 3) AS elapsed_s FROM sk WHERE n > 1", _sql.STEPS, VERTICES, FEET, _SEEDED)
def seed_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of rides on their road's route, cut where they leave it for long."""
    pts = rides.points(spark, sf_dir).select("track_id", "seq", F.when(F.col("seq") % 31 == 17, F.col("time_s") - 60).otherwise(F.col("time_s")).alias("time_s"))
    asked = _asked(spark, sf_dir).select(F.split("id", ":")[0].cast("bigint").alias("track_id"), F.split("id", ":")[1].cast("int").alias("seq"), "route_id", "lat", "lng")
    some = asked.join(pts, ["track_id", "seq"]).where("seq % 40 < 28 OR track_id % 3 <> 0")
    return rounded(laps.seed_laps(some, joins.segments(routes(spark))), route_m=2, elapsed_s=3)
