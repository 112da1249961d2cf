"""Queries about rides and their pace models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import formats
from paceline.operators import grade, grade_store, road_pace, samples
from paceline.plans import _sql
from paceline.sources import rides
from paceline.sources.rides import checkpointed

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None, *parts: str):
    """Register a query, and the SQL that states the same."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("SELECT track_id, seq, d_mm, t_ms, lat, lng, ele_m FROM points")
def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.points(spark, sf_dir).select("track_id", "seq", "d_mm", "t_ms", "lat", "lng", "ele_m")


@query("SELECT track_id, started_ms, n_points, length_mm, time_ms FROM tracks")
def track_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.tracks_of(rides.points(spark, sf_dir))


@query("SELECT track_id, seq, round(dd_m, 3) AS dd_m, round(dt_s, 3) AS dt_s, round(chord_m, 3) AS chord_m, round(heading, 3) AS heading FROM steps", _sql.STEPS)
def track_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = samples.deltas(rides.points(spark, sf_dir)).select("track_id", "seq", "dd_m", "dt_s", "chord_m", "heading")
    return rounded(got, dd_m=3, dt_s=3, chord_m=3, heading=3)


@query("SELECT track_id, seq, sub, round(lat, 8) AS lat, round(lng, 8) AS lng, round(heading, 3) AS heading, round(tpm, 6) AS tpm FROM samples", _sql.STEPS)
def pace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.pace_samples(rides.points(spark, sf_dir)), lat=8, lng=8, heading=3, tpm=6)


def _road(spark: SparkSession, sf_dir: str, history_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    pts = rides.points(spark, sf_dir)
    tracks = rides.tracks_of(pts)
    return pts, tracks, road_pace.model(samples.pace_samples(pts), tracks)


@query("SELECT ci, cj, bin, count(*) AS n_tracks FROM cells GROUP BY ALL", _sql.STEPS)
def sample_cells_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road_pace.cells(samples.pace_samples(rides.points(spark, sf_dir))).groupBy("ci", "cj", "bin").agg(F.count("*").alias("n_tracks"))


@query("SELECT ci, cj, bin, round(min, 6) AS min_tpm, round(last, 6) AS last_tpm, count AS n FROM road", _sql.STEPS, _sql.ROAD)
def road_pace_min_last_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _road(spark, sf_dir)[2].select("ci", "cj", "bin", F.round("min", 6).alias("min_tpm"), F.round("last", 6).alias("last_tpm"), F.col("count").alias("n"))


@query("SELECT ci, cj, bin, round(ema, 6) AS ema_tpm FROM road", _sql.STEPS, _sql.ROAD)
def road_pace_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _road(spark, sf_dir)[2].select("ci", "cj", "bin", F.round("ema", 6).alias("ema_tpm"))


@query("SELECT ci, cj, bin, round(mean_heading, 3) AS mean_heading FROM road", _sql.STEPS, _sql.ROAD)
def road_pace_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _road(spark, sf_dir)[2].select("ci", "cj", "bin", F.round("mean_heading", 3).alias("mean_heading"))


def _picked(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _road(spark, sf_dir)[2].select("ci", "cj", "bin", F.round(road_pace.pick(how), 6).alias("tpm"))

    run.__name__ = f"road_pace_pick_{how.lower()}"
    return query(f"SELECT ci, cj, bin, round({_sql.PICKS[how]}, 6) AS tpm FROM road", _sql.STEPS, _sql.ROAD)(run)


for _how in _sql.PICKS:
    _picked(_how)

#: Steps of the newest ride of each road, looked up in the model of all others.
_PLACES = "CASE WHEN track_id % 5 = 0 THEN lat + 18.0::DOUBLE / 111320.0::DOUBLE ELSE lat END"
_PLACED = f"""
places AS (SELECT track_id || ':' || seq AS id, track_id, seq, {_PLACES} AS lat, lng, heading, dd_m, dt_s,
           {_sql.row(_PLACES)} AS ci, {_sql.col('lng', _sql.row(_PLACES))} AS cj,
           least(7, floor(heading / 45.0))::INT AS bin FROM steps),
rp AS (SELECT *, {_sql.PICKS['AVERAGE']} AS pace FROM road),
exact AS (SELECT p.*, r.pace AS exact FROM places p LEFT JOIN rp r USING (ci, cj, bin)),
near AS (SELECT id, first(pace ORDER BY r.count DESC, i, j, b) AS near
         FROM exact e, (VALUES (-1), (0), (1)) AS o1(i), (VALUES (-1), (0), (1)) AS o2(j), (VALUES (-1), (0), (1)) AS o3(b), rp r
         WHERE e.exact IS NULL AND NOT (i = 0 AND j = 0 AND b = 0) AND r.ci = e.ci + i AND r.cj = {_sql.col('e.lng', 'e.ci + i')} + j AND r.bin = (e.bin + b + 8) % 8
           AND {_sql.turn('r.mean_heading', 'e.heading')} <= 45 GROUP BY id),
looked AS (SELECT exact.*, near, coalesce(exact, near) AS hist FROM exact LEFT JOIN near USING (id))
"""


def _places(pts: DataFrame) -> DataFrame:
    """Steps as places; every fifth ride is moved a cell north, where only neighbours answer."""
    moved = F.when(F.col("track_id") % 5 == 0, F.col("lat") + 18.0 / 111_320.0).otherwise(F.col("lat"))
    steps = samples.deltas(pts)
    return steps.select(F.concat_ws(":", "track_id", "seq").alias("id"), "track_id", "seq", moved.alias("lat"), "lng", "heading", "dd_m", "dt_s")


@query("SELECT track_id, seq, round(exact, 6) AS exact, round(near, 6) AS near FROM looked", _sql.STEPS, _sql.ROAD, _PLACED)
def road_pace_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, _, road = _road(spark, sf_dir)
    return rounded(road_pace.lookup(_places(pts), road).select("track_id", "seq", "exact", "near"), exact=6, near=6)


@query(
    "SELECT track_id, round(sum(CASE WHEN dd_m > 0 THEN coalesce(hist * dd_m, dt_s) ELSE 0 END) - sum(dt_s), 3) AS lead_s,"
    " round(coalesce(sum(dd_m) FILTER (dd_m > 0 AND hist IS NOT NULL), 0), 3) AS matched_m, round(coalesce(sum(dd_m) FILTER (dd_m > 0 AND hist IS NULL), 0), 3) AS filled_m"
    " FROM looked GROUP BY track_id",
    _sql.STEPS,
    _sql.ROAD,
    _PLACED,
)
def ride_gap_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ride's lead over the road model: known metres at their pace, others at its own."""
    pts, _, road = _road(spark, sf_dir)
    got = road_pace.lookup(_places(pts), road)
    ghost = F.when(F.col("dd_m") > 0, F.coalesce(F.col("hist") * F.col("dd_m"), F.col("dt_s"))).otherwise(0.0)
    known, new = (F.col("dd_m") > 0) & F.col("hist").isNotNull(), (F.col("dd_m") > 0) & F.col("hist").isNull()
    return got.groupBy("track_id").agg(
        F.round(F.sum(ghost) - F.sum("dt_s"), 3).alias("lead_s"),
        F.round(F.coalesce(F.sum(F.when(known, F.col("dd_m"))), F.lit(0.0)), 3).alias("matched_m"),
        F.round(F.coalesce(F.sum(F.when(new, F.col("dd_m"))), F.lit(0.0)), 3).alias("filled_m"),
    )


@query("SELECT track_id, seq, (t_ms * 100 - d_mm * 18) / 100000.0::DOUBLE AS gap_s, round(distance_m - time_s / 0.18::DOUBLE, 3) AS gap_m, distance_m - time_s / 0.18::DOUBLE > 0 AS ahead FROM points")
def ride_gap_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap to a fixed 20 km/h: negative seconds and positive metres are ahead."""
    tpm = 0.18
    gap_m = F.col("distance_m") - F.col("time_s") / tpm
    return rides.points(spark, sf_dir).select("track_id", "seq", ((F.col("t_ms") * 100 - F.col("d_mm") * 18) / 100_000.0).alias("gap_s"), F.round(gap_m, 3).alias("gap_m"), (gap_m > 0).alias("ahead"))


@query("SELECT track_id, seq, dd_m, dt_s, round(grade_pct, 4) AS grade_pct FROM graded", _sql.STEPS, _sql.GRADED)
def grade_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grade.graded_steps(grade.windowed(rides.points(spark, sf_dir))), grade_pct=4)


@query("SELECT track_id, bin, round(sum_dt, 3) AS sum_dt, round(sum_dd, 3) AS sum_dd FROM folds", _sql.STEPS, _sql.GRADED, _sql.FOOT, _sql.GATES, _sql.FOLDS)
def grade_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grade.folds(rides.points(spark, sf_dir)), sum_dt=3, sum_dd=3)


def _grades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pts = rides.points(spark, sf_dir)
    return pts, grade.model(grade.folds(pts), rides.tracks_of(pts))


_GRADE_PARTS = (_sql.STEPS, _sql.GRADED, _sql.FOOT, _sql.GATES, _sql.FOLDS)


@query("SELECT bin, round(mean, 6) AS mean, round(min, 6) AS min, round(last, 6) AS last, round(metres, 3) AS metres, count FROM grades", *_GRADE_PARTS)
def grade_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grades(spark, sf_dir)[1], mean=6, min=6, last=6, metres=3)


@query(
    "SELECT track_id, seq, round(CASE WHEN metres >= 400 THEN CASE WHEN count >= 2 THEN mean ELSE last END END, 6) AS grade_tpm"
    " FROM graded LEFT JOIN grades ON bin = floor(least(20, greatest(-20, grade_pct)) + 0.5)",
    *_GRADE_PARTS,
)
def grade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, model = _grades(spark, sf_dir)
    return rounded(grade.lookup(grade.graded_steps(grade.windowed(pts)), model).select("track_id", "seq", "grade_tpm"), grade_tpm=6)


@query("SELECT round(coalesce(sum(metres), 0), 3) AS covered_m, coalesce(bool_or(metres >= 400), false) AS usable FROM grades", *_GRADE_PARTS)
def grade_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir)[1].agg(F.round(F.coalesce(F.sum("metres"), F.lit(0.0)), 3).alias("covered_m"), F.coalesce(F.bool_or(F.col("metres") >= 400), F.lit(False)).alias("usable"))


@query("SELECT track_id, n_pairs, round(turn_rate, 6) AS turn_rate, round(footprint_m, 3) AS footprint_m, drift FROM drift", *_GRADE_PARTS[:4])
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = rides.points(spark, sf_dir)
    return rounded(grade.drift_gate(pts, grade.windowed(pts)), turn_rate=6, footprint_m=3)


@query("SELECT track_id, round(moving_s, 3) AS moving_s, round(fast_s, 3) AS fast_s, round(uphill_s, 3) AS uphill_s, motorised FROM motor", *_GRADE_PARTS[:4])
def motor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grade.motor_gate(grade.windowed(rides.points(spark, sf_dir))), moving_s=3, fast_s=3, uphill_s=3)


@query("SELECT track_id, round(footprint_m, 3) AS footprint_m FROM foot", _sql.FOOT)
def robust_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grade.footprint(rides.points(spark, sf_dir)), footprint_m=3)


_TIERS = """
tiers AS (SELECT l.track_id, l.seq, l.dd_m, l.dt_s, l.hist, CASE WHEN metres >= 400 THEN CASE WHEN g.count >= 2 THEN mean ELSE g.last END END AS grade_tpm
          FROM looked l LEFT JOIN graded d ON d.track_id = l.track_id AND d.seq = l.seq
          LEFT JOIN grades g ON g.bin = floor(least(20, greatest(-20, d.grade_pct)) + 0.5))
"""


_TIERED = (
    "SELECT track_id, round(sum(CASE WHEN dd_m > 0 THEN coalesce(hist * dd_m, grade_tpm * dd_m, dt_s) ELSE 0 END) - sum(dt_s), 3) AS lead_s,"
    " count(*) FILTER (hist IS NOT NULL) AS n_road, count(*) FILTER (hist IS NULL AND grade_tpm IS NOT NULL) AS n_grade, count(*) FILTER (hist IS NULL AND grade_tpm IS NULL) AS n_own"
    " FROM tiers GROUP BY track_id"
)


@query(_TIERED, *_GRADE_PARTS, _sql.ROAD, _PLACED, _TIERS)
def ride_gap_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead by tiers: road, else gradient, else the rider's own pace."""
    pts, tracks, road = _road(spark, sf_dir)
    got = road_pace.lookup(_places(pts), road)
    steps = checkpointed(grade.windowed(pts))
    model = grade.model(grade.folds(pts, steps=steps), tracks)
    sloped = grade.lookup(grade.graded_steps(steps), model).select("track_id", "seq", "grade_tpm")
    tiers = got.select("track_id", "seq", "dd_m", "dt_s", "hist").join(sloped, ["track_id", "seq"], "left")
    ghost = F.when(F.col("dd_m") > 0, F.coalesce(F.col("hist") * F.col("dd_m"), F.col("grade_tpm") * F.col("dd_m"), F.col("dt_s"))).otherwise(0.0)
    return tiers.groupBy("track_id").agg(
        F.round(F.sum(ghost) - F.sum("dt_s"), 3).alias("lead_s"),
        F.count_if(F.col("hist").isNotNull()).alias("n_road"),
        F.count_if(F.col("hist").isNull() & F.col("grade_tpm").isNotNull()).alias("n_grade"),
        F.count_if(F.col("hist").isNull() & F.col("grade_tpm").isNull()).alias("n_own"),
    )


_DECIMATED = """
kept AS (SELECT track_id, 1 AS seq, 0::BIGINT AS d_mm FROM tracks
         UNION ALL SELECT k.track_id, n.seq, n.d_mm FROM kept k, LATERAL (SELECT p.seq, p.d_mm FROM points p WHERE p.track_id = k.track_id AND p.seq > k.seq AND p.d_mm - k.d_mm >= 40000 ORDER BY p.seq LIMIT 1) n)
"""


@query("SELECT track_id, seq, d_mm / 1000.0::DOUBLE AS distance_m FROM kept", _DECIMATED)
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points 40 m or more after the last kept one (steps are 20 to 30 m)."""
    return samples.decimated(rides.points(spark, sf_dir), 40.0)


@query(
    "SELECT round(avg(kmh), 6) AS kmh, round(avg(mph), 6) AS mph, round(avg(pkm), 6) AS pkm, round(avg(pmi), 6) AS pmi FROM ("
    "SELECT v * 3.6::DOUBLE AS kmh, v * 3600.0::DOUBLE / 1609.344::DOUBLE AS mph, CASE WHEN v > 0 THEN 1000.0::DOUBLE / (v * 60.0::DOUBLE) ELSE 0 END AS pkm, CASE WHEN v > 0 THEN 1609.344::DOUBLE / (v * 60.0::DOUBLE) ELSE 0 END AS pmi"
    " FROM (SELECT (length_mm / 1000.0::DOUBLE) / (time_ms / 1000.0::DOUBLE) AS v FROM tracks WHERE time_ms > 0))"
)
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("length_mm") / 1000.0) / (F.col("time_ms") / 1000.0)
    t = rides.tracks_of(rides.points(spark, sf_dir)).where("time_ms > 0").select(v.alias("v"))
    units = {"kmh": formats.kmh, "mph": formats.mph, "pkm": formats.min_per_km, "pmi": formats.min_per_mile}
    return t.agg(*[F.round(F.avg(f(F.col("v"))), 6).alias(k) for k, f in units.items()])


_STORED = f"""
metres AS (SELECT track_id, sum(sum_dd) AS metres FROM folds GROUP BY track_id),
rides AS (SELECT track_id, started_ms AS start_ms, started_ms + floor(time_ms / 1000.0::DOUBLE * 1000)::BIGINT AS end_ms, metres FROM tracks JOIN metres USING (track_id) WHERE NOT (track_id % 7 = 3 AND track_id % 3 <> 0))
"""
_REBUILT = """
taken AS (SELECT unnest(taken) AS track_id FROM (SELECT taken FROM pick ORDER BY o DESC LIMIT 1)),
regraded AS (SELECT bin, mean, coalesce(q_min, mean) AS min, coalesce(q_last, mean) AS last, metres, count FROM (
  SELECT bin, sum(sum_dt) / sum(sum_dd) AS mean, min(sum_dt / sum_dd) FILTER (sum_dd >= 400) AS q_min, arg_max(sum_dt / sum_dd, (started_ms, track_id)) FILTER (sum_dd >= 400) AS q_last, sum(sum_dd) AS metres, count(*) AS count
  FROM folds JOIN tracks USING (track_id) WHERE track_id IN (SELECT track_id FROM taken) GROUP BY bin))
"""


def _update(spark: SparkSession, sf_dir: str) -> grade_store.Update:
    """A second update: a third of the rides is known, half of these changed; every fifth
    has a shorter copy in the archive; some cannot be read."""
    pts = rides.points(spark, sf_dir)
    tracks = rides.tracks_of(pts)
    file = lambda place, half: tracks.select(F.lit(place).alias("place"), F.col("track_id").cast("string").alias("track_id"), (F.col("length_mm") + half).cast("bigint").alias("size"), F.col("started_ms").alias("mtime"))
    files = file("live", 0).unionByName(file("archive", 1).where("CAST(track_id AS bigint) % 5 = 0"))

    def read(misses: DataFrame) -> DataFrame:
        there = misses.where("NOT (CAST(track_id AS bigint) % 7 = 3 AND CAST(track_id AS bigint) % 3 <> 0)").select("place", F.col("track_id").alias("file"))
        got = there.join(pts, F.col("file") == F.col("track_id").cast("string")).where("place = 'live' OR seq <= 20")
        return got.withColumn("started_ms", rides.started_ms("track_id")).drop("track_id").withColumnRenamed("file", "track_id")

    none = spark.createDataFrame([], grade_store.FOLDS)
    first = grade_store.updated(files.where("CAST(track_id AS bigint) % 3 = 0"), none, read)
    changed = F.when(F.expr("place = 'live' AND CAST(track_id AS bigint) % 6 = 0"), F.col("mtime") + 1).otherwise(F.col("mtime"))
    return grade_store.updated(files.withColumn("mtime", changed), first.folds, read)


@query("SELECT bin, round(mean, 6) AS mean, round(min, 6) AS min, round(last, 6) AS last, round(metres, 3) AS metres, count FROM regraded", *_GRADE_PARTS, _STORED, _sql.PAIRS, _sql.GREEDY, _REBUILT)
def grade_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient model after an update that folded new and changed files only."""
    return rounded(grade_store.model(_update(spark, sf_dir).folds), mean=6, min=6, last=6, metres=3)


@query(
    "SELECT count(*) FILTER (NOT hit AND readable) AS parsed, count(*) FILTER (hit) AS cached, count(*) FILTER (NOT hit AND NOT readable) AS unread FROM ("
    "SELECT track_id, track_id % 3 = 0 AND NOT (place = 'live' AND track_id % 6 = 0) AS hit, NOT (track_id % 7 = 3 AND track_id % 3 <> 0) AS readable FROM (SELECT track_id, 'live' AS place FROM tracks UNION ALL SELECT track_id, 'archive' FROM tracks WHERE track_id % 5 = 0))"
)
def grade_rebuild_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _update(spark, sf_dir)
    return got.folds.limit(1).select(F.lit(got.parsed).cast("bigint").alias("parsed"), F.lit(got.cached).cast("bigint").alias("cached"), F.lit(got.unread).cast("bigint").alias("unread"))
