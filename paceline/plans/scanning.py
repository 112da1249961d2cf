"""Queries about ride files: encoded from rides, decoded again, imported into a store."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.plans import _sql
from paceline.sources import fit, gpx, rides
from paceline.sources.ride_store import RideStore
from paceline.streaming import importing

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


RUNNING = 1


def _numbers() -> list[Column]:
    """-1 for a file without points."""
    return [F.coalesce(c, F.lit(-1)).alias(c) for c in ("started_ms", "seq")]


def _fit_file(points: pa.Table) -> bytes:
    """A ride's file; every seventh ride's is broken, every fifth is a run."""
    points = points.sort_by("seq")
    cols = [points.column(c).to_pylist() for c in ("started_ms", "time_s", "lat", "lng", "distance_m", "ele_m")]
    ride = points.column("track_id")[0].as_py()
    data = fit.encode([(t0 / 1000 + t, lat, lng, d, e) for t0, t, lat, lng, d, e in zip(*cols, strict=True)], sport=RUNNING if ride % 5 == 0 else fit.CYCLING)
    return data[:-1] + bytes([data[-1] ^ 1]) if ride % 7 == 0 else data


def fit_files(points: DataFrame) -> DataFrame:
    """track_id, path, content: a FIT file of each ride."""

    def run(key, table):
        return pa.table({"track_id": [key[0].as_py()], "path": [f"ride-{key[0].as_py()}.fit"], "content": [_fit_file(table)]})

    rows = points.select("track_id", "seq", rides.started_ms("track_id").alias("started_ms"), "time_s", "lat", "lng", "distance_m", "ele_m")
    return rows.groupBy("track_id").applyInArrow(run, "track_id bigint, path string, content binary")


#: Points as a FIT file holds them: semicircles, whole seconds, centimetres, fifths of a metre of height.
_FIT = """
ff AS (SELECT 'ride-' || track_id || '.fit' AS path, track_id, seq - 1 AS k, round(round(lat * (2147483648 / 180.0::DOUBLE)) / (2147483648 / 180.0::DOUBLE), 6) AS lat, round(round(lng * (2147483648 / 180.0::DOUBLE)) / (2147483648 / 180.0::DOUBLE), 6) AS lng, floor(distance_m * 100 + 0.5) / 100 AS d, floor(time_s) AS time_s, floor((ele_m + 500) * 5 + 0.5) / 5 - 500 AS ele_m, started_ms FROM points JOIN tracks USING (track_id)),
told AS (SELECT DISTINCT path, track_id, started_ms, CASE WHEN track_id % 7 = 0 THEN 'failed' WHEN track_id % 5 = 0 OR count(*) OVER (PARTITION BY track_id) < 2 THEN 'invalid' ELSE 'decoded' END AS outcome FROM ff)
"""


@query(
    "SELECT path, outcome, told.started_ms, k::INT AS seq, lat, lng, round(d, 2) AS distance_m, time_s, round(ele_m, 1) AS ele_m FROM told JOIN ff USING (path) WHERE outcome = 'decoded'"
    " UNION ALL SELECT path, outcome, -1, -1, NULL, NULL, NULL, NULL, NULL FROM told WHERE outcome <> 'decoded'",
    _FIT,
)
def fit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides out of FIT files, and a row for each file that gives none."""
    got = fit.decoded(fit_files(rides.points(spark, sf_dir)))
    return got.select("path", "outcome", *_numbers(), *[F.round(c, n).alias(c) for c, n in (("lat", 6), ("lng", 6), ("distance_m", 2), ("time_s", 3), ("ele_m", 1))])


def gpx_files(points: DataFrame) -> DataFrame:
    """path, content: a GPX file of each ride; some lack a time, some declare an entity."""
    at = F.date_format(F.timestamp_millis(rides.started_ms("track_id") + F.col("t_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    time = F.when((F.col("track_id") % 7 == 0) & (F.col("seq") == 2), "").otherwise(F.concat(F.lit("<time>"), at, F.lit("</time>")))
    height = F.when(F.col("ele_m").isNull(), "").otherwise(F.concat(F.lit("<ele>"), F.col("ele_m").cast("string"), F.lit("</ele>")))
    place = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lng").cast("string"), F.lit('">'), height, time, F.lit("</trkpt>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", place.alias("p")))), lambda x: x["p"]), "")
    head = F.when(F.col("track_id") % 5 == 0, '<!DOCTYPE gpx [<!ENTITY x "y">]>').otherwise("")
    xml = F.concat(F.lit('<?xml version="1.0"?>'), head, F.lit("<gpx><trk><trkseg>"), F.col("body"), F.lit("</trkseg></trk></gpx>"))
    return points.groupBy("track_id").agg(body.alias("body")).select(F.concat(F.lit("ride-"), "track_id", F.lit(".gpx")).alias("path"), xml.cast("binary").alias("content"))


_GPX = f"""
gx AS (SELECT track_id, seq, lat, lng, ele_m, t_ms, coalesce({_sql.hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 0) AS step, count(*) OVER (PARTITION BY track_id) AS n FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
gd AS (SELECT *, sum(step) OVER (PARTITION BY track_id ORDER BY seq) AS d, CASE WHEN track_id % 5 = 0 OR track_id % 7 = 0 OR n < 2 THEN 'failed' ELSE 'decoded' END AS outcome FROM gx)
"""


@query(
    "SELECT 'ride-' || track_id || '.gpx' AS path, outcome, started_ms, (seq - 1)::INT AS seq, round(lat, 9) AS lat, round(lng, 9) AS lng, round(d, 4) AS distance_m, t_ms / 1000.0::DOUBLE AS time_s, ele_m FROM gd JOIN tracks USING (track_id) WHERE outcome = 'decoded'"
    " UNION ALL SELECT DISTINCT 'ride-' || track_id || '.gpx', outcome, -1, -1, NULL, NULL, NULL, NULL, NULL FROM gd WHERE outcome = 'failed'",
    _GPX,
)
def gpx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides out of GPX files, and a row for each file that gives none."""
    got = gpx.decoded(gpx_files(rides.points(spark, sf_dir)))
    return got.select("path", "outcome", *_numbers(), *[F.round(c, n).alias(c) for c, n in (("lat", 9), ("lng", 9), ("distance_m", 4))], "time_s", "ele_m")


_STORED = (
    _FIT
    + """,
fk(path, k, d) AS (SELECT path, k, d FROM ff WHERE k = 0
  UNION ALL SELECT path, k, d FROM (SELECT n.path, n.k, n.d, row_number() OVER (PARTITION BY n.path ORDER BY n.k) AS rn FROM fk f JOIN ff n ON n.path = f.path AND n.k > f.k AND n.d - f.d >= 20) WHERE rn = 1),
fs AS (SELECT path, any_value(track_id) AS track_id, any_value(started_ms) AS started_ms, outcome, count(*) AS points, max(d) AS tail FROM fk JOIN told USING (path) JOIN (SELECT track_id, path FROM told) USING (path, track_id) GROUP BY path, outcome),
fo AS (SELECT path, track_id, started_ms, points, tail, CASE WHEN outcome <> 'decoded' THEN outcome WHEN points < 2 THEN 'invalid' ELSE 'imported' END AS outcome, (started_ms // 60000) || ':' || trunc(tail / 10)::BIGINT AS key FROM fs)
"""
)


def _stored(spark: SparkSession, sf_dir: str) -> RideStore:
    """A store after two batches of files; the second also lists files of the first, copies
    of rides under other names, and was stopped half-way before."""
    store = RideStore(spark, rides.scratch(spark, "store"))
    files = rides.checkpointed(fit_files(rides.points(spark, sf_dir)).withColumns({"modificationTime": F.timestamp_millis(F.col("track_id") * 1000), "length": F.length("content").cast("bigint")}))
    importing.import_batch(store, 0, files.where("track_id % 2 = 0"))
    left = rides.checkpointed(fit.decoded(files.where("track_id % 2 = 1")).where("seq IS NOT NULL"))
    store.write(1, "points", left)
    store.write(1, "rides", left.select("track_id", F.lit("X").alias("source"), F.lit("x").alias("source_key"), "started_ms").distinct())
    copies = files.where("track_id % 3 = 0").withColumn("path", F.concat(F.lit("z-"), "path"))
    for _ in range(2):  # the second time, the batch is there already
        importing.import_batch(store, 1, files.where("track_id % 4 <> 2").unionByName(copies))
    return store


@query(
    "SELECT 'fit-' || started_ms AS track_id, key AS source_key, points, round(tail, 2) AS tail_m FROM fo WHERE outcome = 'imported'", _STORED)
def store_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds: each ride once, thinned, whatever came twice or was left behind."""
    got = _stored(spark, sf_dir).points().groupBy("track_id", "source_key")
    return got.agg(F.count("*").alias("points"), F.round(F.max("distance_m"), 2).alias("tail_m"))


@query(
    "SELECT path, 0::BIGINT AS batch, outcome FROM fo WHERE track_id % 2 = 0 UNION ALL SELECT path, 1, outcome FROM fo WHERE track_id % 2 = 1 OR (track_id % 4 = 0 AND outcome = 'failed')"
    " UNION ALL SELECT 'z-' || path, 1, CASE WHEN outcome = 'imported' THEN 'duplicate' ELSE outcome END FROM fo WHERE track_id % 3 = 0",
    _STORED,
)
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file, by batch: those known as they are are not asked again, failed ones are."""
    return _stored(spark, sf_dir).outcomes().select("path", "batch", "outcome")


@query("SELECT path FROM fo WHERE outcome <> 'failed' UNION ALL SELECT 'z-' || path FROM fo WHERE outcome <> 'failed' AND track_id % 3 = 0", _STORED)
def store_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).ledger().select("path")
