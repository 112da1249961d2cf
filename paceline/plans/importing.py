"""Queries about an import: files made of rides, some broken, some known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import formats
from paceline.operators import imports
from paceline.plans import _sql
from paceline.sources import rides

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


LAST_SCAN = 1_700_000_100_000
#: A file a ride, and a second one of every fifth; broken, one-point and unwritable
#: ones; the library holds every fourth ride as recorded, without most heights.
#: Points lie some 7 m apart (mm * 3 // 10), and are thinned to 20 m before anything else.
_FILES = f"""
near AS (SELECT track_id, seq, d_mm * 3 // 10 AS d_mm, (d_mm * 3 // 10) / 1000.0::DOUBLE AS distance_m, ele_m FROM points),
kept(track_id, seq, d_mm) AS (SELECT track_id, seq, d_mm FROM near WHERE seq = 1
  UNION ALL SELECT track_id, seq, d_mm FROM (SELECT n.*, row_number() OVER (PARTITION BY n.track_id ORDER BY n.seq) AS rn FROM kept k JOIN near n ON n.track_id = k.track_id AND n.seq > k.seq AND n.d_mm - k.d_mm >= 20000) WHERE rn = 1),
thin AS (SELECT near.* FROM near JOIN kept USING (track_id, seq)),
file AS (SELECT 'a' || track_id AS path, track_id, length_mm + 1 AS size, started_ms + time_ms AS mtime, 'FITFILES_SCAN' AS source, started_ms FROM tracks
         UNION ALL SELECT 'b' || track_id, track_id, length_mm + 2, started_ms + time_ms + 5000, 'FIT_IMPORT', started_ms FROM tracks WHERE track_id % 5 = 0),
todo AS (SELECT * FROM file WHERE mtime > {LAST_SCAN} AND NOT (track_id % 7 = 0 AND source = 'FITFILES_SCAN')),
pts AS (SELECT path, seq, t.track_id, distance_m, ele_m FROM todo t JOIN thin p USING (track_id) WHERE t.track_id % 9 <> 0 AND (t.track_id % 11 <> 0 OR seq = 1)),
fact AS (SELECT t.*, len, n2, (started_ms // 60000) || ':' || trunc(len / 10)::BIGINT AS key FROM todo t LEFT JOIN (SELECT path, max(distance_m) AS len, count(*) >= 2 AS n2 FROM pts GROUP BY path) USING (path)),
own AS (SELECT track_id AS own_id, (any_value(started_ms) // 60000) || ':' || trunc(max(distance_m) / 10)::BIGINT AS key FROM tracks JOIN thin USING (track_id) WHERE track_id % 4 = 0 GROUP BY track_id),
said AS (SELECT path, mtime, source, key, CASE WHEN len IS NULL THEN 'failed' WHEN NOT n2 THEN 'invalid' WHEN key IN (SELECT key FROM own) OR EXISTS (SELECT 1 FROM fact g WHERE g.key = f.key AND g.n2 AND g.path < f.path) THEN 'duplicate' WHEN track_id % 13 = 0 THEN 'unwritten' ELSE 'imported' END AS outcome FROM fact f),
pair AS (SELECT own_id AS track_id, min(path) AS path FROM said JOIN own USING (key) WHERE outcome = 'duplicate' GROUP BY own_id),
have AS (SELECT pair.track_id, distance_m AS d0, ele_m AS e0, lead(distance_m) OVER w AS d1, lead(ele_m) OVER w AS e1 FROM pair JOIN pts USING (path) WHERE ele_m IS NOT NULL WINDOW w AS (PARTITION BY pair.track_id ORDER BY distance_m)),
filled AS (SELECT p.track_id, p.seq, any_value(e0 + (distance_m - d0) / (d1 - d0) * (e1 - e0)) AS ele_m FROM thin p JOIN have h ON p.track_id = h.track_id AND distance_m > d0 AND distance_m <= d1 AND d1 > d0 AND d1 - d0 <= 200 WHERE p.seq % 4 <> 0 OR p.ele_m IS NULL GROUP BY ALL),
outcome AS (SELECT path, mtime, outcome, outcome = 'duplicate' AND key IN (SELECT key FROM own WHERE own_id IN (SELECT track_id FROM filled)) AS enriched FROM said)
"""


def _run(spark: SparkSession, sf_dir: str) -> imports.Imported:
    full = rides.points(spark, sf_dir)
    tracks = rides.tracks_of(full)
    pts = full.withColumn("d_mm", F.expr("d_mm * 3 div 10")).withColumn("distance_m", F.col("d_mm") / 1000.0)
    end = F.col("started_ms") + F.col("time_ms")
    one = tracks.select(F.concat(F.lit("a"), "track_id").alias("path"), "track_id", (F.col("length_mm") + 1).alias("size"), end.alias("mtime"), F.lit("FITFILES_SCAN").alias("source"), "started_ms")
    two = tracks.where("track_id % 5 = 0").select(F.concat(F.lit("b"), "track_id").alias("path"), "track_id", (F.col("length_mm") + 2).alias("size"), (end + 5000).alias("mtime"), F.lit("FIT_IMPORT").alias("source"), "started_ms")
    files = one.unionByName(two)
    ledger = one.where("track_id % 7 = 0").select("path", "size", "mtime")
    todo = imports.asked(files, ledger, LAST_SCAN).select(files.columns)
    read = todo.select("path", "track_id").join(pts, "track_id").where("track_id % 9 <> 0 AND (track_id % 11 <> 0 OR seq = 1)")
    read = read.select("path", "seq", "lat", "lng", "distance_m", "time_s", "ele_m", "d_mm")
    own = imports.thinned(pts.where("track_id % 4 = 0").withColumn("path", F.col("track_id")))
    keys = own.groupBy("track_id").agg(formats.source_key(rides.started_ms("track_id"), F.max("distance_m")).alias("source_key"))
    library = own.join(keys, "track_id").withColumns({"source": F.lit("RECORDED"), "ele_m": F.when(F.col("seq") % 4 == 0, F.col("ele_m"))})
    library = library.select("track_id", "source", "source_key", "seq", "lat", "lng", "distance_m", "time_s", "ele_m")
    return imports.imported(todo.drop("track_id"), read, ledger, library, todo.where("track_id % 13 = 0").select("path"))


@query("SELECT * FROM outcome", _FILES)
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).outcomes


@query(f"SELECT least(greatest({LAST_SCAN}, max(mtime) FILTER (outcome IN ('imported', 'duplicate'))), min(mtime) FILTER (outcome = 'unwritten') - 1) AS last_scan_ms FROM outcome", _FILES)
def import_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.watermark(_run(spark, sf_dir).outcomes, LAST_SCAN)


@query("SELECT count(*) AS total, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome IN ('failed', 'invalid', 'unwritten')) AS failed, count(*) FILTER (enriched) AS enriched FROM outcome", _FILES)
def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.totals(_run(spark, sf_dir).outcomes)


@query(
    "SELECT path, size, mtime FROM file WHERE track_id % 7 = 0 AND source = 'FITFILES_SCAN' UNION ALL SELECT path, size, file.mtime FROM file JOIN outcome USING (path) WHERE outcome NOT IN ('failed', 'unwritten')", _FILES
)
def import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).ledger


@query("SELECT path, count(*) AS points, max(distance_m) AS tail_m, any_value(key) AS source_key FROM pts JOIN said USING (path) WHERE outcome = 'imported' GROUP BY path", _FILES)
def import_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).added.groupBy("path").agg(F.count("*").alias("points"), F.max("distance_m").alias("tail_m"), F.first("source_key").alias("source_key"))


@query(
    "SELECT p.track_id, p.seq, round(coalesce(CASE WHEN p.seq % 4 = 0 THEN p.ele_m END, f.ele_m), 3) AS ele_m FROM thin p LEFT JOIN filled f USING (track_id, seq) WHERE p.track_id IN (SELECT track_id FROM filled)", _FILES
)
def import_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rides with the heights that an imported file of the same ride gave them."""
    return _run(spark, sf_dir).completed.select("track_id", "seq", F.round("ele_m", 3).alias("ele_m"))
