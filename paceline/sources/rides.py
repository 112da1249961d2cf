"""The ride tables: tracks and points, from events or from stored tables.

``events`` holds no positions; ``from_events`` derives rides from it by whole
numbers only, so that any engine gets the same ones.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Points of a derived ride, as SQL that Spark and ANSI engines share but for
#: integer division; %s is that operator.
STEP_MM = "20000 + event_id * 7919 % 10000 + CASE WHEN event_id % 97 = 0 THEN 250000 ELSE 0 END"
STEP_MS = "CASE WHEN event_id % 23 = 0 THEN 90000 WHEN event_id % 29 = 0 THEN 400 ELSE 2000 + event_id * 104729 % 3000 END"
#: Place along the road in mm, eastbound or back.
PLACE_MM = "CASE WHEN track_id {div} 6 % 2 = 1 THEN 9000000 - d_mm * 958 {div} 1000 ELSE 500000 + d_mm * 958 {div} 1000 END"
#: Six roads, by track_id % 6: latitude in degrees, and its cosine (close is enough).
ROAD_LAT = "CASE {r} WHEN 0 THEN 0 WHEN 1 THEN 41 WHEN 2 THEN -33 WHEN 3 THEN 60 WHEN 4 THEN -52 ELSE 69 END"
ROAD_COS = "CASE {r} WHEN 0 THEN 1e0 WHEN 1 THEN 754710e-6 WHEN 2 THEN 838671e-6 WHEN 3 THEN 5e-1 WHEN 4 THEN 615661e-6 ELSE 358368e-6 END"
#: Metres north of that latitude: a road turns every 1,200 m.
BEND_MM = "(abs(({x} + 700000) % 2400000 - 1200000) * 3 {div} 10 + 4000)"


def lat_of(road: str, x_mm: str, div: str, side_mm: str = "0") -> str:
    """SQL that both engines share: latitude of a place on a road, and of one side_mm north of it."""
    return f"({ROAD_LAT.format(r=road)} + ({BEND_MM.format(x=x_mm, div=div)} + {side_mm}) / 1e3 / 111320e0)"


def lng_of(road: str, x_mm: str) -> str:
    return f"(({x_mm}) / 1e3 / 111320e0 / {ROAD_COS.format(r=road)})"


#: Height in mm by place: up 4 %, flat, down 5 %, flat, each 800 m.
HEIGHT_MM = (
    "CASE WHEN x_mm % 3200000 < 800000 THEN 100000 + x_mm % 3200000 * 4 {div} 100"
    " WHEN x_mm % 3200000 < 1600000 THEN 132000"
    " WHEN x_mm % 3200000 < 2400000 THEN 132000 - (x_mm % 3200000 - 1600000) * 4 {div} 100"
    " ELSE 100000 END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share: the
    session's checkpoint folder; a temporary one only on one machine where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def points_from_events(events: DataFrame) -> DataFrame:
    """track_id, seq, d_mm, t_ms, x_mm, lat, lng, distance_m, time_s, ele_m."""
    ride = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto = ride.rowsBetween(Window.unboundedPreceding, 0)
    steps = events.select("user_id", "ts", "event_id", F.row_number().over(ride).alias("seq"), F.expr(STEP_MM).alias("dd"), F.expr(STEP_MS).alias("dt"))
    run = steps.select(
        F.col("user_id").alias("track_id"),
        "event_id",
        "seq",
        (F.sum("dd").over(upto) - F.first("dd").over(upto)).alias("d_mm"),
        (F.sum("dt").over(upto) - F.first("dt").over(upto)).alias("t_ms"),
    )
    placed = run.withColumn("x_mm", F.expr(PLACE_MM.format(div="div")))
    return placed.select(
        "track_id",
        "seq",
        "d_mm",
        "t_ms",
        "x_mm",
        F.expr(lat_of("track_id % 6", "x_mm", "div")).alias("lat"),
        F.expr(lng_of("track_id % 6", "x_mm")).alias("lng"),
        (F.col("d_mm") / 1000.0).alias("distance_m"),
        (F.col("t_ms") / 1000.0).alias("time_s"),
        F.when(F.col("event_id") % 17 != 0, F.expr(HEIGHT_MM.format(div="div")) / 1000.0).alias("ele_m"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_from_events(table(spark, sf_dir, "events"))


def tracks_of(pts: DataFrame) -> DataFrame:
    """track_id, started_ms, n_points, length_mm, time_ms of each ride."""
    return pts.groupBy("track_id").agg(F.count("*").alias("n_points"), F.max("d_mm").alias("length_mm"), F.max("t_ms").alias("time_ms")).select(
        "track_id", started_ms("track_id").alias("started_ms"), "n_points", "length_mm", "time_ms"
    )


def started_ms(track: str):
    return F.expr(f"1700000000000 + {track} div 3 * 3600000 + {track} % 3 * 40000")


#: The same as common table expressions for the comparing engine.
SQL = f"""
e AS (SELECT user_id AS track_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {STEP_MM} AS dd, {STEP_MS} AS dt FROM events),
r0 AS (SELECT track_id, event_id, seq, (sum(dd) OVER w - first_value(dd) OVER w)::BIGINT AS d_mm, (sum(dt) OVER w - first_value(dt) OVER w)::BIGINT AS t_ms
       FROM e WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
r1 AS (SELECT *, {PLACE_MM.format(div='//')} AS x_mm FROM r0),
points AS (SELECT track_id, seq, d_mm, t_ms, x_mm, {lat_of('track_id % 6', 'x_mm', '//')} AS lat, {lng_of('track_id % 6', 'x_mm')} AS lng,
           d_mm / 1000.0::DOUBLE AS distance_m, t_ms / 1000.0::DOUBLE AS time_s,
           CASE WHEN event_id % 17 <> 0 THEN ({HEIGHT_MM.format(div='//')}) / 1000.0::DOUBLE END AS ele_m FROM r1),
tracks AS (SELECT track_id, 1700000000000 + track_id // 3 * 3600000 + track_id % 3 * 40000 AS started_ms, count(*) AS n_points, max(d_mm) AS length_mm, max(t_ms) AS time_ms FROM points GROUP BY track_id)
"""
