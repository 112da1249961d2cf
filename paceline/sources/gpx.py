"""GPX files through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.sources.files import listing

_POINT = "struct<_lat:double,_lon:double,ele:double,time:string>"
SCHEMA = f"trk array<struct<trkseg:array<struct<trkpt:array<{_POINT}>>>>>"


def parse_time(raw):
    """ISO instant, else the plain UTC form, else null."""
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def decoded(files: DataFrame) -> DataFrame:
    """path, outcome, started_ms, seq, lat, lng, distance_m, time_s, ele_m, track_id of files (path, content).

    A file counts only with two points or more and a time on each; points
    without sane coordinates are left out.  One that does not count, cannot be
    parsed or holds a DOCTYPE has failed, and is one row without a point.
    """
    text = files.select("path", F.decode("content", "UTF-8").alias("xml"))
    body = F.regexp_replace("xml", r"(?s)^.*?(<gpx[\s>])", "$1")
    safe = F.when(~F.upper("xml").contains("<!DOCTYPE"), body)
    doc = text.select("path", F.from_xml(safe, SCHEMA, {"rowTag": "gpx", "mode": "PERMISSIVE"}).alias("g"))
    pts = F.flatten(F.transform("g.trk", lambda t: F.flatten(F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    sane = F.filter(pts, lambda p: p["_lat"].between(-90, 90) & p["_lon"].between(-180, 180))
    timed = F.transform(sane, lambda p: F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lng"), p["ele"].alias("ele_m"), parse_time(p["time"]).alias("at")))
    whole = (F.size("p") >= 2) & F.forall("p", lambda p: p["at"].isNotNull())
    docs = doc.select("path", timed.alias("p")).withColumn("outcome", F.when(F.coalesce(whole, F.lit(False)), "decoded").otherwise("failed"))
    rows = docs.select("path", "outcome", F.posexplode_outer(F.when(F.col("outcome") == "decoded", F.col("p"))).alias("seq", "p")).select("path", "outcome", "seq", "p.*")
    w = Window.partitionBy("path").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    long = rows.withColumn("step", F.when(F.col("seq").isNotNull(), F.coalesce(step, F.lit(0.0)))).withColumn("start", F.unix_millis(F.first("at").over(upto)))
    return long.select(
        "path",
        "outcome",
        F.col("start").alias("started_ms"),
        "seq",
        "lat",
        "lng",
        F.sum("step").over(upto).alias("distance_m"),
        ((F.unix_millis("at") - F.col("start")) / 1000.0).alias("time_s"),
        "ele_m",
        F.concat(F.lit("gpx-"), F.col("start").cast("string")).alias("track_id"),
    )


def read(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """``decoded`` of all .gpx files below a path, changed after since_ms if it is given."""
    return decoded(listing(spark, path, "*.[gG][pP][xX]", since_ms))
