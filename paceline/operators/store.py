"""The stores of the library as tables: archive, aggregates by route, folds by file, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATE_VERSIONS = (1, 3)
MAX_AGE_MS = 540 * 86_400_000
MOST_FILES = 200


def archived(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """tracks with state ``archived`` for the ids (track_id), which leave the live view in the same write."""
    gone = ids.select("track_id").distinct().withColumn("gone_", F.lit(True))
    return tracks.join(gone, "track_id", "left").withColumn("state", F.when(F.col("gone_"), "archived").otherwise(F.col("state"))).drop("gone_")


def live_cells(cells: DataFrame, tracks: DataFrame) -> DataFrame:
    """The index without archived tracks."""
    return cells.join(tracks.where("state = 'live'").select("track_id"), "track_id", "left_semi")


def everywhere(live: DataFrame, archive: DataFrame, metres: str = "length_m") -> DataFrame:
    """Live and archived tracks with ``place``; of one id in both the one with more metres, live on a tie."""
    both = live.withColumn("place", F.lit("live")).unionByName(archive.withColumn("place", F.lit("archive")))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc(metres), F.desc("place")))
    return both.withColumn("n_", rank).where("n_ = 1").drop("n_")


def current(aggregates: DataFrame) -> DataFrame:
    """Aggregates of a schema version that can still be read."""
    return aggregates.where(F.col("schema_version").between(*AGGREGATE_VERSIONS))


def updated(aggregates: DataFrame, fresh: DataFrame, replace: bool = True) -> DataFrame:
    """Aggregates by route_key after saving fresh ones; without replace, only where
    there is none that can still be read: one of an unknown version gives way."""
    if not replace:
        fresh = fresh.join(current(aggregates).select("route_key"), "route_key", "left_anti").select(aggregates.columns)
    return aggregates.join(fresh.select("route_key"), "route_key", "left_anti").unionByName(fresh)


def swept(aggregates: DataFrame, now_ms: int, most: int = MOST_FILES, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """The newest aggregates that are not too old."""
    return aggregates.where(F.col("updated_ms") >= now_ms - max_age_ms).orderBy(F.desc("updated_ms"), "route_key").limit(most)


def fold_cache(files: DataFrame, cache: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(folds of files that are as they were, files to fold anew).

    files: track_id, size, mtime and the place, which does not matter: a file
    moved to the archive still hits.  cache: the same, a signature of the
    constants, and folds.
    """
    keys = ["track_id", "size", "mtime"]
    good = cache.where(F.col("signature") == signature).drop("signature", "place").dropDuplicates(keys)
    return files.join(good, keys), files.join(good.select(keys), keys, "left_anti")


def merged_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cells of both, each once."""
    return index.unionByName(fresh).distinct()


def without_keys(keys: DataFrame, drop: DataFrame) -> DataFrame:
    """keys without those to drop (source_key)."""
    return keys.join(drop.select("source_key"), "source_key", "left_anti")


def boxes(points: DataFrame) -> DataFrame:
    """track_id and the box around its points."""
    return points.groupBy("track_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))


def boxes_meet(a: str, b: str) -> Column:
    """Whether two boxes (structs) share a place; touching counts."""
    x, y = F.col(a), F.col(b)
    return (x["min_lat"] <= y["max_lat"]) & (x["max_lat"] >= y["min_lat"]) & (x["min_lng"] <= y["max_lng"]) & (x["max_lng"] >= y["min_lng"])


def average_speed(segs: DataFrame) -> DataFrame:
    """route_id, speed_ms over all its segments (distance_m, time_s); null without time or distance."""
    d, t = F.sum("distance_m"), F.sum("time_s")
    return segs.groupBy("route_id").agg(F.when((d > 0) & (t > 0), d / t).alias("speed_ms"))


def dominant(spans: DataFrame, how: str, share: float = 0.9) -> DataFrame:
    """The span of each route_id that answers: LAST the newest, BEST the fastest of those
    nearly as long as the longest.  spans: route_id, track_id, span_m, time_s, started_ms."""
    if how == "LAST":
        order = [F.desc("started_ms"), "track_id"]
        asked = spans
    else:
        asked = spans.withColumn("long_", F.max("span_m").over(Window.partitionBy("route_id"))).where(F.col("span_m") >= share * F.col("long_")).drop("long_")
        order = [F.desc(F.col("span_m") / F.col("time_s")), "track_id"]
    return asked.withColumn("n_", F.row_number().over(Window.partitionBy("route_id").orderBy(*order))).where("n_ = 1").drop("n_")


def not_contained(intervals: DataFrame, covered: DataFrame) -> DataFrame:
    """Intervals (route_id, start_m, end_m) that no covered one holds whole.

    Covered ones that begin no later and end no earlier: the farthest end of
    those that begin before decides, so one window over both answers.
    """
    both = covered.select("route_id", "start_m", "end_m", F.lit(0).alias("mine")).unionByName(intervals.select("route_id", "start_m", "end_m", F.lit(1).alias("mine")))
    w = Window.partitionBy("route_id").orderBy("start_m", "mine").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("mine") == 0, F.col("end_m"))).over(w)
    return both.withColumn("reach", reach).where("mine = 1 AND (reach IS NULL OR reach < end_m)").select("route_id", "start_m", "end_m")


def next_start(places: DataFrame, segs: DataFrame) -> DataFrame:
    """places (id, route_id, at_m) with the start of the next segment after them, null behind the last."""
    both = segs.select("route_id", F.col("start_m").alias("at_m"), F.lit(None).cast("string").alias("id")).unionByName(places.select("route_id", "at_m", "id"))
    w = Window.partitionBy("route_id").orderBy(F.desc("at_m"), F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("id").isNull(), F.col("at_m")), ignorenulls=True).over(w)
    return both.withColumn("next_m", nxt).where("id IS NOT NULL").select("id", "route_id", "at_m", "next_m")


def node_counts(nodes: DataFrame) -> DataFrame:
    """How many nodes have how many laps."""
    return nodes.groupBy("count").agg(F.count("*").alias("nodes"))


def shortfall(expected: Column, got: Column) -> Column:
    return F.greatest(F.lit(0), expected - got)
