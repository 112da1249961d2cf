"""Importing ride files: one batch from listed and decoded files to outcomes, rides, ledger and watermark."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.formats import source_key
from paceline.operators.library import enriched, marked, unprocessed
from paceline.operators.samples import decimated
from paceline.sources.rides import checkpointed

SPACING_M = 20.0


class Imported(NamedTuple):
    #: path, outcome (imported, duplicate, invalid, failed, unwritten), enriched
    outcomes: DataFrame
    #: points of the rides to add, spacing_m apart, with their source_key
    added: DataFrame
    #: points, with heights filled in, of the recorded rides that a file completes
    completed: DataFrame
    #: path, size, mtime of all files processed so far
    ledger: DataFrame


def asked(files: DataFrame, ledger: DataFrame, last_scan_ms: int | None = None) -> DataFrame:
    """Files (path, size, mtime) newer than the last scan, if one is given, that the ledger does not hold as they are."""
    fresh = files if last_scan_ms is None else files.where(F.col("mtime") > last_scan_ms)
    return unprocessed(fresh, ledger)


def imported(files: DataFrame, points: DataFrame, ledger: DataFrame, recorded: DataFrame, unwritten: DataFrame | None = None, spacing_m: float = SPACING_M, tracks: DataFrame | None = None) -> Imported:
    """What becomes of files (path, size, mtime, source, started_ms), as ``asked`` gives them.

    points: path, seq, lat, lng, distance_m, time_s, ele_m of the files that
    could be decoded; recorded: track_id, source, source_key and points' columns
    of the library.  A ride is thinned to points spacing_m apart first; what is
    left is judged, keyed and stored, so that a file meets the live recording of
    its ride, which is thinned alike.  A file without points has failed; one with
    fewer than two left is invalid.  A ride whose key the library or a file of a
    smaller path has is a duplicate, and completes the heights of a recorded ride
    with its key.  Keys are of the start and the last point left; a ride without
    a start has none and is never a duplicate.  unwritten: paths whose rides
    could not be stored.  Failed and unwritten files stay out of the ledger.
    tracks: track_id, source, source_key of the library, where they are kept
    apart from its points.
    """
    rides = checkpointed(thinned(points.join(files.select("path"), "path", "left_semi"), spacing_m))
    facts = rides.groupBy("path").agg(F.count("*").alias("n"), F.max("distance_m").alias("length_m"))
    keyed = files.join(facts, "path", "left").withColumn("key", source_key(F.col("started_ms"), F.col("length_m")))
    owned = (recorded if tracks is None else tracks).groupBy("track_id").agg(F.first("source").alias("own_source"), F.first("source_key").alias("key")).where("key <> ''")
    usable = (F.col("n") >= 2) & (F.coalesce(F.col("key"), F.lit("")) != "")
    rank = F.row_number().over(Window.partitionBy("key", F.coalesce(usable, F.lit(False))).orderBy("path"))
    known = owned.select("key").distinct().withColumn("known", F.lit(True))
    judged = keyed.withColumn("again", usable & (rank > 1)).join(known, "key", "left")
    lost = (files if unwritten is None else unwritten).select("path").distinct().withColumn("lost", F.lit(unwritten is not None))
    judged = judged.join(lost, "path", "left").withColumn(
        "outcome",
        F.when(F.col("n").isNull(), "failed").when(F.col("n") < 2, "invalid").when(usable & (F.col("known").isNotNull() | F.col("again")), "duplicate").when(F.coalesce("lost", F.lit(False)), "unwritten").otherwise("imported"),
    )
    judged = checkpointed(judged.select("path", "size", "mtime", "source", "key", "outcome"))
    twice = judged.where("outcome = 'duplicate' AND source <> 'RECORDED'").join(owned.where("own_source = 'RECORDED'").select("key", "track_id"), "key")
    completed = _completed(twice.groupBy("track_id").agg(F.min("path").alias("path")), rides, recorded)
    done = checkpointed(twice.join(completed.select("track_id").distinct(), "track_id", "left_semi").select("path").distinct())
    outcomes = judged.join(done.withColumn("done", F.lit(True)), "path", "left").select("path", "mtime", "outcome", F.col("done").isNotNull().alias("enriched"))
    added = rides.join(judged.where("outcome = 'imported'").select("path", F.col("key").alias("source_key")), "path")
    return Imported(outcomes, added, completed, marked(ledger, judged.where("outcome NOT IN ('failed', 'unwritten')")))


def thinned(points: DataFrame, spacing_m: float = SPACING_M) -> DataFrame:
    """The points (path, seq, distance_m and others) that are spacing_m or more beyond the last one kept, by d_mm where they have it."""
    kept = decimated(points.select(F.col("path").alias("track_id"), "seq", "distance_m", *[c for c in points.columns if c == "d_mm"]), spacing_m)
    return points.join(kept.select(F.col("track_id").alias("path"), "seq"), ["path", "seq"], "left_semi")


def _completed(matches: DataFrame, rides: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded rides of matches (track_id, path) that their file's heights change, with them."""
    scan = rides.join(matches, "path").select("track_id", "distance_m", "ele_m")
    mine = recorded.join(matches.select("track_id"), "track_id", "left_semi")
    filled = enriched(mine, scan)
    changed = mine.where("ele_m IS NULL").select("track_id", "seq").join(filled.where("ele_m IS NOT NULL"), ["track_id", "seq"], "left_semi").select("track_id").distinct()
    return filled.join(changed, "track_id", "left_semi")


def watermark(outcomes: DataFrame, last_scan_ms: int) -> DataFrame:
    """last_scan_ms: past all files stored or known, but before the oldest one that could not be written."""
    ok = F.max(F.when(F.col("outcome").isin("imported", "duplicate"), F.col("mtime")))
    lost = F.min(F.when(F.col("outcome") == "unwritten", F.col("mtime"))) - 1
    return outcomes.agg(F.least(F.greatest(F.lit(last_scan_ms), ok), lost).alias("last_scan_ms"))


def totals(outcomes: DataFrame) -> DataFrame:
    """total, imported, duplicates, failed (with invalid and unwritten ones), enriched."""
    is_ = lambda *v: F.count_if(F.col("outcome").isin(*v))
    return outcomes.agg(F.count("*").alias("total"), is_("imported").alias("imported"), is_("duplicate").alias("duplicates"), is_("failed", "invalid", "unwritten").alias("failed"), F.count_if("enriched").alias("enriched"))
