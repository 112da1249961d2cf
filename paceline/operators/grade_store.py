"""The gradient model kept up to date: folds by file, what has changed folded anew, the model reduced from folds.

A row of folds is a file: its place and identity (size, time), the constants it
was folded by, the ride's interval, and seconds and metres by gradient bin.  An
update reads the points of new and changed files only; the model comes from the
folds of all of them, after copies and overlapping rides were dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators import grade
from paceline.operators.library import suppressed
from paceline.sources.rides import checkpointed

#: What folds depend on; folds of other constants are made anew.
SIGNATURE = hashlib.md5(repr((grade.WINDOW_M, grade.MAX_SPEED, grade.MIN_SPEED, grade.DROPOUT_M, grade.MAX_PCT, sorted(grade.DRIFT.items()), sorted(grade.MOTOR.items()))).encode()).hexdigest()
#: Versions of a saved model that can still be served (fixed values), the last one what is written.
SERVABLE = (1, 3)
FOLDS = "place string, track_id string, size bigint, mtime bigint, signature string, start_ms bigint, end_ms bigint, bins array<struct<bin: int, sum_dt: double, sum_dd: double>>"
KEYS = ["track_id", "size", "mtime"]


class Update(NamedTuple):
    #: FOLDS of all files that are there and could be read
    folds: DataFrame
    #: files folded anew, taken from the cache, and left out as they could not be read
    parsed: int
    cached: int
    unread: int

    @property
    def complete(self) -> bool:
        return self.unread == 0


def updated(files: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame], signature: str = SIGNATURE) -> Update:
    """The folds after files (place, track_id, size, mtime) came, changed, moved or went.

    A file of the cache's size and time is a hit, wherever it lies; one in its
    own place before a copy elsewhere.  read: gives the points (place, track_id,
    started_ms and the columns of points) of the files asked for; a file without
    points could not be read, has no row, and is asked for again next time.
    """
    good = cache.where(F.col("signature") == signature).select(*KEYS, F.col("place").alias("was"), "signature", "start_ms", "end_ms", "bins")
    near = F.row_number().over(Window.partitionBy("place", *KEYS).orderBy(F.when(F.col("was") == F.col("place"), 0).otherwise(1), "was"))
    hits = files.join(good, KEYS).withColumn("n_", near).where("n_ = 1").select("place", *KEYS, "signature", "start_ms", "end_ms", "bins")
    hits = checkpointed(hits)
    misses = checkpointed(files.select("place", *KEYS).join(hits.select("place", *KEYS), ["place", *KEYS], "left_anti"))
    points = checkpointed(read(misses))
    # a ride may be missed in two places at once
    apart = points.withColumn("track_id", F.concat_ws("\n", "place", "track_id"))
    bins = grade.folds(apart).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("bin", "sum_dt", "sum_dd"))).alias("bins"))
    spans = apart.groupBy("track_id").agg(F.first("place").alias("place"), F.first("started_ms").alias("start_ms"), F.max("time_s").alias("time_s"))
    spans = spans.select("track_id", "place", "start_ms", (F.col("start_ms") + F.floor(F.col("time_s") * 1000)).cast("bigint").alias("end_ms"))
    made = spans.join(bins, "track_id", "left").withColumn("track_id", F.substring_index("track_id", "\n", -1))
    fresh = misses.join(made, ["place", "track_id"]).select("place", *KEYS, F.lit(signature).alias("signature"), "start_ms", "end_ms", F.coalesce("bins", F.array().cast("array<struct<bin:int,sum_dt:double,sum_dd:double>>")).alias("bins"))
    fresh = checkpointed(fresh)
    n_fresh, n_missed = fresh.count(), misses.count()
    return Update(hits.unionByName(fresh), n_fresh, hits.count(), n_missed - n_fresh)


def rides(folds: DataFrame) -> DataFrame:
    """folds that count: of copies the one with more metres, of overlapping rides the longest; those without height never."""
    metres = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["sum_dd"])
    some = folds.where(F.size("bins") > 0).withColumn("metres", metres)
    first = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("metres"), F.desc("place")))
    one = checkpointed(some.withColumn("n_", first).where("n_ = 1").drop("n_"))
    return one.join(suppressed(one.select("track_id", "start_ms", "end_ms", "metres")).where("kept").select("track_id"), "track_id", "left_semi")


def model(folds: DataFrame) -> DataFrame:
    """The gradient model of the rides that count."""
    counted = checkpointed(rides(folds))
    rows = counted.select("track_id", F.explode("bins").alias("b")).select("track_id", "b.*")
    return grade.model(rows, counted.select("track_id", F.col("start_ms").alias("started_ms")))


def servable(models: DataFrame) -> DataFrame:
    """Saved models (schema_version and a model's columns) that can still be served; of an older version, a rebuild is owed."""
    return models.where(F.col("schema_version").between(*SERVABLE)).withColumn("owed", F.col("schema_version") < SERVABLE[1])
