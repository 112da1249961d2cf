"""Going on with a race: what a stopped stream held, the gates, and handing it to the next one.

The races of a stopped stream are read from its state, so nothing is written
beside Spark's own checkpoint.  A race goes on only if it is recent, on the same
route, by the same pick and of a ride that carries on; any other begins anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.rules import same_ride
from paceline.streaming.ordered import names
from paceline.streaming.race import Racing

MAX_AGE_MS = 6 * 3600 * 1000
GATES = ("recent", "same_route", "same_pick", "continuous", "compared")


def saved(spark: SparkSession, log: str) -> DataFrame:
    """ride_id and the state of each race that a stream with this checkpoint location held last.

    Rides that ended, or never began, have none.
    """
    held = spark.read.format("statestore").option("path", log).option("stateVarName", "held").load()
    return held.select("key.ride_id", "value.*").where("begun")


def judged(races: DataFrame, cuts: DataFrame, now: DataFrame, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """races with a column for each gate, and ``resumes`` if all are passed.

    races: ride_id and a race's state; cuts: what was known when it stopped
    (ride_id, epoch, route_key, pick, comparator, saved_ms); now: the ride that
    asks (ride_id, epoch, route_key, pick, now_ms, now_m, now_s).  A cut without
    the comparator that earned its lead passes no gate.
    """
    cut = cuts.select("ride_id", *[F.col(c).alias(f"c_{c}") for c in ("epoch", "route_key", "pick", "comparator", "saved_ms")])
    asks = now.select("ride_id", *[F.col(c).alias(f"n_{c}") for c in ("epoch", "route_key", "pick", "now_ms", "now_m", "now_s")])
    both = races.join(cut, "ride_id").join(asks, "ride_id")
    age = F.col("n_now_ms") - F.col("c_saved_ms")
    gates = {
        "recent": age <= max_age_ms,
        "same_route": F.col("c_route_key") == F.col("n_route_key"),
        "same_pick": F.col("c_pick") == F.col("n_pick"),
        "continuous": same_ride(F.col("c_epoch"), F.col("at_m"), F.coalesce("race_clock", F.lit(-1.0)), F.col("n_epoch"), F.col("n_now_m"), F.col("n_now_s")),
        "compared": F.col("c_comparator").isNotNull(),
    }
    told = both.withColumns({g: F.coalesce(c, F.lit(False)) for g, c in gates.items()})
    every = F.lit(True)
    for g in GATES:
        every = every & F.col(g)
    return told.withColumn("resumes", every).select(*races.columns, *GATES, "resumes")


def handed_over(races: DataFrame) -> DataFrame:
    """The initial state of the next stream: the races that resume, not yet active in it."""
    return races.where("resumes").select("ride_id", *names(Racing.state)).withColumn("active", F.lit(False))
