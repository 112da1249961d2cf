"""The gradient pace model: seconds a metre by gradient, and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.operators.samples import DROPOUT_M, MAX_SPEED, MIN_SPEED, deltas
from paceline.sources.rides import checkpointed

WINDOW_M = 100.0
MAX_PCT = 20.0
MIN_BIN_M = 400.0
BEST_SPEEDUP = 2.0
MIN_LAPS = 2
MOTOR = {"speed": 15.0, "grade": -1.0, "seconds": 45.0, "share": 0.05, "uphill": 2.0, "uphill_seconds": 30.0}
DRIFT = {"footprint_m": 1000.0, "radius_m": 40.0, "chord_m": 5.0, "pairs": 20, "grade": 2.0}


def bin_of(grade_pct: Column) -> Column:
    """Half-up rounding of the clamped gradient."""
    return F.floor(F.least(F.lit(MAX_PCT), F.greatest(F.lit(-MAX_PCT), grade_pct)) + 0.5).cast("int")


def windowed(points: DataFrame) -> DataFrame:
    """Each step with the gradient over the newest point 100 m or more back.

    A dropout or an impossible speed starts a new run, whose first point is the
    step's own; within a run distance does not fall, so the point is found by a
    range frame.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    step = lambda c: F.col(c) - F.when(F.lag("lat").over(w).isNotNull(), F.lag(c).over(w))
    joined = points.select("track_id", "seq", "distance_m", "ele_m", step("distance_m").alias("dd_m"), step("time_s").alias("dt_s"))
    fast = (F.col("dt_s") > 0) & (F.col("dd_m") > MAX_SPEED * F.col("dt_s"))
    runs = joined.withColumn("run", F.sum(F.when((F.col("dd_m") > DROPOUT_M) | fast, 1).otherwise(0)).over(w))
    at_mm = F.round(F.col("distance_m") * 1000).cast("bigint")
    back = Window.partitionBy("track_id", "run").orderBy("mm").rangeBetween(Window.unboundedPreceding, -int(WINDOW_M * 1000))
    seen = runs.withColumn("mm", at_mm).withColumn("b", F.max(F.struct("seq", "distance_m", "ele_m")).over(back))
    dd = F.col("distance_m") - F.col("b.distance_m")
    return seen.where("dd_m IS NOT NULL").select("track_id", "seq", "dd_m", "dt_s", "run", ((F.col("ele_m") - F.col("b.ele_m")) / dd * 100).alias("grade_pct"))


def graded_steps(steps: DataFrame) -> DataFrame:
    """track_id, seq, dd_m, dt_s, grade_pct of steps as ``windowed`` gives them: moving, fault-free, within 20 %."""
    v = F.col("dd_m") / F.col("dt_s")
    fine = steps.where((F.col("dd_m") > 0) & (F.col("dd_m") <= DROPOUT_M) & (F.col("dt_s") > 0))
    return fine.where((v <= MAX_SPEED) & (v >= MIN_SPEED) & (F.abs("grade_pct") <= MAX_PCT)).select("track_id", "seq", "dd_m", "dt_s", "grade_pct")


def folds(points: DataFrame, gate: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """track_id, bin, sum_dt, sum_dd: one ride's seconds and metres by gradient.

    With ``gate``, drift clouds and motorised rides give none.  steps: what
    ``windowed`` gives, where a caller has it; it is made once for fold and gates.
    """
    steps = checkpointed(windowed(points)) if steps is None else steps
    out = graded_steps(steps).groupBy("track_id", bin_of(F.col("grade_pct")).alias("bin")).agg(F.sum("dt_s").alias("sum_dt"), F.sum("dd_m").alias("sum_dd"))
    if gate:
        out = out.join(drift_gate(points, steps).where("drift").select("track_id"), "track_id", "left_anti")
        out = out.join(motor_gate(steps).where("motorised").select("track_id"), "track_id", "left_anti")
    return out


def model(fold: DataFrame, tracks: DataFrame, min_bin_m: float = MIN_BIN_M) -> DataFrame:
    """bin, mean, min, last, metres, count; min and last from rides with enough metres."""
    timed = fold.where("sum_dd > 0").join(tracks.select("track_id", "started_ms"), "track_id").withColumn("tpm", F.col("sum_dt") / F.col("sum_dd"))
    enough = F.col("sum_dd") >= min_bin_m
    out = timed.groupBy("bin").agg(
        (F.sum("sum_dt") / F.sum("sum_dd")).alias("mean"),
        F.min(F.when(enough, F.col("tpm"))).alias("q_min"),
        F.max_by(F.when(enough, F.col("tpm")), F.when(enough, F.struct("started_ms", "track_id"))).alias("q_last"),
        F.sum("sum_dd").alias("metres"),
        F.count("*").alias("count"),
    )
    return out.select("bin", "mean", F.coalesce("q_min", "mean").alias("min"), F.coalesce("q_last", "mean").alias("last"), "metres", "count")


def pace(how: str = "AVERAGE", min_bin_m: float = MIN_BIN_M) -> Column:
    """The pace a bin's row of the model answers with; null below min_bin_m."""
    got = {
        "LAST": F.col("last"),
        "BEST": F.greatest(F.least("min", "mean"), F.col("mean") / BEST_SPEEDUP),
        "AVERAGE": F.when(F.col("count") >= MIN_LAPS, F.col("mean")).otherwise(F.col("last")),
    }[how]
    return F.when(F.col("metres") >= min_bin_m, got)


def lookup(graded: DataFrame, grades: DataFrame, how: str = "AVERAGE") -> DataFrame:
    """graded (with grade_pct) with the model's pace ``grade_tpm``; at most 41 bins are broadcast."""
    answers = grades.select(F.col("bin").alias("g_bin"), pace(how).alias("grade_tpm"))
    return graded.join(F.broadcast(answers), bin_of(F.col("grade_pct")) == F.col("g_bin"), "left").drop("g_bin")


def footprint(points: DataFrame) -> DataFrame:
    """track_id, footprint_m: nearest-rank 95 % distance from the median place."""
    centre = points.groupBy("track_id").agg(F.median("lat").alias("c_lat"), F.median("lng").alias("c_lng"))
    far = points.join(centre, "track_id").withColumn("d", geo.haversine_m(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")))
    return far.groupBy("track_id").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY d)").alias("footprint_m"))


def drift_gate(points: DataFrame, windows: DataFrame) -> DataFrame:
    """track_id, n_pairs, turn_rate, footprint_m, drift: whether a ride is a cloud
    of positions at home: it turns all the time, stays small and flat.  windows:
    the points' ``windowed``."""
    steps = deltas(points)
    fault = ~((F.col("dd_m") > 0) & (F.col("dd_m") <= DROPOUT_M) & (F.col("dt_s") > 0) & (F.col("dd_m") <= MAX_SPEED * F.col("dt_s")))
    w = Window.partitionBy("track_id").orderBy("seq")
    runs = steps.withColumn("fault", fault).withColumn("run", F.sum(F.when(F.col("fault"), 1).otherwise(0)).over(w))
    moved = runs.where(~F.col("fault") & (F.col("chord_m") >= DRIFT["chord_m"]))
    in_run = Window.partitionBy("track_id", "run").orderBy("seq")
    turns = moved.select("track_id", (geo.bearing_diff_deg(F.lag("heading").over(in_run), F.col("heading")) / ((F.lag("chord_m").over(in_run) + F.col("chord_m")) / 2)).alias("rate")).where("rate IS NOT NULL")
    rates = turns.groupBy("track_id").agg(F.count("*").alias("n_pairs"), F.median("rate").alias("turn_rate"))
    grades = graded_steps(windows).groupBy("track_id").agg(F.count("*").alias("n_grades"), F.median(F.abs("grade_pct")).alias("grade"))
    flat = (F.coalesce("n_grades", F.lit(0)) < DRIFT["pairs"]) | (F.col("grade") < DRIFT["grade"])
    turning = (F.coalesce("n_pairs", F.lit(0)) >= DRIFT["pairs"]) & (F.col("turn_rate") > F.degrees(F.lit(1 / DRIFT["radius_m"])))
    every = footprint(points).join(rates, "track_id", "left").join(grades, "track_id", "left")
    verdict = turning & (F.col("footprint_m") < DRIFT["footprint_m"]) & flat
    return every.select("track_id", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "turn_rate", "footprint_m", F.coalesce(verdict, F.lit(False)).alias("drift"))


def motor_gate(steps: DataFrame) -> DataFrame:
    """track_id, moving_s, fast_s, uphill_s, motorised, of steps as ``windowed`` gives them."""
    v = F.col("dd_m") / F.col("dt_s")
    moving = steps.where((F.col("dd_m") > 0) & (F.col("dd_m") <= DROPOUT_M) & (F.col("dt_s") > 0)).where(v >= MIN_SPEED)
    # an impossible speed opens a run, so its own step has no gradient; it counts as moving
    fast = (v > MOTOR["speed"]) & (F.col("grade_pct") >= MOTOR["grade"])
    up = (v > MOTOR["speed"]) & (F.col("grade_pct") >= MOTOR["uphill"])
    sums = moving.groupBy("track_id").agg(
        F.sum("dt_s").alias("moving_s"),
        F.coalesce(F.sum(F.when(fast, F.col("dt_s"))), F.lit(0.0)).alias("fast_s"),
        F.coalesce(F.sum(F.when(up, F.col("dt_s"))), F.lit(0.0)).alias("uphill_s"),
    )
    verdict = (F.col("fast_s") >= MOTOR["seconds"]) & (F.col("fast_s") >= MOTOR["share"] * F.col("moving_s")) & (F.col("uphill_s") >= MOTOR["uphill_seconds"])
    return sums.withColumn("motorised", verdict)
