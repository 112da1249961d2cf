"""From points to pace samples: deltas, guards, dwell clip and densifying."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo

MAX_SPEED = 30.0
MIN_SPEED = 0.5
DROPOUT_M = 200.0
ANCHOR_M = 12.0
CURVE_RATIO = 1.5


def deltas(points: DataFrame) -> DataFrame:
    """Each step of a ride: its ends, dd_m, dt_s, chord_m and heading.

    ``seq`` is that of the step's last point.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    names = ("lat", "lng", "distance_m", "time_s", "ele_m")
    both = points.select("track_id", "seq", *names, *[F.lag(c).over(w).alias(f"a_{c}") for c in names]).where("a_lat IS NOT NULL")
    ends = [F.col(c) for c in ("a_lat", "a_lng", "lat", "lng")]
    return both.select(
        "*",
        (F.col("distance_m") - F.col("a_distance_m")).alias("dd_m"),
        (F.col("time_s") - F.col("a_time_s")).alias("dt_s"),
        geo.haversine_m(*ends).alias("chord_m"),
        geo.bearing_deg(*ends).alias("heading"),
    )


def valid_steps(steps: DataFrame) -> DataFrame:
    """Steps that carry a pace: tpm (seconds a metre), dwelling clipped to MIN_SPEED."""
    speed = F.col("dd_m") / F.col("dt_s")
    fine = steps.where((F.col("dd_m") > 0) & (F.col("dt_s") > 0) & (F.col("chord_m") <= DROPOUT_M)).where(speed <= MAX_SPEED)
    return fine.withColumn("tpm", F.when(speed < MIN_SPEED, 1 / MIN_SPEED).otherwise(F.col("dt_s") / F.col("dd_m")))


def pace_samples(points: DataFrame) -> DataFrame:
    """track_id, seq, sub, lat, lng, heading, tpm: a sample every 12 m of a step."""
    anchors = F.when(F.col("dd_m") > F.col("chord_m") * CURVE_RATIO, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("chord_m") / ANCHOR_M))).cast("int")
    dense = valid_steps(deltas(points)).withColumn("n", anchors).withColumn("sub", F.explode(F.sequence(F.lit(1), F.col("n"))))
    f = F.col("sub") / F.col("n")
    return dense.select(
        "track_id",
        "seq",
        "sub",
        (F.col("a_lat") + f * (F.col("lat") - F.col("a_lat"))).alias("lat"),
        (F.col("a_lng") + f * (F.col("lng") - F.col("a_lng"))).alias("lng"),
        "heading",
        "tpm",
    )


def spaced(distances: list[float], spacing_m: float) -> list[int]:
    """Positions of the first distance and of each that is spacing_m or more beyond the last one taken.

    The next one is searched among running maxima, so the work follows the
    number taken, not the number of distances.
    """
    d = np.asarray(distances, float)
    out = [0] if len(d) else []
    top = np.maximum.accumulate(d) if len(d) else d
    while out:
        here = out[-1]
        k = max(here + 1, int(np.searchsorted(top, d[here] + spacing_m)) - 1)
        while k < len(d) and d[k] - d[here] < spacing_m:
            k += 1
        if k >= len(d):
            break
        out.append(k)
    return out


def decimated(points: DataFrame, spacing_m: float = 20.0) -> DataFrame:
    """Points at least spacing_m after the last one kept.

    Which point is kept depends on the last kept one, so a ride is one ordered
    group of a few numbers a point.  Points that carry whole millimetres (d_mm)
    are spaced by these: a difference of two doubles may fall short of a spacing
    that is met.
    """
    whole = "d_mm" in points.columns
    given = ["track_id", "seq", "distance_m"]

    def run(ride: pa.Table) -> pa.Table:
        ride = ride.sort_by("seq")
        keep = spaced(ride.column("d_mm").to_numpy(), spacing_m * 1000) if whole else spaced(ride.column("distance_m").to_numpy(), spacing_m)
        return ride.select(given).take(pa.array(keep, pa.int64()))

    kind = {f.name: f.dataType.simpleString() for f in points.select(given).schema}
    return points.select(*given, *["d_mm"] * whole).groupBy("track_id").applyInArrow(run, ", ".join(f"{n} {t}" for n, t in kind.items()))
