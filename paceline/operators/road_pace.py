"""The road pace model: seconds a metre by cell of road and heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo

ALPHA = 0.25
SEED_LAPS = 4
BEST_SPEEDUP = 2.0
MIN_LAPS = 2
TOLERANCE_DEG = 45.0


def in_order(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """rows with place (from 1, in order) and places (their number) within keys."""
    by = Window.partitionBy(*keys)
    return rows.withColumn("place", F.row_number().over(by.orderBy(order))).withColumn("places", F.count("*").over(by))


def seeded_mean(value: str) -> Column:
    """The moving average after the last row, which starts as the mean of the first SEED_LAPS.

    Every row's weight follows from its place, so a hot group is summed, never
    gathered: the first ones share what the later ones have left.
    """
    n, k = F.col("places"), F.col("place")
    late = F.greatest(F.lit(0), n - F.greatest(k, F.lit(SEED_LAPS)))
    weight = F.when(k <= SEED_LAPS, 1 / F.least(n, F.lit(SEED_LAPS))).otherwise(F.lit(ALPHA)) * F.pow(F.lit(1 - ALPHA), late)
    return F.sum(F.col(value) * weight)


def celled(places: DataFrame) -> DataFrame:
    """places (lat, lng) with ci and cj of their cell."""
    return places.withColumn("ci", geo.cell_lat(F.col("lat"))).withColumn("cj", geo.cell_lng(F.col("lng"), F.col("ci")))


def cells(samples: DataFrame) -> DataFrame:
    """Samples with ci, cj, bin; one of each ride a cell and bin, the first along it."""
    keyed = celled(samples).withColumn("bin", geo.heading_bin(F.col("heading")))
    first = F.row_number().over(Window.partitionBy("track_id", "ci", "cj", "bin").orderBy("seq", "sub"))
    return keyed.withColumn("rn", first).where("rn = 1").drop("rn")


def model(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """ci, cj, bin, ema, min, last, count, mean_heading over rides, oldest first."""
    timed = cells(samples).join(tracks.select("track_id", "started_ms"), "track_id")
    rad = F.radians("heading")
    heading = F.pmod(F.degrees(F.atan2(F.sum(F.sin(rad)), F.sum(F.cos(rad)))) + 360, F.lit(360.0))
    placed = in_order(timed, ["ci", "cj", "bin"], F.struct("started_ms", "track_id"))
    return placed.groupBy("ci", "cj", "bin").agg(
        seeded_mean("tpm").alias("ema"),
        F.min("tpm").alias("min"),
        F.max_by("tpm", "place").alias("last"),
        F.count("*").alias("count"),
        heading.alias("mean_heading"),
    )


def pick(how: str) -> Column:
    """The pace that answers: BEST, LAST or AVERAGE."""
    if how == "BEST":
        return F.greatest("min", F.col("ema") / BEST_SPEEDUP)
    if how == "LAST":
        return F.col("last")
    return F.when(F.col("count") >= MIN_LAPS, F.col("ema")).otherwise(F.col("last"))


def lookup(places: DataFrame, road: DataFrame, how: str = "AVERAGE") -> DataFrame:
    """places (any columns, with id, lat, lng, heading) with their pace ``hist``.

    The exact cell answers if there is one; else the richest of the 26
    neighbours whose mean heading is within 45 degrees.  Only places without an
    exact answer are spread over the nine cells around, where they meet what
    bins there are.  Rows of cells have columns of their own width, so a place
    has its own column in each row.
    """
    road = road.withColumn("pace", pick(how))
    keyed = celled(places).withColumn("bin", geo.heading_bin(F.col("heading")))
    exact = keyed.join(road.select("ci", "cj", "bin", F.col("pace").alias("exact")), ["ci", "cj", "bin"], "left")
    missed = exact.where(F.col("exact").isNull() & F.col("heading").isNotNull()).select("id", "lng", "heading", "ci", "bin")
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    row = F.col("ci") + F.col("o.di")
    around = missed.select("*", F.explode(steps).alias("o")).select("id", "heading", "o", F.col("bin").alias("own"), row.alias("ci"), (geo.cell_lng(F.col("lng"), row) + F.col("o.dj")).alias("cj"))
    turned = F.pmod(F.col("bin") - F.col("own") + 1, F.lit(8)) - 1  # -1, 0, 1 for the own bin and those beside it
    near = around.join(road.select("ci", "cj", "bin", "pace", "count", "mean_heading"), ["ci", "cj"])
    near = near.withColumn("o", F.struct("o.di", "o.dj", turned.alias("db"))).where("o.db <= 1 AND NOT (o.di = 0 AND o.dj = 0 AND o.db = 0)")
    near = near.where(geo.bearing_diff_deg(F.col("mean_heading"), F.col("heading")) <= TOLERANCE_DEG)
    richest = near.groupBy("id").agg(F.min_by("pace", F.struct(-F.col("count"), "o")).alias("near"))
    return exact.join(richest, "id", "left").withColumn("hist", F.coalesce("exact", "near"))
