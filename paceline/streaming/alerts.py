"""Alerts about the position of live rides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALERT_S = 60.0


def position_alerts(ticks: DataFrame, alert_s: float = ALERT_S, refused: Column | None = None) -> DataFrame:
    """ride_id, seq, age_s of the ticks that raise an alert: one for each loss of the position.

    ticks: ride_id, seq, now_s, last_fix_s, paused.  The age of a position counts
    from the last fix, the ride's first tick or its last resumption (the first
    tick after paused ones), whichever is latest; a ride that never had a fix has
    none to lose.  A loss ends with a fix that is itself younger than half of
    alert_s, so the grace after a pause does not end one.  Paused ticks neither
    alert nor end a loss.  refused: ticks whose alert was not taken; the next
    tick tries again.
    """
    ride = Window.partitionBy("ride_id").orderBy("seq")
    upto = ride.rowsBetween(Window.unboundedPreceding, 0)
    paused = F.coalesce(F.col("paused"), F.lit(False))
    t = ticks.select("ride_id", "seq", "now_s", "last_fix_s", paused.alias("paused"), (F.lit(False) if refused is None else F.coalesce(refused, F.lit(False))).alias("refused"))
    resumed = ~F.col("paused") & F.coalesce(F.lag("paused").over(ride), F.lit(True))
    t = t.withColumn("resumed", resumed).withColumn("started", F.row_number().over(ride) == 1)
    anchor = F.last(F.when(F.col("resumed") | F.col("started"), F.col("now_s")), ignorenulls=True).over(upto)
    t = t.withColumn("age_s", F.col("now_s") - F.greatest(anchor, "last_fix_s")).where("NOT paused AND last_fix_s IS NOT NULL")
    t = t.withColumn("loss", F.sum(F.when(F.col("now_s") - F.col("last_fix_s") < alert_s / 2, 1).otherwise(0)).over(upto))
    late = t.where(F.col("age_s") >= alert_s)
    taken = F.coalesce(F.sum((~F.col("refused")).cast("int")).over(Window.partitionBy("ride_id", "loss").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return late.withColumn("taken", taken).where("taken = 0").select("ride_id", "seq", "age_s")
