"""Live values over stored signals: latest values together, edges, holds, re-emission.

Every function takes rows of a key in order of ``at`` (a time, milliseconds where
there is a default), then ``seq``, and works in
windows of one key.  Over a stream, the rules of ``streaming.live`` give the same.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GLIDE_MS = 800
HEARTBEAT_MS = 3000
GRACE_MS = 4000


def _order(key: str, *ties: str):
    return Window.partitionBy(key).orderBy("at", *ties)


def latest_together(values: DataFrame, names: list[str], key: str = "ride_id") -> DataFrame:
    """key, at, seq and the latest value of each name, at every change once all have one.

    values: key, at, seq, name, value.
    """
    upto = _order(key, "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("name") == n, F.col("value")), ignorenulls=True).over(upto).alias(n) for n in names]
    return values.where(F.col("name").isin(names)).select(key, "at", "seq", *last).dropna(subset=names)


def without_first(values: DataFrame, subscription: str) -> DataFrame:
    """values without each subscription's first emission, which may replay what is stale."""
    return values.withColumn("n_", F.row_number().over(_order(subscription, "seq"))).where("n_ > 1").drop("n_")


def glided(values: DataFrame, after_ms: int, key: str = "ride_id", glide_ms: int = GLIDE_MS) -> DataFrame:
    """key, seq, shown: what is drawn after_ms after each value, on the way from the one before, never ahead."""
    w = _order(key, "seq")
    was, since = F.lag("value").over(w), F.lag("at").over(w)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(after_ms / glide_ms)))
    moves = was.isNotNull() & (F.col("at") > since)
    return values.select(key, "seq", F.when(moves, was + share * (F.col("value") - was)).otherwise(F.col("value")).alias("shown"))


def changes(events: DataFrame, kind: str, key: str) -> DataFrame:
    """events whose kind differs from the one before, with ``was`` and the time held until the next change."""
    w = _order(key, "seq")
    edges = events.withColumn("was", F.lag(kind).over(w)).where(~F.col("was").eqNullSafe(F.col(kind)))
    return edges.withColumn("held_ms", F.lead("at").over(w) - F.col("at"))


def absences(states: DataFrame, key: str = "ride_id", grace_ms: int = GRACE_MS, until_ms: int | None = None) -> DataFrame:
    """key, at, kind: ``gone`` once present has been false for grace_ms, ``back`` when it is true after that.

    until_ms: the time up to which states are known; else that of a key's last row.
    """
    edges = changes(states, "present", key)
    end = states.groupBy(key).agg(F.max("at").alias("end"))
    away = edges.where("NOT present").join(end, key).withColumn("end", F.col("end") if until_ms is None else F.lit(until_ms))
    held = away.where(F.coalesce("held_ms", F.col("end") - F.col("at")) >= grace_ms)
    gone = held.select(key, (F.col("at") + grace_ms).alias("at"), F.lit("gone").alias("kind"))
    return gone.unionByName(held.where("held_ms IS NOT NULL").select(key, (F.col("at") + F.col("held_ms")).alias("at"), F.lit("back").alias("kind")))


def torn_down(states: DataFrame, key: str = "ride_id", grace_ms: int = GRACE_MS) -> DataFrame:
    """key, at of the teardowns: an absence (present is false) that lasts for grace_ms."""
    return absences(states, key, grace_ms).where("kind = 'gone'").select(key, "at")


def kept_alive(emissions: DataFrame, key: str = "ride_id", every_ms: int = HEARTBEAT_MS, until_ms: int | None = None) -> DataFrame:
    """emissions with repeats of each one every every_ms until the next: key, at, seq, value, repeat.

    until_ms: the last one is repeated until then; else it is not.
    """
    gap = F.lead("at").over(_order(key, "seq")) - F.col("at")
    if until_ms is not None:
        gap = F.coalesce(gap, until_ms - F.col("at") + 1)
    n = F.greatest(F.lit(0), F.floor((gap - 1) / every_ms)).cast("int")
    spread = emissions.withColumn("n_", F.coalesce(n, F.lit(0))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("n_"))))
    return spread.select(key, (F.col("at") + F.col("repeat") * every_ms).alias("at"), "seq", "value", "repeat")


def shown(values: DataFrame, key: str = "ride_id", every_ms: int = HEARTBEAT_MS, until_ms: int | None = None) -> DataFrame:
    """What is drawn of values: those that differ from the one shown, each again every every_ms while it is shown."""
    return kept_alive(changes(values, "value", key).select(key, "at", "seq", "value"), key, every_ms, until_ms)


def arbitrated(events: DataFrame, key: str = "ride_id") -> DataFrame:
    """Events of the source that has the word: replay while it is open, live otherwise.

    events: key, at, seq, kind (open, close, replay, live).
    """
    upto = _order(key, "seq").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("kind").isin("open", "close"), F.col("kind")), ignorenulls=True).over(upto)
    is_open = F.coalesce(state == "open", F.lit(False))
    return events.withColumn("open_", is_open).where((F.col("kind") == "replay") & F.col("open_") | (F.col("kind") == "live") & ~F.col("open_")).drop("open_")


def emitted(markers: DataFrame, least_m: float, key: str = "ride_id") -> DataFrame:
    """key, seq, action (show, hide) of the markers that change what is shown.

    markers: key, seq, place_m (null: nothing to show), reassert.  A marker is
    shown when nothing is, when it lies least_m from the one shown last, or when
    asked to reassert it; which one was shown last depends on all before, so a
    ride is one ordered group.
    """

    def run(ride: pa.Table) -> pa.Table:
        ride = ride.sort_by("seq")
        shown, out = None, []
        for k, seq, place, again in zip(*(ride.column(c).to_pylist() for c in (key, "seq", "place_m", "reassert")), strict=True):
            if place is None:
                action = "hide" if shown is not None else None
            else:
                action = "show" if shown is None or again or abs(place - shown) >= least_m else None
            if action:
                shown = place
                out.append((k, seq, action))
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[key, "seq", "action"])

    asked = markers.select(F.col(key).cast("bigint").alias(key), F.col("seq").cast("bigint").alias("seq"), F.col("place_m").cast("double").alias("place_m"), "reassert")
    return asked.groupBy(key).applyInArrow(run, f"{key} bigint, seq bigint, action string")


def trusted_fix(lat: Column, lng: Column, accuracy_m: Column, good_m: float = 50.0) -> Column:
    """Whether a position can be relied on."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine(lat) & fine(lng) & fine(accuracy_m) & (accuracy_m <= good_m)
