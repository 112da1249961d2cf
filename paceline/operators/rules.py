"""Decisions of a race as column expressions: one row a situation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.formats import target_ms

MARGIN_M = 300.0
SLACK_S = 30.0
DEFER_MS = 60_000
TOP_SPEED = 30.0


def publication(kind: Column, verdict_seen: Column, held: Column, published: Column) -> Column:
    """What becomes of a tick's gap: no verdict yet, wait, or out."""
    return F.when((kind == "HISTORY") & ~verdict_seen, "INACTIVE").when(held & published, "HOLD").otherwise("PUBLISH")


def gate_resume(interstitial: Column, held: Column) -> Column:
    return F.when(~interstitial, "NORMAL").when(held, "WAIT_REPUBLISH").otherwise("REANCHOR")


def without_route(racing: Column, enabled: Column, interstitial: Column, held: Column) -> Column:
    """What a tick does when no route is loaded."""
    gate = gate_resume(interstitial, held)
    post = F.when(gate == "NORMAL", "POST_STEP").when(gate == "REANCHOR", "POST_REANCHOR_THEN_STEP").otherwise("POST_WAIT_REPUBLISH")
    return F.when(~racing, "VP").when(~enabled, "END_RACE_THEN_VP").otherwise(post)


def inactive_duties(interstitial: Column, racing: Column, origin: Column, route: Column) -> Column:
    return F.struct((~interstitial & racing).alias("snapshot"), origin.alias("refresh_origin"), (racing & route).alias("refresh_checkpoint"))


def _carries_on(saved_m: Column, saved_s: Column, now_m: Column) -> Column:
    """The odometer goes on from where it was saved."""
    return (saved_s >= 0) & (saved_m > MARGIN_M) & (now_m > MARGIN_M) & (F.abs(now_m - saved_m) <= MARGIN_M)


def same_ride(saved_epoch: Column, saved_m: Column, saved_s: Column, epoch: Column, now_m: Column, now_s: Column) -> Column:
    """By the ride's epoch, else by both clocks: distance near and time not behind."""
    return (saved_epoch == epoch) | (_carries_on(saved_m, saved_s, now_m) & (now_s >= saved_s - SLACK_S))


def origin_decision(saved_epoch: Column, saved_m: Column, saved_s: Column, age_ms: Column, epoch: Column, now_m: Column, now_s: Column, deferred_ms: Column, max_age_ms: int) -> Column:
    """ADOPT a saved origin, start FRESH, or DEFER while the clock may be stale."""
    stale = saved_epoch.isNull() | (age_ms > max_age_ms)
    behind = _carries_on(saved_m, saved_s, now_m) & (now_s < saved_s - SLACK_S)
    adopt = same_ride(saved_epoch, saved_m, saved_s, epoch, now_m, now_s)
    return F.when(stale, "FRESH").when(adopt, "ADOPT").when(behind & (deferred_ms < DEFER_MS), "DEFER").otherwise("FRESH")


def coherent(distance_m: Column, elapsed_s: Column) -> Column:
    return distance_m <= elapsed_s * TOP_SPEED + MARGIN_M


def reminder(asked: Column, last_ms: Column, now_ms: Column, times: int = 3, early_ms: int = 72 * 3_600_000, late_ms: int = 10 * 86_400_000) -> Column:
    """Whether to remind: some times soon, then rarely; a clock set back fires."""
    wait = F.when(asked < times, early_ms).otherwise(late_ms)
    return last_ms.isNull() | (now_ms < last_ms) | (now_ms - last_ms >= wait)


def resolved(asked: DataFrame, settings: DataFrame, defaults: dict) -> DataFrame:
    """asked (profile_id) with the values that hold: the profile's own, or the
    defaults where it is blank, unknown or says use_global; master switches all off."""
    own = settings.select(*[F.col(c).alias(f"p_{c}") for c in settings.columns])
    both = asked.join(own, (F.trim("profile_id") != "") & (F.col("profile_id") == F.col("p_profile_id")), "left")
    inherit = F.col("p_profile_id").isNull() | F.col("p_use_global")
    pick = lambda c: F.when(inherit, F.lit(defaults[c])).otherwise(F.col(f"p_{c}"))
    return both.select(
        *asked.columns,
        (F.lit(defaults["master"]) & F.when(inherit, True).otherwise(F.col("p_enabled"))).alias("active"),
        target_ms(pick("target_speed_ms")).alias("target_speed_ms"),
        F.coalesce("p_profile_name", F.lit("")).alias("profile_name"),
        pick("race_enabled").alias("race_enabled"),
        pick("ghost_pick").alias("ghost_pick"),
    )


def learned(settings: DataFrame, seen: DataFrame) -> DataFrame:
    """The roster after profiles (profile_id, profile_name) were seen: renamed, added,
    and without others of the same name."""
    fresh = seen.where(F.trim("profile_id") != "").select("profile_id", F.col("profile_name").alias("new_name"))
    stale = fresh.select(F.col("profile_id").alias("keep_id"), "new_name")
    pruned = settings.join(stale, (F.col("profile_name") == F.col("new_name")) & (F.col("profile_id") != F.col("keep_id")), "left_anti")
    renamed = pruned.join(fresh, "profile_id", "left").withColumn("profile_name", F.coalesce("new_name", "profile_name")).select(*settings.columns)
    added = fresh.join(settings.select("profile_id"), "profile_id", "left_anti").select("profile_id", F.col("new_name").alias("profile_name"))
    return renamed.unionByName(added, allowMissingColumns=True)
