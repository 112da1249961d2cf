"""Races over ticks: one step, over stored ticks and over a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.formats import behind_metres
from paceline.operators.samples import spaced
from paceline.streaming.ghost import Ghost, followed
from paceline.streaming.odometer import MOVING, Event, Odometer, advanced, finite
from paceline.streaming.ordered import Rule, over_stream

GAPS = (
    "ride_id bigint, seq int, elapsed_s double, distance_m double, quality string, tag string, gap_time_s double,"
    " gap_distance_m double, matched_m double, filled_m double, ahead boolean, estimated boolean"
)
TICK = ("seq", "elapsed_s", "raw_m", "speed_ms", "history_tpm", "grade_tpm", "state")


@dataclass
class Race:
    odometer: Odometer = field(default_factory=Odometer)
    ghost: Ghost = field(default_factory=Ghost)
    clock: float | None = None
    raced_s: float = 0.0
    at: float = 0.0
    begun: bool = False
    verdict_seen: bool = False


def raced(r: Race, raw: float | None, speed: float | None, elapsed: float | None, history: float | None, grade: float | None, target: float | None = None, fix_fresh: bool = True) -> tuple[Race, str]:
    """One tick of a race and the tier that answered: SEG, GRADE, TGT or GP (none).

    target (m/s): race against a fixed speed and leave history alone.
    """
    r.odometer = o = advanced(r.odometer, raw, speed, elapsed)
    if finite(elapsed) is None or o.clock is None:
        return r, "GP"
    took = elapsed - r.clock if r.clock is not None else 0.0
    still = speed is not None and speed < MOVING and o.event == Event.SETTLING
    stuck = o.distance <= r.at and o.event != Event.HOLD
    if took < 0 or not (still or stuck):
        r.raced_s += took
    r.clock = elapsed
    offers = [("TGT", 1 / target)] if target is not None else [("SEG", history), ("GRADE", grade)]
    trusted = fix_fresh and o.quality == "LIVE"
    tag, pace = next(((t, p) for t, p in offers if trusted and p is not None), ("GP", None))
    if not (o.held and r.begun):  # what is held back is raced when it settles
        before = r.ghost.matched_m
        followed(r.ghost, o.distance, r.raced_s, pace)
        r.verdict_seen |= target is None and r.ghost.matched_m > before
        r.begun, r.at = True, o.distance
    return r, tag


def _ticked(ride: int, r: Race, tick: tuple) -> tuple[Race, list[tuple]]:
    """A race after a tick (seq, elapsed_s, raw_m, speed_ms, history_tpm, grade_tpm, state), and its row."""
    seq, elapsed, raw, speed, history, grade, state = tick
    if state == "idle":  # the ride ended
        return Race(), []
    if state == "paused":
        return r, []
    r, tag = raced(r, raw, speed, elapsed, history, grade)
    o, g = r.odometer, r.ghost
    return r, [(ride, seq, elapsed, o.distance, o.quality, tag, 0.0 - g.lead_s, g.lead_m, g.matched_m, g.filled_m, g.lead_s > 0, o.quality != "LIVE")]


def _steps(ride: int, ticks: list[tuple], r: Race) -> tuple[Race, list[tuple]]:
    out = []
    for tick in ticks:
        r, some = _ticked(ride, r, tick)
        out += some
    return r, out


def _in_order(ticks: pa.Table) -> list[tuple]:
    ticks = ticks.sort_by("seq")
    return list(zip(*(ticks.column(c).to_pylist() for c in TICK), strict=True))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _grouped(rows: DataFrame, key: str, ddl: str, work) -> DataFrame:
    """work(key, table) gives the result's rows as tuples, a group at a time."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])
    return rows.groupBy(key).applyInArrow(lambda k, t: _table(work(k[0].as_py(), t), schema), ddl)


def race_batch(ticks: DataFrame) -> DataFrame:
    """Gaps of stored ticks: ride_id, seq, elapsed_s, raw_m, speed_ms, history_tpm,
    grade_tpm, state.  A ride is one ordered group."""
    return _grouped(ticks.select("ride_id", *TICK), "ride_id", GAPS, lambda ride, t: _steps(ride, _in_order(t), Race())[1])


def post_route(ticks: DataFrame) -> DataFrame:
    """Gaps of ticks after the route's end: no road's history answers there, and behind
    the ghost the metres are the deficit at the gradient's pace, null without one."""
    gaps = race_batch(ticks.withColumn("history_tpm", F.lit(None).cast("double")))
    paced = gaps.join(ticks.select("ride_id", "seq", "grade_tpm"), ["ride_id", "seq"])
    behind = behind_metres(F.col("gap_time_s"), F.when(F.col("tag") == "GRADE", F.col("grade_tpm")))
    return paced.withColumn("gap_distance_m", F.when(F.col("gap_time_s") > 0, behind).otherwise(F.col("gap_distance_m"))).select(gaps.columns)


class Racing(Rule):
    """A ride's race over a stream of ticks: typed state, ticks in the order of their time.

    A ride that ends (idle) drops its race only if it was active here: a race
    that was handed over and not yet gone on with stays.
    """

    rows = "at bigint, seq bigint, elapsed_s double, raw_m double, speed_ms double, history_tpm double, grade_tpm double, state string"
    state = (
        "reading double, clock double, gained_m double, pending_m double, pending_s double, spent_s double, blind_s double, frozen_s double, cruise double, forward boolean, event string,"
        " lead_s double, lead_m double, matched_m double, filled_m double, ghost_m double, ghost_s double, path array<array<double>>,"
        " race_clock double, raced_s double, at_m double, begun boolean, verdict_seen boolean, active boolean"
    )
    out = GAPS.partition(", ")[2]

    def first(self) -> tuple[Race, bool]:
        return Race(), False

    def save(self, state: tuple[Race, bool]) -> tuple:
        r, active = state
        o, g = r.odometer, r.ghost
        return (o.reading, o.clock, o.gained_m, o.pending_m, o.pending_s, o.spent_s, o.blind_s, o.frozen_s, o.cruise, o.forward, str(o.event), g.lead_s, g.lead_m, g.matched_m, g.filled_m, g.at, g.clock, g.path, r.clock, r.raced_s, r.at, r.begun, r.verdict_seen, active)

    def load(self, row: tuple) -> tuple[Race, bool]:
        *odometer, event = row[:11]
        lead_s, lead_m, matched_m, filled_m, at, clock, path = row[11:18]
        ghost = Ghost(lead_s, lead_m, matched_m, filled_m, at, clock, [list(p) for p in path])
        return Race(Odometer(*odometer, Event(event)), ghost, *row[18:23]), bool(row[23])

    def step(self, state: tuple[Race, bool], row: tuple) -> tuple[tuple[Race, bool], list[tuple]]:
        race, active = state
        if row[-1] == "idle" and not active:
            return state, []
        race, out = _ticked(0, race, row[1:])
        return (race, active or row[-1] == "recording") if row[-1] != "idle" else self.first(), [x[1:] for x in out]


def race_stream(ticks: DataFrame, delay: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """Gaps over a stream of ticks (ride_id, at in milliseconds, and what ``race_batch`` takes), late by ``delay`` at most.

    initial: races to go on with, as ``resumption.handed_over`` gives them.
    """
    kinds = {c.split()[0]: c.split()[1] for c in Racing.rows.split(", ")}
    typed = ticks.select("ride_id", *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    return over_stream(typed, Racing(), "ride_id", delay, initial)


def odometers(ticks: DataFrame) -> DataFrame:
    """ride_id, seq, distance_m, quality, frozen_s of each tick."""

    def work(ride, t):
        o, out = Odometer(), []
        for seq, elapsed, raw, speed, *_ in _in_order(t):
            o = advanced(o, raw, speed, elapsed)
            out.append((ride, seq, o.distance, o.quality, o.frozen_s))
        return out

    return _grouped(ticks.select("ride_id", *TICK), "ride_id", "ride_id bigint, seq int, distance_m double, quality string, frozen_s double", work)


RECORD_M = 20.0


def recorded_tracks(samples: DataFrame) -> DataFrame:
    """ride_id, seq, lat, lng, distance_m, time_s, tail_m of each ride's samples.

    The track has a positioned sample every 20 m and the last one; tail_m, for
    the ride's key, counts samples without a position too, from the first one
    that has one.  A ride with fewer than two points has no track.  Samples that
    carry whole millimetres (d_mm) are spaced by these, without rounding.
    """
    whole = "d_mm" in samples.columns

    def work(ride, t):
        t = t.sort_by("seq")
        lat, lng, d, s = (t.column(c).to_pylist() for c in ("lat", "lng", "distance_m", "time_s"))
        here = [k for k in range(len(d)) if lat[k] is not None and lng[k] is not None]
        if not here:
            return []
        by, spacing = (t.column("d_mm").to_pylist(), RECORD_M * 1000) if whole else (d, RECORD_M)
        tail = d[here[0] + spaced(by[here[0] :], spacing)[-1]]
        kept = [here[k] for k in spaced([by[k] for k in here], spacing)]
        if d[here[-1]] > d[kept[-1]]:
            kept.append(here[-1])
        return [(ride, n, lat[k], lng[k], d[k], s[k], tail) for n, k in enumerate(kept)] if len(kept) > 1 else []

    return _grouped(samples.select("ride_id", "seq", "lat", "lng", "distance_m", "time_s", *["d_mm"] * whole), "ride_id", "ride_id bigint, seq int, lat double, lng double, distance_m double, time_s double, tail_m double", work)


def latest_a_second(ticks: DataFrame, ts: str = "ts", key: str = "ride_id") -> DataFrame:
    """At most one tick a second and ride, the latest: a tumbling window.

    On a stream, add a watermark of a minute or more first.
    """
    rest = [c for c in ticks.columns if c not in (key,)]
    out = ticks.groupBy(key, F.window(ts, "1 second").alias("w")).agg(F.max(F.struct(ts, *[c for c in rest if c != ts])).alias("x"))
    return out.select(key, F.col("w.start").alias("second"), "x.*")


def gap_stream(gaps: DataFrame) -> DataFrame:
    """What is published: seconds and metres, ahead positive, null while searching."""
    fine = F.col("gap_time_s").isNotNull() & ~F.isnan("gap_time_s")
    return gaps.select(
        "ride_id",
        "seq",
        F.when(fine, 0.0 - F.col("gap_time_s")).alias("seconds"),
        F.when(fine, F.col("gap_distance_m")).alias("metres"),
        F.col("estimated").cast("int").alias("estimated"),
        F.when(fine, "STREAMING").otherwise("SEARCHING").alias("status"),
    )
