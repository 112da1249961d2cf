"""Rules on streams equal their stored-row forms, however rows arrive; restarts go on where they stopped."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import signals
from paceline.plans import live as plans
from paceline.streaming import alerts, live, ordered, race, replay, resumption

BEGIN = 1_700_000_000_000


def streamed(spark, rows, ddl, rule, until=5_000, files=3):
    df = spark.createDataFrame([(k, BEGIN + at, *rest) for k, at, *rest in rows], ddl)
    lo, hi = replay.bounds(df)
    folder = replay.arrived(df, "ride_id", lo, hi, hi + until, files)
    out = replay.finished(ordered.over_stream(replay.stream(spark, folder, df.schema), rule, "ride_id", f"{replay.delay_ms(lo, hi, files)} milliseconds"))
    return df, hi + until, sorted(map(tuple, out.collect()))


def random_rows(seed, value):
    r = random.Random(seed)
    out = []
    for ride in range(1, 4):
        at = 0
        for seq in range(40):
            at += r.choice([0, 1, 500, 2999, 3000, 3001, 4000, 9000, 20_000])
            out.append((ride, at, seq, *value(r, seq)))
    return out


@pytest.mark.parametrize("drop_first", [False, True])
def test_latest(spark, drop_first):
    rows = random_rows(1, lambda r, k: (r.choice("abcx"), r.choice([None, float(k)])))
    df, _, got = streamed(spark, rows, "ride_id long, at long, seq long, name string, value double", live.Latest(["a", "b", "c"], drop_first))
    want = signals.latest_together(df, ["a", "b", "c"])
    want = signals.without_first(want, "ride_id") if drop_first else want
    assert got == sorted(map(tuple, want.collect())) and got


@pytest.mark.parametrize("grace", [3000, 4000, 30_000])
def test_absences(spark, grace):
    rows = random_rows(2, lambda r, k: (r.random() < 0.5,))
    df, until, got = streamed(spark, rows, "ride_id long, at long, seq long, present boolean", live.Absence(grace))
    assert got == sorted(map(tuple, signals.absences(df, grace_ms=grace, until_ms=until).collect()))


@pytest.mark.parametrize("changed_only", [False, True])
def test_repeats(spark, changed_only):
    rows = random_rows(3, lambda r, k: (float(r.randrange(3)),))
    df, until, got = streamed(spark, rows, "ride_id long, at long, seq long, value double", live.Repeats(changed_only=changed_only))
    want = signals.shown(df, until_ms=until) if changed_only else signals.kept_alive(df, until_ms=until)
    assert got == sorted(map(tuple, want.collect()))


def test_losses(spark):
    def tick(r, k):
        return float(30 * k), r.choice([None, float(30 * k - 5), float(max(0, 30 * k - 100))]), r.random() < 0.3

    rows = random_rows(4, tick)
    df, _, got = streamed(spark, rows, "ride_id long, at long, seq long, now_s double, last_fix_s double, paused boolean", live.Losses())
    assert got == sorted(map(tuple, alerts.position_alerts(df).select("ride_id", "seq", "age_s").collect())) and got


def test_a_ride_without_rows_is_forgotten(spark):
    """After idle_ms its state goes: a first value is dropped anew."""
    rows = [(1, 0, 0, "a", 1.0), (1, 10, 1, "a", 2.0), (1, 9_000, 2, "a", 3.0), (1, 9_010, 3, "a", 4.0), (2, 30_000, 0, "a", 0.0)]
    df = spark.createDataFrame([(k, BEGIN + at, *rest) for k, at, *rest in rows], "ride_id long, at long, seq long, name string, value double")
    folder = replay.arrived(df, "ride_id", BEGIN, BEGIN + 30_000, BEGIN + 40_000, 30)
    got = {}
    for idle in (5_000, 60_000):
        out = replay.finished(ordered.over_stream(replay.stream(spark, folder, df.schema), live.Latest(["a"], drop_first=True), "ride_id", "2 seconds", idle_ms=idle))
        got[idle] = sorted(r["seq"] for r in out.where("ride_id = 1").collect())
    assert got == {5_000: [1, 3], 60_000: [1, 2, 3]}


def test_names_of_nested_columns():
    assert ordered.names("at bigint, g struct<a: double, b: array<struct<x: int, y: int>>>, n int") == ["at", "g", "n"]


def test_rules_need_no_spark():
    rule = live.Absence(4)
    state, out = ordered.run(rule, rule.first(), [(0, 0, False), (3, 1, False), (4, 2, True), (5, 3, False)], 20)
    assert out == [(4, "gone"), (4, "back"), (9, "gone")] and state == (False, 5, True)


def racing(spark, ticks, folder, initial=None):
    lo, hi = replay.bounds(ticks)
    arriving = replay.stream(spark, replay.arrived(ticks, "ride_id", lo, hi, hi + 1_000, 3), ticks.schema)
    return replay.finished(race.race_stream(arriving, f"{replay.delay_ms(lo, hi, 3)} milliseconds", initial), folder)


@pytest.fixture(scope="module")
def ticks(spark):
    t = plans.ticks(spark, "/root/testdata/sf0.001").where("ride_id < 6")
    return t.withColumns({"at": (F.round(F.col("elapsed_s") * 1000) + BEGIN).cast("bigint"), "seq": F.col("seq").cast("bigint")}).cache()


def rows_of(df):
    return {(r["ride_id"], r["seq"]): tuple(r) for r in df.collect()}


def test_a_race_stopped_and_handed_over_goes_on_unbroken(spark, ticks, tmp_path):
    """Two streams, the second with the first one's state: the gaps of one stream, and of stored ticks, tick by tick."""
    want = rows_of(race.race_batch(ticks))
    assert rows_of(racing(spark, ticks, str(tmp_path / "whole"))) == want
    got = rows_of(racing(spark, ticks.where("seq <= 25"), str(tmp_path / "one")))
    held = resumption.saved(spark, replay.log_of(str(tmp_path / "one")))
    assert held.count() == 6 and held.where("active").count() == 6
    about = held.select("ride_id", F.lit(7).alias("epoch"), F.lit("r").alias("route_key"), F.lit("BEST").alias("pick"), F.lit("HISTORY").alias("comparator"), F.lit(10).alias("saved_ms"))
    now = about.select("ride_id", "epoch", F.when(F.col("ride_id") == 2, "x").otherwise("r").alias("route_key"), "pick", F.lit(20).alias("now_ms"), F.lit(0.0).alias("now_m"), F.lit(0.0).alias("now_s"))
    told = resumption.judged(held, about, now)
    assert {r["ride_id"]: r["resumes"] for r in told.collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    got |= rows_of(racing(spark, ticks.where("seq > 25"), str(tmp_path / "two"), resumption.handed_over(told)))
    assert {k: v for k, v in got.items() if k[0] != 2} == {k: v for k, v in want.items() if k[0] != 2}
    fresh = rows_of(race.race_batch(ticks.where("seq > 25 AND ride_id = 2")))
    assert {k: v for k, v in got.items() if k[0] == 2 and k[1] > 25} == fresh


def test_idle_drops_a_race_only_where_it_was_active(spark, ticks, tmp_path):
    """A ride that ends leaves nothing to resume; one that was handed over and never gone on with stays."""
    end = ticks.withColumn("state", F.when((F.col("seq") == 25) & (F.col("ride_id") % 2 == 0), "idle").otherwise(F.col("state")))
    racing(spark, end.where("seq <= 25"), str(tmp_path / "a"))
    held = resumption.saved(spark, replay.log_of(str(tmp_path / "a")))
    assert {r["ride_id"] for r in held.collect()} == {1, 3, 5}
    idle = ticks.where("seq = 26").withColumn("state", F.lit("idle"))
    racing(spark, idle, str(tmp_path / "b"), resumption.handed_over(held.withColumn("resumes", F.lit(True))))
    again = resumption.saved(spark, replay.log_of(str(tmp_path / "b")))
    lead = lambda df: {r["ride_id"]: r["lead_s"] for r in df.collect()}
    assert lead(again) == lead(held)


def test_gates(spark):
    """Each gate alone, as the cut and the ride that asks have it."""
    cut = {"epoch": 5, "route_key": "r", "pick": "BEST", "comparator": "HISTORY", "saved_ms": 1_000}
    ask = {"epoch": 6, "route_key": "r", "pick": "BEST", "now_ms": 1_000 + 6 * 3_600_000, "now_m": 1_200.0, "now_s": 400.0}
    state = {"at_m": 1_100.0, "race_clock": 420.0}
    cases = [
        ({}, True), ({"now_ms": 1_001 + 6 * 3_600_000}, "recent"), ({"route_key": "s"}, "same_route"), ({"pick": "LAST"}, "same_pick"),
        ({"now_m": 1_401.0}, "continuous"), ({"now_m": 299.0}, "continuous"), ({"now_s": 389.0}, "continuous"), ({"now_s": 390.0}, True), ({"epoch": 5, "now_m": 0.0, "now_s": 0.0}, True),
    ]
    f = lambda rows, ddl: spark.createDataFrame([tuple(r.values()) for r in rows], ddl)
    blank = ", ".join(f"{c} double" if c in state else f"{c} string" for c in ordered.names(race.Racing.state))
    races = spark.createDataFrame([(k, *[state.get(c) for c in ordered.names(race.Racing.state)]) for k in range(len(cases) + 1)], f"ride_id int, {blank}")
    cuts = f([{"ride_id": k, **cut, **({"comparator": None} if k == len(cases) else {})} for k in range(len(cases) + 1)], "ride_id int, epoch long, route_key string, pick string, comparator string, saved_ms long")
    asks = f([{"ride_id": k, **ask, **(cases[k][0] if k < len(cases) else {})} for k in range(len(cases) + 1)], "ride_id int, epoch long, route_key string, pick string, now_ms long, now_m double, now_s double")
    got = {r["ride_id"]: r for r in resumption.judged(races, cuts, asks).collect()}
    for k, (_, want) in enumerate([*cases, ({}, "compared")]):
        failed = [g for g in resumption.GATES if not got[k][g]]
        assert (failed == [] and got[k]["resumes"]) if want is True else failed == [want], (k, failed)
