"""The live functions: by hand, over stored ticks, and as a stream."""

from __future__ import annotations

import pytest

from paceline.plans import live
from paceline.functions import formats
from paceline.operators import laps
from paceline.streaming import alerts, race
from paceline.streaming.ghost import KEEP_M, Ghost, followed, rebased, resumed
from paceline.streaming.odometer import Odometer, advanced
from paceline.streaming.race import Race, Racing, raced


def drive(ticks, o=None):
    o = o or Odometer()
    for raw, speed, t in ticks:
        o = advanced(o, raw, speed, t)
    return o


def test_coasting_short_and_long():
    o = drive([(100, 10, 0)] + [(100, 10, t) for t in (1, 2, 3)])
    assert (o.distance, o.quality) == (130, "COASTING")
    o = drive([(100, 10, 0)] + [(100, 10, t) for t in range(1, 41)])
    assert (o.distance, o.quality) == (500, "LONG_LOSS")


def test_short_freeze_is_held_back_and_settles():
    o = drive([(100, 10, 0), (100, 10, 1)])
    assert (o.distance, o.quality, o.held) == (100, "LIVE", True)
    o = advanced(o, 120, 10, 2)
    assert (o.distance, o.held, o.event) == (120, False, "SETTLING")


def test_without_speed_the_last_one_is_used_for_a_while():
    o = drive([(100, 10, 0), (100, None, 1), (100, None, 2)])
    assert o.distance == 120
    o = drive([(100, 10, 0)] + [(100, None, t) for t in range(1, 60)])
    assert o.distance == 400


def test_standing_still_and_recovery():
    o = drive([(100, 10, 0)] + [(100, 0, t) for t in range(1, 20)])
    assert (o.distance, o.quality) == (100, "LIVE")
    o = advanced(o, 140, 8, 20)
    assert (o.distance, o.quality) == (140, "LIVE")


def test_ghost_ahead_neutral_and_novel():
    g = Ghost()
    for k in range(6):
        followed(g, 20.0 * k, 3.0 * k, 0.2)
    assert (g.lead_s, g.lead_m) == pytest.approx((5.0, 25.0))
    followed(g, 150.0, 30.0, None)
    assert (g.lead_s, g.matched_m, g.filled_m) == pytest.approx((5.0, 100.0, 50.0))
    g = Ghost()
    for k in range(300):
        followed(g, 100.0 * k, 10.0 * k, None)
    assert g.lead_s == pytest.approx(0.0)


def test_the_path_of_a_long_ride_stays_short():
    g = Ghost()
    for k in range(20_000):
        followed(g, 10.0 * k, 2.0 * k, 0.2)
    assert g.lead_s == pytest.approx(0.0, abs=1e-6) and len(g.path) < 3 * KEEP_M / 20


def test_ghost_against_a_fixed_pace_is_its_closed_form():
    g, d = Ghost(), 0.0
    for t in range(900):
        followed(g, d, float(t), 0.2)
        assert g.lead_s == pytest.approx(d * 0.2 - t, abs=1e-6)
        d += 3 + t % 5


def test_backward_keeps_the_lead_and_rebase_and_resume():
    g = Ghost()
    for k in range(10):
        followed(g, 20.0 * k, 3.0 * k, 0.2)
    lead = g.lead_s
    followed(g, 100.0, 27.0, 0.2)
    assert g.lead_s == pytest.approx(lead) and all(c[0] <= 100 for c in g.path)
    rebased(g, 500.0, 127.0)
    followed(g, 500.0, 127.0, 0.2)
    assert g.lead_s == pytest.approx(lead)
    resumed(g, 7.0)
    followed(g, 600.0, 200.0, 0.2)
    assert g.lead_s == pytest.approx(7.0)


def _fold(spark, points, length=100.0):
    rows = spark.createDataFrame([(1, float(d), float(t)) for d, t in points], "lap_id long, route_dist_m double, time_s double")
    return {r["k"]: r["dt_s"] for r in laps.lap_folds(rows, length).collect()}


def test_lap_fold(spark):
    assert _fold(spark, [(0, 0), (100, 20)]) == pytest.approx({1: 5.0, 2: 5.0, 3: 5.0, 4: 5.0})
    assert _fold(spark, [(0, 0), (25, 5), (50, 205), (100, 215)]) == pytest.approx({1: 5.0, 2: 50.0, 3: 5.0, 4: 5.0})
    assert _fold(spark, [(0, 0)]) == {}


def test_lap_fold_skips_what_is_too_fast(spark):
    """Nodes at 25 m steps, the second one reached in no time: it and its neighbour do not answer."""
    assert _fold(spark, [(0, 0), (25, 5), (50, 5.1), (75, 20), (100, 25)]) == pytest.approx({1: 5.0, 4: 5.0})


def test_fold_of_laps_weighs_as_step_by_step(spark):
    from pyspark.sql import functions as F

    for n in (1, 3, 4, 5, 9):
        x = [float(3 * k % 7 + 1) for k in range(n)]
        mean = 0.0
        for k, v in enumerate(x):
            mean = (mean * k + v) / (k + 1) if k < 4 else 0.25 * v + 0.75 * mean
        rows = spark.createDataFrame([(k, 2, v) for k, v in enumerate(x)], "lap_id long, k int, dt_s double")
        got = laps.fold_of_laps(rows, F.col("lap_id")).first()
        assert (got["k"], got["dt_s"], got["min_dt_s"], got["last_dt_s"], got["count"]) == (2, pytest.approx(mean), min(x), x[-1], n)


def test_alert_fires_once_an_episode(spark):
    rows = [(1, k, 10.0 * k, 0.0 if k < 15 else 150.0, False) for k in range(25)] + [(2, k, 10.0 * k, None, k < 9) for k in range(12)]
    got = alerts.position_alerts(spark.createDataFrame(rows, "ride_id long, seq int, now_s double, last_fix_s double, paused boolean"))
    assert sorted((r["ride_id"], r["seq"]) for r in got.collect()) == [(1, 6), (1, 21)]


def test_behind_metres(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(10.0, 0.2), (10.0, None), (1.0, 0.0), (1.0, float("inf"))], "s double, tpm double")
    assert [r[0] for r in rows.select(formats.behind_metres(F.col("s"), F.col("tpm"))).collect()] == [pytest.approx(-50.0), None, None, None]


def test_a_target_needs_trust_too():
    r = Race()
    assert raced(r, 0.0, 6.0, 0.0, 0.3, None, target=5.0)[1] == "TGT"
    assert raced(r, 10.0, 6.0, 2.0, 0.3, None, target=5.0, fix_fresh=False)[1] == "GP"
    assert raced(r, 20.0, 6.0, 4.0, None, 0.2)[1] == "GRADE" and raced(r, 30.0, 6.0, 6.0, 0.3, 0.2)[1] == "SEG"


def test_recorder_keeps_spacing_and_the_end(spark):
    rows = [(1, k, None if k == 0 else 41.0, None if k == 0 else 2.0, d, float(k)) for k, d in enumerate((0.0, 5.0, 19.0, 25.0, 30.0))] + [(2, 0, 1.0, 2.0, 0.0, 0.0)]
    got = race.recorded_tracks(spark.createDataFrame(rows, "ride_id long, seq int, lat double, lng double, distance_m double, time_s double")).orderBy("seq").collect()
    assert [(r["ride_id"], r["distance_m"], r["tail_m"]) for r in got] == [(1, 5.0, 25.0), (1, 25.0, 25.0), (1, 30.0, 25.0)]


def test_state_survives_its_columns():
    r = Race()
    for k in range(10):
        r, _ = raced(r, 20.0 * k, 6.0, 3.0 * k, 0.2, None)
    rule = Racing()
    assert rule.load(rule.save((r, True))) == (r, True)


def test_idle_starts_a_new_race(spark):
    rows = [(1, k, 3.0 * k, 20.0 * k, 6.0, 0.2, None, "idle" if k == 5 else "recording") for k in range(10)]
    t = spark.createDataFrame(rows, "ride_id long, seq int, elapsed_s double, raw_m double, speed_ms double, history_tpm double, grade_tpm double, state string")
    got = {r["seq"]: r["gap_time_s"] for r in race.race_batch(t).collect()}
    assert got[4] == pytest.approx(-4.0) and got[6] == pytest.approx(0.0) and got[9] == pytest.approx(-3.0)
