"""The route tracker and its marker on a straight route, against the places ridden."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.operators import joins
from paceline.streaming import tracking

DEG = 1 / 111_195.0
TICK = "ride_id long, seq int, route_id long, lat double, lng double, heading double, odo_m double, moving boolean, fresh boolean"


@pytest.fixture(scope="module")
def segs(spark):
    rows = [(1, i, 0.0, 100.0 * i * DEG) for i in range(101)]
    return joins.segments(spark.createDataFrame(rows, "route_id long, i int, lat double, lng double"))


def follow(spark, segs, ticks):
    rows = [(1, k, 1, lat * DEG, x * DEG, h, odo, True, fresh) for k, (x, lat, h, odo, fresh) in enumerate(ticks)]
    t = spark.createDataFrame(rows, TICK)
    return t, [(r["place_m"], r["reliable"]) for r in tracking.tracked(t, segs).orderBy("seq").collect()]


def test_it_follows_and_holds_while_stale(spark, segs):
    ticks = [(20.0 * k, 10.0, 90.0, 20.0 * k, k != 3) for k in range(10)]
    _, got = follow(spark, segs, ticks)
    want = [20.0 * k if k != 3 else 40.0 for k in range(10)]
    assert [p for p, _ in got] == pytest.approx(want, abs=0.1) and all(r for _, r in got)


def test_the_wrong_way_has_no_place(spark, segs):
    _, got = follow(spark, segs, [(20.0 * k, 10.0, 270.0, 20.0 * k, True) for k in range(3)])
    assert got == [(None, True)] * 3


def test_a_jump_beyond_the_window_is_found_again_after_five_ticks(spark, segs):
    on = [(20.0 * k, 0.0, 90.0, 20.0 * k, True) for k in range(5)]
    off = [(80.0 + 20 * k, 300.0, 90.0, 100.0 + 20.0 * k, True) for k in range(2)]
    far = [(5000.0 + 20 * k, 0.0, 90.0, 200.0 + 20.0 * k, True) for k in range(5)]
    _, got = follow(spark, segs, on + off + far)
    places = [p for p, _ in got]
    assert places[5:9] == pytest.approx([80.0] * 4, abs=0.1)
    assert places[9] == pytest.approx(5040.0, abs=0.1) and places[-1] == pytest.approx(5080.0, abs=0.1)


def test_a_lost_ride_holds_its_marker_and_a_finished_one_has_none_on_the_next_lap(spark, segs):
    on = [(200.0 * k, 0.0, 90.0, 200.0 * k, True) for k in range(3)]
    lost = [(400.0, 900.0, 90.0, 420.0 + 20 * k, True) for k in range(7)]
    ticks, got = follow(spark, segs, on + lost)
    assert [r for _, r in got] == [True] * 7 + [False] * 3
    places = tracking.tracked(ticks, segs).join(ticks.select("ride_id", "seq", "route_id", "odo_m"), ["ride_id", "seq"]).withColumn("lead_s", F.lit(10.0))
    curve = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10_000.0, 2000.0)], "route_id long, k int, distance_m double, time_s double")
    shown = [r["marker_m"] for r in tracking.markers(places, curve).orderBy("seq").collect()]
    assert shown == pytest.approx([0.0, 150.0, 350.0] + [350.0] * 7, abs=0.1)
    lap = spark.createDataFrame([(1, 0, 1, 100.0, True, 100.0, 0.0), (1, 1, 1, 9980.0, True, 9980.0, 0.0), (1, 2, 1, 50.0, True, 10_100.0, 0.0), (1, 3, 1, 90.0, True, 10_140.0, 0.0)], "ride_id long, seq int, route_id long, place_m double, reliable boolean, odo_m double, lead_s double")
    assert [r["marker_m"] for r in tracking.markers(lap, curve).orderBy("seq").collect()] == [pytest.approx(100.0), pytest.approx(9980.0), None, None]
