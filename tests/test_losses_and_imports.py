"""Position losses case by case, imports thinned first, aggregates saved where none can be read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.operators import imports, store
from paceline.streaming import alerts

TICK = "ride_id long, seq int, now_s double, last_fix_s double, paused boolean"

#: What a ride's ticks are (now, last fix, paused) and at which it alerts.
LOSSES = {
    "never had a fix": ([(100, None, 0), (400, None, 0), (500, None, 1), (900, None, 0)], []),
    "an old fix counts from the start": ([(100, 20, 0), (159, 20, 0), (160, 20, 0), (400, 20, 0)], [160]),
    "a loss that spans a pause is one": ([(0, None, 0), (100, 30, 0), (200, 30, 1), (300, 30, 0), (301, 30, 0), (400, 30, 0)], [100]),
    "a second loss after a recovery": ([(0, None, 0), (500, 499, 0), (560, 500, 0), (580, 551, 0), (700, 551, 0)], [560, 700]),
    "a fix of 40 s does not end a loss": ([(0, None, 0), (60, 0, 0), (100, 60, 0), (125, 60, 0)], [60]),
    "a pause gives a grace": ([(0, None, 0), (900, 10, 1), (901, 10, 0), (959, 10, 0), (961, 10, 0)], [961]),
    "a parked rider with fixes": ([(k, k - k % 5, 0) for k in range(300)], []),
    "a fix while paused does not end a loss": ([(0, None, 0), (100, 10, 0), (150, 149, 1), (200, 149, 0), (261, 149, 0)], [100]),
    "the first fix after a pause does": ([(0, None, 0), (100, 10, 0), (150, 149, 1), (161, 160, 0), (221, 160, 0)], [100, 221]),
}


def test_losses(spark):
    rows = [(k, n, float(now), None if fix is None else float(fix), bool(paused)) for k, (ticks, _) in enumerate(LOSSES.values()) for n, (now, fix, paused) in enumerate(ticks)]
    got = alerts.position_alerts(spark.createDataFrame(rows, TICK)).join(spark.createDataFrame(rows, TICK), ["ride_id", "seq"]).collect()
    for k, (name, (_, want)) in enumerate(LOSSES.items()):
        assert sorted(r["now_s"] for r in got if r["ride_id"] == k) == want, name


def test_a_refused_alert_is_tried_again(spark):
    rows = [(1, k, float(now), 5.0, False) for k, now in enumerate((0, 70, 71, 72, 73))]
    got = alerts.position_alerts(spark.createDataFrame(rows, TICK), refused=F.col("seq") < 3)
    assert sorted(r["seq"] for r in got.collect()) == [1, 2, 3]


FILE = "path string, size long, mtime long, source string, started_ms long"
POINT = "path string, seq int, lat double, lng double, distance_m double, time_s double, ele_m double"
RECORDED = "track_id long, source string, source_key string, seq int, lat double, lng double, distance_m double, time_s double, ele_m double"


def ride(path, n, step):
    return [(path, k, 0.0, 0.0, step * k, float(k), 100.0 + k) for k in range(n)]


@pytest.fixture(scope="module")
def imported(spark):
    files = [(p, 1, 10 + k, "FIT_IMPORT", 6_000_000) for k, p in enumerate(("a", "b", "c", "d", "e"))] + [("f", 1, 20, "FIT_IMPORT", 6_600_000)]
    pts = ride("a", 20, 7.0) + ride("b", 20, 7.0) + ride("c", 3, 9.0) + ride("d", 1, 1.0) + ride("f", 20, 7.0)
    own = [(9, "RECORDED", "110:12", k, 0.0, 0.0, 21.0 * k, 3.0 * k, None) for k in range(7)]
    return imports.imported(spark.createDataFrame(files, FILE), spark.createDataFrame(pts, POINT), spark.createDataFrame([], "path string, size long, mtime long"), spark.createDataFrame(own, RECORDED))


def test_imports_are_thinned_then_keyed_and_stored(imported):
    """20 points 7 m apart: 7 are left, the last at 126 m, and that is what the key and the store have."""
    said = {r["path"]: (r["outcome"], r["enriched"]) for r in imported.outcomes.collect()}
    assert said == {"a": ("imported", False), "b": ("duplicate", False), "c": ("invalid", False), "d": ("invalid", False), "e": ("failed", False), "f": ("duplicate", True)}
    added = imported.added.orderBy("seq").collect()
    assert [(r["path"], r["seq"], r["distance_m"], r["source_key"]) for r in added] == [("a", k, 7.0 * k, "100:12") for k in range(0, 20, 3)]


def test_a_scan_meets_its_live_recording(imported):
    """The key from the last kept point (126 m) is the recording's; the full length (133 m) is another."""
    assert {r["track_id"] for r in imported.completed.collect()} == {9}
    assert [r["ele_m"] for r in imported.completed.orderBy("seq").collect()][1:] == pytest.approx([103.0, 106.0, 109.0, 112.0, 115.0, 118.0])


def test_save_if_absent_replaces_what_cannot_be_read(spark):
    kind = "route_key string, schema_version int, updated_ms long"
    old = spark.createDataFrame([("stale", 0, 1), ("new", 4, 1), ("good", 2, 1), ("other", 0, 1)], kind)
    fresh = spark.createDataFrame([("stale", 3, 9), ("new", 3, 9), ("good", 3, 9), ("none", 3, 9)], kind)
    assert sorted(map(tuple, store.updated(old, fresh, replace=False).collect())) == [("good", 2, 1), ("new", 3, 9), ("none", 3, 9), ("other", 0, 1), ("stale", 3, 9)]
