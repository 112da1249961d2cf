"""Points that carry whole millimetres are spaced by them, not by differences of doubles."""

from __future__ import annotations

from paceline.operators import imports, samples
from paceline.streaming import race

#: 20 m apart to the millimetre, yet 1024.003 - 1004.003 < 20 in doubles.
MM = [0, 1_004_003, 1_024_003, 1_038_000]
KEPT = [1, 2, 3]


def points(spark, key):
    rows = [(1, k + 1, 0.0, 0.0, mm / 1000.0, float(k), mm) for k, mm in enumerate(MM)]
    return spark.createDataFrame(rows, f"{key} long, seq int, lat double, lng double, distance_m double, time_s double, d_mm long")


def test_the_doubles_fall_short():
    assert MM[2] - MM[1] == 20_000 and MM[2] / 1000.0 - MM[1] / 1000.0 < 20.0


def test_decimation_by_millimetres(spark):
    pts = points(spark, "track_id")
    assert sorted(r["seq"] for r in samples.decimated(pts).collect()) == KEPT
    assert sorted(r["seq"] for r in samples.decimated(pts.drop("d_mm")).collect()) == [1, 2, 4]


def test_imports_thin_by_millimetres(spark):
    assert sorted(r["seq"] for r in imports.thinned(points(spark, "path")).collect()) == KEPT


def test_the_recorder_spaces_by_millimetres(spark):
    got = race.recorded_tracks(points(spark, "ride_id")).orderBy("seq").collect()
    assert [round(r["distance_m"] * 1000) for r in got] == [0, 1_004_003, 1_024_003, 1_038_000]
