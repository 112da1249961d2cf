"""Nearest segments by rings, overlays cut along curves, the gradient model kept up to date."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import grade, grade_store, joins, laps, route
from paceline.sources import rides

SEG = "seg_id string, route_id int, start_m double, end_m double, label string, curve array<struct<d: double, t: double>>"


def brute_nearest(points, segs):
    out = {}
    for pid, rid, lat, lng in points:
        best = None
        for s in segs:
            if s["route_id"] != rid:
                continue
            kx = max(1.0, 111_320.0 * math.cos(math.radians(s["a_lat"])))
            bx, by = (s["b_lng"] - s["a_lng"]) * kx, (s["b_lat"] - s["a_lat"]) * 111_320.0
            px, py = (lng - s["a_lng"]) * kx, (lat - s["a_lat"]) * 111_320.0
            t = min(1.0, max(0.0, (px * bx + py * by) / (bx * bx + by * by))) if bx or by else 0.0
            d = math.hypot(px - t * bx, py - t * by)
            if best is None or (round(d, 6), s["i"]) < best:
                best = (round(d, 6), s["i"])
        if best:
            out[pid] = best
    return out


def test_nearest_by_rings(spark, monkeypatch):
    """Points on, near, far from and 300 km off their routes, at several latitudes; routes crossing themselves."""
    r = random.Random(6)
    vertices, points = [], []
    for rid, lat0 in enumerate((0.0, 45.0, -68.0)):
        lat, lng = lat0, 10.0
        for i in range(40):
            vertices.append((rid, i, lat, lng))
            lat, lng = lat + r.uniform(-2e-3, 2e-3), lng + r.uniform(-4e-3, 4e-3)
        for k in range(60):
            spread = r.choice([0.0, 1e-4, 1e-3, 1e-2, 0.3])
            base = r.choice([v for v in vertices if v[0] == rid])
            points.append((f"{rid}:{k}", rid, base[2] + r.uniform(-spread, spread), base[3] + r.uniform(-spread, spread)))
    points += [("off", 0, 3.0, 10.0), ("none", 9, 0.0, 0.0)]
    segs = joins.segments(spark.createDataFrame(vertices, "route_id int, i int, lat double, lng double")).cache()
    asked = spark.createDataFrame(points, "id string, route_id int, lat double, lng double")
    got = {x["id"]: x for x in joins.project_nearest(asked, segs).collect()}
    want = brute_nearest(points, segs.collect())
    assert got.keys() == want.keys() and "none" not in got
    # at a corner two segments are equally near but for rounding
    assert all(got[k]["perp_m"] == pytest.approx(d, abs=1e-5) and abs(got[k]["i"] - i) <= 1 or got[k]["perp_m"] == pytest.approx(d, abs=1e-9) for k, (d, i) in want.items())
    # within 200 km no point meets its whole route
    monkeypatch.setattr(joins, "feet", lambda *a: pytest.fail("a whole route"))
    monkeypatch.setattr(joins, "FAR_M", 1e9)
    assert joins.project_nearest(asked.where("route_id < 3 AND id <> 'off'"), segs).count() == 180


def seg(name, start, end, curve, label="PR 9:59"):
    return (name, 1, float(start), float(end), label, [(float(d), float(t)) for d, t in curve])


def overlaid(spark, primary, secondary):
    got = route.overlay(spark.createDataFrame(primary, SEG), spark.createDataFrame(secondary, SEG)).collect()
    return sorted((r["seg_id"], r["start_m"], r["end_m"], r["label"], [(round(s["d"], 6), round(s["t"], 6)) for s in r["curve"]]) for r in got)


def test_overlay_cuts_and_rebases(spark):
    """A ride of 450..5000 m under an average of 0..500 m keeps 500..5000 m, from 0 metres and 0 seconds."""
    own = seg("avg", 0, 500, [(0, 0), (500, 50)])
    ride = seg("ride", 450, 5000, [(0, 0), (100, 30), (2000, 500), (4550, 1000)])
    got = overlaid(spark, [own], [ride])
    t0 = 15.0
    assert got == [("avg", 0.0, 500.0, "PR 9:59", [(0.0, 0.0), (500.0, 50.0)]), ("ride", 500.0, 5000.0, "PR 16:25", [(0.0, 0.0), (50.0, 30 - t0), (1950.0, 500 - t0), (4500.0, 985.0)])]


def test_overlay_keeps_both_sides_scales_and_drops_slivers(spark):
    """A curve twice as long as its stretch; a piece of 150 m goes, one whole ride stays as it is."""
    primary = [seg("p", 1000, 1500, [(0, 0), (500, 100)]), seg("q", 1650, 2000, [(0, 0), (350, 70)])]
    ride = seg("r", 0, 3000, [(0, 0), (1000, 100), (6000, 600)], "Best ride 1:00")
    got = overlaid(spark, primary, [ride, seg("w", 4000, 4500, [(0, 0), (500, 100)]), seg("in", 1100, 1400, [(0, 0), (300, 60)])])
    assert [g[:4] for g in got] == [("p", 1000.0, 1500.0, "PR 9:59"), ("q", 1650.0, 2000.0, "PR 9:59"), ("r", 0.0, 1000.0, "Best ride 3:20"), ("r", 2000.0, 3000.0, "Best ride 3:20"), ("w", 4000.0, 4500.0, "PR 9:59")]
    assert got[2][4] == [(0.0, 0.0), (1000.0, 100.0), (2000.0, 200.0)] and got[3][4] == [(0.0, 0.0), (2000.0, 200.0)]


def test_overlay_times_never_fall_and_standing_pieces_go(spark):
    ride = seg("r", 0, 1000, [(0, 0), (400, 100), (500, 90), (1000, 200)])
    still = seg("s", 0, 1000, [(0, 0), (600, 300), (1000, 300)])
    got = overlaid(spark, [seg("p", 0, 300, [(0, 0), (300, 60)])], [ride])
    assert [t for _, t in got[1][4]] == sorted(t for _, t in got[1][4])
    assert [g[0] for g in overlaid(spark, [seg("p", 0, 650, [(0, 0), (650, 60)])], [still])] == ["p"]
    assert overlaid(spark, [], [ride])[0][:3] == ("r", 0.0, 1000.0)


@pytest.fixture(scope="module")
def library(spark):
    pts = rides.points(spark, "/root/testdata/sf0.001").withColumn("file", F.col("track_id").cast("string")).cache()
    tracks = rides.tracks_of(pts)
    files = tracks.select(F.lit("live").alias("place"), F.col("track_id").cast("string").alias("track_id"), F.col("length_mm").alias("size"), F.col("started_ms").alias("mtime")).cache()

    def reader(asked, gone=()):
        def read(misses):
            asked.append(sorted((r["place"], int(r["track_id"])) for r in misses.collect()))
            got = misses.select("place", F.col("track_id").alias("file")).join(pts, "file").where(~F.col("file").isin(*gone) if gone else F.lit(True))
            return got.withColumn("started_ms", rides.started_ms("track_id")).drop("track_id").withColumnRenamed("file", "track_id")

        return read

    return files, reader


def rows_of(model):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in model.collect())


def test_an_update_folds_changed_files_only_and_equals_a_full_build(spark, library):
    files, reader = library
    asked, none = [], spark.createDataFrame([], grade_store.FOLDS)
    full = grade_store.updated(files, none, reader(asked))
    assert full.complete and (full.parsed, full.cached) == (15, 0)
    # one changed, one moved, one went, one came from a cache of other constants
    cache = full.folds.withColumn("signature", F.when(F.col("track_id") == "4", "old").otherwise(F.col("signature")))
    now = files.where("track_id <> '9'").withColumns({"mtime": F.when(F.col("track_id") == "7", F.col("mtime") + 1).otherwise(F.col("mtime")), "place": F.when(F.col("track_id") == "5", "archive").otherwise(F.col("place"))})
    update = grade_store.updated(now, cache, reader(asked))
    assert asked[-1] == [("live", 4), ("live", 7)] and (update.parsed, update.cached, update.unread) == (2, 12, 0)
    want = grade_store.model(grade_store.updated(now, none, reader(asked)).folds)
    assert rows_of(grade_store.model(update.folds)) == rows_of(want) and rows_of(want)


def test_what_cannot_be_read_is_left_out_and_asked_again(spark, library):
    files, reader = library
    asked, none = [], spark.createDataFrame([], grade_store.FOLDS)
    part = grade_store.updated(files, none, reader(asked, gone=("3", "8")))
    assert not part.complete and (part.parsed, part.unread) == (13, 2)
    again = grade_store.updated(files, part.folds, reader(asked))
    assert again.complete and asked[-1] == [("live", 3), ("live", 8)]


def test_copies_and_overlaps_count_once(spark):
    """The copy with more metres; of two rides at one time the longer; rides of no sane length stand alone; without height none."""
    b = lambda m: [(0, m / 5, float(m))]
    rows = [
        ("live", "a", 0, 100, b(500)), ("archive", "a", 0, 100, b(900)), ("live", "b", 10, 110, b(800)), ("live", "c", 60, 200, b(700)),
        ("live", "d", 90, 210, b(1)), ("live", "e", 0, 90_000_000, b(300)), ("live", "f", 0, 100, []), ("live", "g", 0, 0, b(400)),
    ]
    t = spark.createDataFrame([(p, k, 1, 1, "s", s, e, x) for p, k, s, e, x in rows], grade_store.FOLDS)
    got = grade_store.rides(t)
    assert sorted((r["place"], r["track_id"]) for r in got.collect()) == [("archive", "a"), ("live", "c"), ("live", "e"), ("live", "g")]
    assert grade_store.model(t).first()["metres"] == 900 + 700 + 300 + 400


def test_models_of_known_versions_are_served(spark):
    saved = spark.createDataFrame([(0, 1), (1, 1), (3, 1), (4, 1)], "schema_version int, bin int")
    assert sorted((r["schema_version"], r["owed"]) for r in grade_store.servable(saved).collect()) == [(1, True), (3, False)]
    assert grade.MIN_BIN_M == 400


M = 1 / 111_320.0


def lapped(spark, vertices, rows):
    segs = joins.segments(spark.createDataFrame([(1, i, y * M, x * M) for i, (x, y) in enumerate(vertices)], "route_id int, i int, lat double, lng double"))
    pts = spark.createDataFrame([(7, k, 1, y * M, x * M, float(t)) for k, (x, y, t) in enumerate(rows)], "track_id int, seq int, route_id int, lat double, lng double, time_s double")
    out: dict[int, list] = {}
    for r in laps.seed_laps(pts, segs).orderBy("lap", "k").collect():
        # the plane of M has 111,320 m a degree, the sphere 111,195
        out.setdefault(r["lap"], []).append((round(r["route_m"] * 111_320 / 111_194.93), r["elapsed_s"]))
    return list(out.values())


def test_seed_laps_of_an_out_and_back(spark):
    """The way back lies 3 m beside the way out, and runs on along the route: one lap of all of it."""
    route_ = [(0, 0), (1000, 0), (1000, 3), (0, 3)]
    out = [(x, 0, x / 5) for x in range(0, 1000, 100)]
    back = [(1000 - x, 3, 200 + x / 5) for x in range(0, 1001, 100)]
    got = lapped(spark, route_, out + back)
    assert [m for m, _ in got[0]][:10] == list(range(0, 1000, 100)) and len(got) == 1
    # ridden backward, no point gains on the last, but for the way back's own stretch
    assert all(m == sorted(m) for m in [[x for x, _ in lap] for lap in lapped(spark, route_, [(1000 - x, 0, x / 5) for x in range(0, 1001, 100)])])


def test_seed_laps_of_a_loop_ridden_twice(spark):
    """A square: the second pass closes the loop and gains no more, so the first counts only."""
    square = [(0, 0), (400, 0), (400, 400), (0, 400), (0, 0)]
    once = [(x, 0) for x in range(0, 400, 50)] + [(400, y) for y in range(0, 400, 50)] + [(400 - x, 400) for x in range(0, 400, 50)] + [(0, 400 - y) for y in range(0, 380, 50)]
    got = lapped(spark, square, [(x, y, 10 * k) for k, (x, y) in enumerate(once + once)])
    assert len(got) == 1 and got[0] == [(50 * k, 10.0 * k) for k in range(33)]


def test_seed_laps_split_at_jumps_and_drop_what_goes_back(spark):
    """700 m off the route end a lap; 300 m do not; a point with an earlier time, or off by 40 m, is passed over."""
    line = [(0, 0), (5000, 0)]
    rows = [(0, 0, 100), (100, 0, 120), (200, 0, 110), (300, 40, 130), (400, 0, 140), (700, 0, 200), (1150, 0, 300), (1710, 0, 400), (1800, 0, 420), (1790, 0, 430), (3000, 0, 500)]
    assert lapped(spark, line, rows) == [[(0, 0.0), (100, 20.0), (400, 40.0), (700, 100.0), (1150, 200.0)], [(1710, 0.0), (1800, 20.0)]]
