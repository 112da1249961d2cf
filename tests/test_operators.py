"""Operators on hand-made rides with hand-computed numbers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from paceline.functions import formats, geo
from paceline.operators import grade, joins, library, road_pace, route, samples
from paceline.sources import polyline

DEG = 1 / 111_320.0
POINTS = "track_id long, seq int, lat double, lng double, distance_m double, time_s double, ele_m double"


def east(track: int, step_s: float, n: int = 20, lat: float = 4 * DEG, step_m: float = 25.0, rise: float = 0.0):
    return [(track, k, lat, (k * step_m + 3) * DEG, k * step_m, k * step_s, 100 + k * step_m * rise) for k in range(n)]


def rides(spark, *tracks):
    return spark.createDataFrame([r for t in tracks for r in t], POINTS)


def started(spark, **at):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in at.items()], "track_id long, started_ms long")


def one(df):
    return df.first()[0]


def test_curve_lookup_clamps_and_interpolates(spark):
    curve = spark.createDataFrame([("c", 0, 0.0, 0.0), ("c", 1, 50.0, 10.0), ("c", 2, 120.0, 10.0 + 1e-9), ("c", 3, 200.0, 25.0)], "curve_id string, k int, distance_m double, time_s double")
    ask = spark.createDataFrame([("a", "c", -5.0), ("b", "c", 25.0), ("d", "c", 160.0), ("e", "c", 9999.0), ("n", "c", float("nan"))], "id string, curve_id string, distance_m double")
    got = {r["id"]: r["time_s"] for r in joins.time_at(ask, curve).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 5.0, "d": 17.5, "e": 25.0, "n": 0.0})
    back = spark.createDataFrame([("x", "c", 17.5), ("y", "c", -1.0), ("z", "c", 99.0)], "id string, curve_id string, time_s double")
    assert {r["id"]: r["distance_m"] for r in joins.distance_at(back, curve).collect()} == pytest.approx({"x": 160.0, "y": 0.0, "z": 200.0})


def test_time_in_a_stop_is_its_start(spark):
    curve = spark.createDataFrame([("c", 0, 0.0, 0.0), ("c", 1, 50.0, 10.0), ("c", 2, 120.0, 10.0), ("c", 3, 200.0, 25.0)], "curve_id string, k int, distance_m double, time_s double")
    ask = spark.createDataFrame([("a", "c", 10.0)], "id string, curve_id string, time_s double")
    assert joins.distance_at(ask, curve).first()["distance_m"] == pytest.approx(50.0)


def test_densify_and_guards(spark):
    got = samples.pace_samples(rides(spark, [(1, 0, 0.0, 0.0, 0.0, 0.0, None), (1, 1, 0.0, 50 * DEG, 50.0, 10.0, None)])).collect()
    assert len(got) == 5 and all(r["tpm"] == pytest.approx(0.2) and r["heading"] == pytest.approx(90) for r in got)
    far = [(2, 0, 0.0, 0.0, 0.0, 0.0, None), (2, 1, 0.0, 300 * DEG, 300.0, 60.0, None)]
    bent = [(3, 0, 0.0, 0.0, 0.0, 0.0, None), (3, 1, 0.0, 150 * DEG, 1500.0, 300.0, None)]
    still = [(4, 0, 0.0, 0.0, 0.0, 0.0, None), (4, 1, 0.0, 5 * DEG, 5.0, 90.0, None)]
    counts = {r["track_id"]: (r["n"], r["t"]) for r in samples.pace_samples(rides(spark, far, bent, still)).groupBy("track_id").agg(F.count("*").alias("n"), F.max("tpm").alias("t")).collect()}
    assert 2 not in counts and counts[3][0] == 1 and counts[4][1] == pytest.approx(2.0)


def test_road_pace_exact_neighbour_and_heading(spark):
    pts = rides(spark, east(1, 5.0), east(2, 5.0))
    road = road_pace.model(samples.pace_samples(pts), started(spark, t1=1, t2=2))
    ask = spark.createDataFrame([("on", 4 * DEG, 200 * DEG, 90.0), ("beside", 22 * DEG, 200 * DEG, 90.0), ("far", 900 * DEG, 200 * DEG, 90.0), ("back", 4 * DEG, 200 * DEG, 270.0)], "id string, lat double, lng double, heading double")
    got = {r["id"]: r["hist"] for r in road_pace.lookup(ask, road).collect()}
    assert got["on"] == pytest.approx(0.2) and got["beside"] == pytest.approx(0.2) and got["far"] is None and got["back"] is None


def test_own_road_beats_richer_neighbour(spark):
    pts = rides(spark, east(1, 5.0), *[east(k, 2.0, lat=22 * DEG) for k in (2, 3, 4)])
    road = road_pace.model(samples.pace_samples(pts), started(spark, t1=1, t2=2, t3=3, t4=4))
    ask = spark.createDataFrame([("on", 4 * DEG, 200 * DEG, 89.9)], "id string, lat double, lng double, heading double")
    assert road_pace.lookup(ask, road).first()["hist"] == pytest.approx(0.2)


def straight(spark, metres: float):
    return joins.segments(spark.createDataFrame([("r", 0, 4 * DEG, 0.0), ("r", 1, 4 * DEG, metres * DEG)], "route_id string, i int, lat double, lng double"))


def test_node_grid_orders_rides(spark):
    pts = rides(spark, east(1, 5.0), east(2, 10.0), east(3, 15.0))
    nodes = route.node_paces(route.grid(straight(spark, 450)), samples.pace_samples(pts), started(spark, t1=1, t2=2, t3=3))
    r = nodes.where("k = 8").first()
    assert (r["count"], r["dt_s"], r["min_dt_s"], r["last_dt_s"]) == pytest.approx((3, 10.0, 5.0, 15.0))


def test_segments_and_best_clamp(spark):
    rows = [("r", k, 6.0, 3, 0.1, 4.0) for k in range(1, 14)]
    nodes = spark.createDataFrame(rows, "route_id string, k int, dt_s double, count long, min_dt_s double, last_dt_s double")
    times = {how: route.segments_of_nodes(nodes, how).first()["time_s"] for how in ("AVERAGE", "LAST", "BEST")}
    assert times == pytest.approx({"AVERAGE": 78.0, "LAST": 52.0, "BEST": 39.0})
    assert route.segments_of_nodes(nodes.where("k < 12")).count() == 0


def test_stitched_curve_fills_gaps(spark):
    segs = spark.createDataFrame([("r", 100.0, 200.0, 20.0, [(0.0, 0.0), (50.0, 10.0), (100.0, 20.0)])], "route_id string, start_m double, end_m double, time_s double, curve array<struct<d:double,t:double>>")
    total = spark.createDataFrame([("r", 300.0)], "route_id string, total_m double")
    got = {r["distance_m"]: r["time_s"] for r in route.stitched_curve(segs, total, 10.0).collect()}
    assert got == pytest.approx({0.0: 0.0, 100.0: 10.0, 150.0: 20.0, 200.0: 30.0, 300.0: 40.0})


def test_overlay_leaves_pieces(spark):
    sec = spark.createDataFrame([("r", 0.0, 1000.0)], "route_id string, start_m double, end_m double")
    pri = spark.createDataFrame([("r", 300.0, 400.0), ("r", 350.0, 500.0), ("r", 900.0, 1200.0)], "route_id string, start_m double, end_m double")
    got = sorted((r["piece_start_m"], r["piece_end_m"]) for r in route.uncovered(sec, pri).collect())
    assert got == [(0.0, 300.0), (500.0, 900.0)]


def test_gradient_model_and_trust(spark):
    flat, hill = east(1, 2.5, n=60), east(2, 25 / 3, n=60, lat=0.0, rise=0.06)
    pts = rides(spark, flat, hill)
    model = grade.model(grade.folds(pts), started(spark, t1=1, t2=2))
    ask = spark.createDataFrame([("a", 0.0), ("b", 6.0), ("c", -12.0)], "id string, grade_pct double")
    got = {r["id"]: r["grade_tpm"] for r in grade.lookup(ask, model).collect()}
    assert got["a"] == pytest.approx(0.1) and got["b"] == pytest.approx(1 / 3) and got["c"] is None
    short = grade.model(grade.folds(rides(spark, east(3, 5.0, n=16, step_m=20.0, rise=0.04))), started(spark, t3=1))
    assert short.count() == 1 and grade.lookup(spark.createDataFrame([(4.0,)], "grade_pct double"), short).first()["grade_tpm"] is None


def test_gradient_window_restarts_after_a_dropout(spark):
    a = east(1, 5.0, n=10, rise=0.02)
    b = [(1, r[1] + 10, r[2], r[3] + 900 * DEG, r[4] + 900, r[5] + 300, r[6]) for r in east(1, 5.0, n=10, rise=0.02)]
    steps = [r["seq"] for r in grade.graded_steps(grade.windowed(rides(spark, a, b))).orderBy("seq").collect()]
    assert steps == [4, 5, 6, 7, 8, 9, 14, 15, 16, 17, 18, 19]


def test_motor_gate(spark):
    car = east(1, 1.25, n=120, rise=0.03)  # 20 m/s uphill
    bike = east(2, 5.0, n=120, rise=0.03)
    got = {r["track_id"]: r["motorised"] for r in grade.motor_gate(grade.windowed(rides(spark, car, bike))).collect()}
    assert got == {1: True, 2: False}


def test_coverage_counts_the_last_step(spark):
    total = spark.createDataFrame([("r", 1010.0)], "route_id string, total_m double")
    nodes = spark.createDataFrame([("r", k * 25.0, k == 40) for k in range(41)], "route_id string, distance_m double, hit boolean")
    assert route.coverage(nodes, total).first()["coverage"] == pytest.approx(10 / 1010)


@pytest.mark.parametrize(("share", "usable", "want"), [(0.05, False, "TARGET"), (0.05, True, "HISTORY"), (0.1, False, "HISTORY"), (float("nan"), False, "TARGET"), (None, False, "TARGET")])
def test_comparator(spark, share, usable, want):
    df = spark.createDataFrame([(share, usable)], "s double, u boolean")
    assert one(df.select(route.comparator(F.col("s"), F.col("u")))) == want


def test_decimator(spark):
    pts = rides(spark, [(1, k, 0.0, 0.0, d, float(k), None) for k, d in enumerate((0.0, 5.0, 19.0, 25.0, 30.0))])
    assert [r["distance_m"] for r in samples.decimated(pts).orderBy("seq").collect()] == [0.0, 25.0]


def test_projection_by_heading(spark):
    segs = joins.segments(spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 0.0, 0.01), ("r", 2, 0.0, 0.0)], "route_id string, i int, lat double, lng double"))
    ask = spark.createDataFrame([("out", "r", 0.0, 0.004, 600.0, 90.0), ("back", "r", 0.0, 0.004, 1500.0, 270.0)], "id string, route_id string, lat double, lng double, around_m double, heading double")
    got = {r["id"]: r["i"] for r in joins.project_window(ask, segs, 2000, 2000, 40, 45).collect()}
    assert got == {"out": 0, "back": 1}


def test_cells_find_what_a_full_scan_finds(spark):
    import random

    r = random.Random(42)
    v = [("r", i, r.uniform(0, 0.02), r.uniform(0, 0.02)) for i in range(40)]
    segs = joins.segments(spark.createDataFrame(v, "route_id string, i int, lat double, lng double"))
    pts = spark.createDataFrame([(k, "r", r.uniform(0, 0.02), r.uniform(0, 0.02)) for k in range(300)], "id int, route_id string, lat double, lng double")
    full = {x["id"]: (x["i"], round(x["perp_m"], 6)) for x in joins.project_nearest(pts, segs).where("perp_m < 35").collect()}
    near = {x["id"]: (x["i"], round(x["perp_m"], 6)) for x in joins.project_near_cells(pts, segs, 35.0).collect()}
    assert near == full and full


def test_haversine_and_geohash(spark):
    df = spark.range(1)
    assert one(df.select(geo.haversine_m(*[F.lit(x) for x in (0.0, 0.0, 1.0, 0.0)]))) == pytest.approx(111_195, abs=200)
    assert one(df.select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 8))) == "u4pruydq"
    assert one(df.select(geo.bearing_diff_deg(F.lit(350.0), F.lit(10.0)))) == pytest.approx(20)


def test_polyline_is_truncation_tolerant():
    text = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    want = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    flat = lambda pts: [x for p in pts for x in p]
    assert flat(polyline.decode(text)) == pytest.approx(flat(want))
    assert flat(polyline.decode(text[:-2])) == pytest.approx(flat(want[:2]))
    assert polyline.decode("") == []


def test_polyline_rows(spark):
    got = polyline.vertices(spark.createDataFrame([("a", "_p~iF~ps|U"), ("b", None)], "route_id string, encoded string")).collect()
    assert [(r["route_id"], r["i"]) for r in got] == [("a", 0)]


@pytest.mark.parametrize(("name", "metres", "want"), [("Café Ride!!", 1000.0, "caf-ride_1000"), ("", 5000.0, "route_5000"), ("r", 12345.0, "r_12300"), ("r", 12360.0, "r_12400"), ("日本", 100.0, "route-" + format((26085 * 31 + 26412) & 0xFFFFFFFF, "x") + "_100")])
def test_route_key(spark, name, metres, want):
    df = spark.createDataFrame([(name, metres)], "n string, m double")
    got = one(df.select(formats.route_key(F.col("n"), F.col("m"))))
    if name == "日本":
        assert got.startswith("route-") and got.endswith("_100")
    else:
        assert got == want


@pytest.mark.parametrize(("gap", "want"), [(-90.0, "+1:30"), (5400.0, "-1:30:00"), (0.0, "0:00"), (float("nan"), "---"), (None, "---")])
def test_gap_time(spark, gap, want):
    assert one(spark.createDataFrame([(gap,)], "g double").select(formats.gap_time(F.col("g")))) == want


def test_source_keys(spark):
    rows = [(1, 1_700_000_000_000, 5003.0), (2, 1_700_000_019_000, 5008.0), (3, 1_700_000_120_000, 5003.0), (4, 1_700_000_000_000, 5503.0)]
    got = library.first_by_source_key(spark.createDataFrame(rows, "track_id long, started_ms long, length_m double"))
    assert sorted(r["track_id"] for r in got.collect()) == [1, 3, 4]


def test_reseed_rule(spark):
    def due(a, b):
        return one(spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(library.should_reseed(F.col("a"), F.col("b"))))

    assert due(None, [1]) and due([1, 2], [1, 2, 3]) and not due([1, 2], [2, 1])
    assert not due(list(range(30)), list(range(34))) and due(list(range(30)), list(range(36)))


def test_twins_and_tidy(spark):
    pts = rides(spark, *[east(k, 5.0 + k, n=41, step_m=125.0) for k in range(1, 6)], east(9, 5.0, n=41, step_m=125.0, lat=0.5))
    pairs = library.twins(pts)
    assert pairs.count() == 10
    group = library.groups(pairs)
    assert {r["group"] for r in group.collect()} == {1} and group.count() == 5
    facts = spark.createDataFrame([(k, "GPX_IMPORT", k * 1000, 5000.0, 1000.0 + k) for k in range(1, 6)], "track_id long, source string, started_ms long, length_m double, time_s double")
    kept = {r["track_id"] for r in library.kept_of_groups(pts, facts, pairs).where("keep").collect()}
    assert kept == {1, 4, 5}


def test_a_ride_that_leaves_the_ground_of_those_kept_stays(spark):
    """The slow ride 2 has a short detour off the road, so it has a cell that no survivor has."""
    detour = [(t, s, lat + (0.0006 if s == 20 else 0.0), *rest) for t, s, lat, *rest in east(2, 7.0, n=161, step_m=125.0)]
    pts = rides(spark, *[east(k, 5.0 + k, n=161, step_m=125.0) for k in (1, 3, 4, 5)], detour)
    facts = spark.createDataFrame([(k, "GPX_IMPORT", k * 1000, 20000.0, 1000.0 + k) for k in range(1, 6)], "track_id long, source string, started_ms long, length_m double, time_s double")
    pairs = library.twins(pts)
    assert {2} <= {r["a"] for r in pairs.collect()} | {r["b"] for r in pairs.collect()}
    kept = {r["track_id"] for r in library.kept_of_groups(pts, facts, pairs).where("keep").collect()}
    assert kept == {1, 2, 4, 5}


def test_rides_without_a_key_are_all_new(spark):
    rows = [(1, None, 1000.0), (2, None, 1000.0), (3, 60_000, None), (4, 60_000, 1000.0), (5, 60_001, 1001.0)]
    got = library.first_by_source_key(spark.createDataFrame(rows, "track_id long, started_ms long, length_m double"))
    assert sorted(r["track_id"] for r in got.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("lat", [0.0, 41.0, -60.0, 69.0])
def test_cells_find_what_a_full_scan_finds(spark, lat):
    """A slanted ride beside a route, 17 m off, at every latitude."""
    scale = math.cos(math.radians(lat)) * 111_320.0
    place = lambda m, off: (lat + (0.5 * m + off) / 111_320.0, 7.0 + m / scale)
    route_rows = [(1, i, *place(200.0 * i, 0.0)) for i in range(6)]
    segs = joins.segments(spark.createDataFrame(route_rows, "route_id long, i int, lat double, lng double"))
    off = 17.0 * math.hypot(1.0, 0.5)
    ride = [(4, k, *place(20.0 * k, off), 22.36 * k, 5.0 * k, None) for k in range(50)]
    pts = spark.createDataFrame(ride, "track_id long, seq int, lat double, lng double, distance_m double, time_s double, ele_m double")
    samples_ = samples.pace_samples(pts)
    tracks = spark.createDataFrame([(4, 1)], "track_id long, started_ms long")
    nodes = route.grid(segs)
    got = {r["k"] for r in route.node_paces(nodes, samples_, tracks).collect()}
    s, want = samples_.collect(), set()
    for n in nodes.where("k > 0").collect():
        for x in s:
            dy, dx = (n["lat"] - x["lat"]) * 111_195.0, (n["lng"] - x["lng"]) * 111_195.0 * math.cos(math.radians(lat))
            if math.hypot(dx, dy) <= 18.0:
                want.add(n["k"])
    assert want and abs(len(got ^ want)) <= 1
    road = road_pace.model(samples_, tracks)
    moved = pts.select(F.col("seq").alias("id"), (F.col("lat") + 15.0 / 111_320.0).alias("lat"), "lng").withColumn("heading", F.lit(math.degrees(math.atan2(1.0, 0.5))))
    found = road_pace.lookup(moved, road)
    assert found.where("hist IS NULL").count() <= 1
    near = joins.project_near_cells(pts.select(F.col("seq").alias("id"), F.lit(1).cast("bigint").alias("route_id"), "lat", "lng"), segs, 35.0)
    assert near.count() == 50 and near.agg(F.max(F.abs(F.col("perp_m") - 17.0))).first()[0] < 0.5


def test_recording_replaces_its_device_scan(spark):
    pts = rides(spark, *[east(k, 5.0, n=41, step_m=125.0) for k in (1, 2, 11, 12, 13)])
    facts = spark.createDataFrame(
        [(1, "RECORDED", 0, 5000.0), (2, "RECORDED", 90_000, 5000.0), (11, "FITFILES_SCAN", 20_000, 5004.0), (12, "FITFILES_SCAN", 30_000, 5004.0), (13, "FITFILES_SCAN", 900_000, 5000.0)],
        "track_id long, source string, started_ms long, length_m double",
    )
    got = library.same_ride_losers(pts, facts, library.twins(pts))
    assert sorted(r["track_id"] for r in got.collect()) == [11, 12]


def test_no_pair_of_all_points_is_planned(spark):
    pts = rides(spark, east(1, 5.0), east(2, 6.0))
    plans = [
        route.node_paces(route.grid(straight(spark, 450)), samples.pace_samples(pts), started(spark, t1=1, t2=2)),
        library.twins(pts),
    ]
    for df in plans:
        assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
