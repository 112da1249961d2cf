"""Queries leave out no row of their input."""

from __future__ import annotations

from paceline.operators import samples
from paceline.plans import catalogue, routes
from paceline.sources import rides

SF = "/root/testdata/sf0.001"


def test_every_step_is_projected(spark):
    steps = samples.deltas(rides.points(spark, SF)).selectExpr("concat_ws(':', track_id, seq) AS id")
    want = sorted(r["id"] for r in steps.collect())
    assert sorted(r["id"] for r in catalogue.QUERIES["project_nearest"](spark, SF).select("id").collect()) == want


def test_every_interval_is_grouped(spark):
    n = rides.tracks_of(rides.points(spark, SF)).count()
    assert catalogue.QUERIES["overlap_groups"](spark, SF).selectExpr("sum(n) AS n").first()["n"] == n


def test_overlay_halves_hold_all_rides_and_meet(spark):
    spans = routes._spans(spark, SF)
    primary = spans.where(routes._PRIMARY.format(div="div"))
    rest = spans.where(f"NOT ({routes._PRIMARY.format(div='div')})")
    assert primary.count() + rest.count() == spans.count()
    assert primary.join(rest.select("route_id"), "route_id", "left_semi").count() > 0
    assert catalogue.QUERIES["overlay_pieces"](spark, SF).count() > 0


def test_runs_hold_every_node(spark):
    nodes = catalogue.QUERIES["route_nodes"](spark, SF)
    runs = catalogue.QUERIES["route_segments"](spark, SF)
    left_out = nodes.where("k % 61 = 40").join(runs, "route_id").where("k * 25 > start_m AND k * 25 <= end_m")
    assert left_out.count() > 0
