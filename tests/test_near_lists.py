"""A point meets its cell's segments without grouping."""

from __future__ import annotations

from paceline.operators import joins


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_near_points_are_not_grouped(spark):
    line = [(r, i, 45.0 + i * 0.0001 * (r + 1), 7.0) for r in range(2) for i in range(40)]
    segs = joins.segments(spark.createDataFrame(line, "route_id long, i int, lat double, lng double"))
    points = spark.createDataFrame([(f"{k}", k % 2, 45.0 + k * 0.00013, 7.0 + k * 0.00002) for k in range(30)], "id string, route_id long, lat double, lng double")
    got = joins.project_near_cells(points, segs, 35.0)
    assert "Aggregate [id" not in _plan(got)  # points are neither sorted nor shuffled by their ids
    want = {}
    for r in joins.feet(points, segs).where("perp_m < 35").collect():
        best = (round(r["perp_m"], 9), r["i"], round(r["along_m"], 6))
        want[r["id"]] = min(want.get(r["id"], best), best)
    assert len(want) > 5
    assert {r["id"]: (round(r["perp_m"], 9), r["i"], round(r["along_m"], 6)) for r in got.collect()} == want
