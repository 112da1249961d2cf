"""Twins judged in tiles: the same pairs however rides are dealt, links of the same groups, and no shuffle of pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.operators import delta, library, twins
from paceline.plans import keeping

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pts(spark):
    return keeping._twin_points(spark, SF).localCheckpoint()


def found(rows):
    return sorted(map(tuple, rows.select("a", "b").collect()))


def groups(spark, rows):
    return {r["track_id"]: r["group"] for r in library.groups(rows.localCheckpoint()).collect()}


def test_chunks_and_columns_do_not_matter(spark, pts, monkeypatch):
    want = found(library.twins(pts))
    assert len(want) > 5 and len(set(want)) == len(want) and all(a < b for a, b in want)
    monkeypatch.setattr(twins, "CHUNK", 5)
    monkeypatch.setattr(twins, "COLUMNS", 7)
    assert found(library.twins(pts)) == want


def test_links_connect_what_twins_connect(spark, pts):
    assert groups(spark, library.twin_links(pts)) == groups(spark, library.twins(pts))


def test_links_are_few_where_twins_are_many(spark):
    many = spark.range(300).select(F.col("id").alias("track_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("seq"))
    many = many.select("track_id", "seq", (F.lit(41.0) + F.col("seq") * 2e-4).alias("lat"), F.lit(0.5).alias("lng"), (F.col("seq") * 22.0).alias("distance_m"))
    assert library.twins(many).count() == 300 * 299 // 2
    assert library.twin_links(many).count() <= 2 * 300


def test_only_pairs_of_asked_rides(spark, pts):
    asked = pts.select("track_id").distinct().where("track_id % 3 = 1")
    want = [p for p in found(library.twins(pts)) if p[0] % 3 == 1 or p[1] % 3 == 1]
    assert found(library.twins(pts, asked=asked)) == want


def test_links_after_a_group_lost_its_middle(spark):
    """1 - 2 - 3 are a chain by length; without 2, 1 and 3 are no group, whatever star held them."""
    steps = {1: 100.0, 2: 108.0, 3: 117.0, 4: 100.0}
    rows = [(t, k, 41.0 + k * 1e-3, 0.5 if t < 4 else 0.9, k * m) for t, m in steps.items() for k in range(20)]
    pts = spark.createDataFrame(rows, "track_id long, seq int, lat double, lng double, distance_m double").localCheckpoint()
    before = library.twin_links(pts).localCheckpoint()
    assert groups(spark, before) == {1: 1, 2: 1, 3: 1}
    now, none = pts.where("track_id <> 2"), pts.select("track_id").limit(0)
    links = delta.links_after(before, now, library.path_cells(now), none, spark.createDataFrame([(2,)], "track_id long"))
    assert found(links) == []


def test_no_pair_is_shuffled(spark, pts):
    plan = library.twins(pts)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in top
