"""Arrivals of many rows come in several files each, and give what one file each gives."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from paceline.plans import streams
from paceline.streaming import live, replay

SF = "/root/testdata/sf0.001"


def rows_a_file(spark, folder):
    return sorted(spark.read.parquet(p).count() for p in glob.glob(f"{folder}/*.parquet"))


def test_no_file_holds_a_whole_arrival(spark):
    rows = spark.range(12_000).select((F.col("id") % 50).alias("track_id"), F.col("id").alias("at"), F.col("id").alias("seq"))
    whole = rows_a_file(spark, replay.arrived(rows, "track_id", 0, 11_999, 13_000))
    dealt = rows_a_file(spark, replay.arrived(rows, "track_id", 0, 11_999, 13_000, parts=8))
    assert sum(whole) == sum(dealt) == 12_001
    assert max(whole) > 2_000 and max(dealt) < 1_200


def test_parts_grow_with_rows():
    assert replay.parts(0) == replay.parts(1_000_000) == 1
    assert replay.parts(36_000_000) == 24


def test_several_files_at_once_give_the_same(spark, monkeypatch):
    want = sorted(map(tuple, streams._run(streams._values(spark, SF, 100_000), live.Repeats(changed_only=True)).collect()))
    monkeypatch.setattr(replay, "ROWS_A_FILE", 40)
    monkeypatch.setattr(replay, "ROWS_A_PARTITION", 100)
    assert sorted(map(tuple, streams._run(streams._values(spark, SF, 100_000), live.Repeats(changed_only=True)).collect())) == want
