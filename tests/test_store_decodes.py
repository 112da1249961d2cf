"""The store's interrupted batch decodes each of its files once."""

from __future__ import annotations

from paceline.plans import scanning
from paceline.sources import fit

SF = "/root/testdata/sf0.001"


def test_files_left_behind_are_decoded_once(spark, monkeypatch):
    asked, real = spark.sparkContext.accumulator(0), fit.decoded

    def decoder(data):
        asked.add(1)
        return fit.decode(data)

    monkeypatch.setattr(fit, "decoded", lambda files: real(files, decoder))
    n = scanning.rides.points(spark, SF).where("track_id % 2 = 1").select("track_id").distinct().count()
    scanning._stored(spark, SF)
    assert n and asked.value == n
