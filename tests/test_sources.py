"""File sources on files made here."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from paceline.sources import files, fit, gpx
from paceline.sources.ride_store import RideStore
from paceline.streaming import importing

HEAD = '<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'
TAIL = "</trkseg></trk></gpx>"


def point(lat, lon, time=None, ele=None):
    return f'<trkpt lat="{lat}" lon="{lon}">' + (f"<ele>{ele}</ele>" if ele is not None else "") + (f"<time>{time}</time>" if time else "") + "</trkpt>"


def test_gpx(spark, tmp_path):
    t = "2023-11-14T22:13:{:02d}Z"
    good = HEAD + point(41.387, 2.170, t.format(20), 12.5) + point(41.388, 2.170, t.format(40)) + point(41.389, 2.171, "2023-11-14T22:14:00Z") + TAIL
    (tmp_path / "good.gpx").write_text(good)
    (tmp_path / "no_time.gpx").write_text(HEAD + point(1, 2) + point(1, 3) + TAIL)
    (tmp_path / "single.gpx").write_text(HEAD + point(1, 2, t.format(1)) + TAIL)
    (tmp_path / "entity.gpx").write_text(good.replace("<gpx", '<!DOCTYPE gpx [<!ENTITY x "y">]><gpx', 1))
    (tmp_path / "broken.gpx").write_text(HEAD + "<trkpt")
    every = gpx.read(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rsplit("/")[-1] for r in every if r["outcome"] == "failed") == ["broken.gpx", "entity.gpx", "no_time.gpx", "single.gpx"]
    rows = sorted((r for r in every if r["outcome"] == "decoded"), key=lambda r: r["seq"])
    assert [r["time_s"] for r in rows] == [0, 20, 40] and {r["started_ms"] for r in rows} == {1_700_000_000_000}
    assert [r["ele_m"] for r in rows] == [12.5, None, None]
    assert rows[0]["distance_m"] == 0 and rows[1]["distance_m"] == pytest.approx(111.2, abs=0.5) and rows[2]["distance_m"] > rows[1]["distance_m"]
    assert {r["track_id"] for r in rows} == {"gpx-1700000000000"}


def fit_file(records, file_type=4, sport=2) -> bytes:
    return fit.encode([(at + fit.EPOCH, *rest) for at, *rest in records], file_type, sport)


def test_fit_decoder():
    at = 1_700_000_000 - fit.EPOCH
    outcome, pts = fit.decode(fit_file([(at, 41.0, 2.0, 5.0, 100.0), (at + 10, 41.001, 2.0, 4.0, None), (at + 15, None, None, 9.0, 1.0), (at + 20, 41.002, 2.0, 230.0, 103.0)]))
    assert outcome == "decoded" and len(pts) == 3
    assert [p[4] for p in pts] == pytest.approx([0.0, 0.0, 225.0]) and [p[5] for p in pts] == [0, 10, 20]
    assert pts[0][0] == 1_700_000_000_000 and pts[0][6] == pytest.approx(100.0) and pts[1][6] is None
    assert pts[1][2] == pytest.approx(41.001, abs=1e-6)


def test_fit_outcomes():
    at = 1_000_000_000
    two = [(at, 41.0, 2.0, 0.0, None), (at + 10, 41.001, 2.0, None, None)]
    assert fit.decode(fit_file(two))[1][1][4] == pytest.approx(111.2, abs=0.5)
    assert fit.decode(fit_file(two[:1]))[0] == "invalid"
    assert fit.decode(fit_file(two, sport=1))[0] == "invalid" and fit.decode(fit_file(two, file_type=6))[0] == "invalid"
    broken = bytearray(fit_file(two))
    broken[30] ^= 1
    assert fit.decode(bytes(broken))[0] == "failed" and fit.decode(b"short")[0] == "failed"


def test_fit_scan(spark, tmp_path):
    at = 1_000_000_000
    (tmp_path / "a.fit").write_bytes(fit_file([(at, 41.0, 2.0, 0.0, None), (at + 10, 41.001, 2.0, 120.0, None)]))
    (tmp_path / "b.fit").write_bytes(b"nothing")
    rows = fit.read(spark, str(tmp_path)).collect()
    assert sorted(r["outcome"] for r in rows) == ["decoded", "decoded", "failed"]


def test_files_not_changed_since_are_not_read(spark, tmp_path):
    """The time filter is part of the scan, and a listing reads no content."""
    for k, name in enumerate(("old.fit", "new.FIT")):
        (tmp_path / name).write_bytes(fit_file([(1_000_000_000, 41.0, 2.0, 0.0, None), (1_000_000_010, 41.001, 2.0, 120.0, None)]))
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "x.gpx").write_text("no")
    got = fit.read(spark, str(tmp_path), since_ms=1_000_500)
    assert {r["path"].rsplit("/")[-1] for r in got.collect()} == {"new.FIT"}
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(modificationTime), GreaterThan(modificationTime" in plan or "modificationTime#" in plan.split("PushedFilters")[0] and "PushedFilters: []" not in plan
    found = files.listed(spark, [(str(tmp_path), "*.[fF][iI][tT]", "FITFILES_SCAN"), (str(tmp_path), "*.gpx", "GPX_IMPORT")])
    assert sorted((r["path"].rsplit("/")[-1], r["mtime"] if "fit" in r["path"].lower() else 0, r["source"]) for r in found.collect()) == [("new.FIT", 1_001_000, "FITFILES_SCAN"), ("old.fit", 1_000_000, "FITFILES_SCAN"), ("x.gpx", 0, "GPX_IMPORT")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<" in plan and "content:binary" not in plan
    assert {r["source"]: r["files"] for r in files.counted(found).collect()} == {"FITFILES_SCAN": 2, "GPX_IMPORT": 1}


def _ride(at, n, step=10.0, ele=100.0):
    return fit_file([(at + 2 * k, 41.0 + k * step / 111_195, 2.0, step * k, ele) for k in range(n)])


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.fit").write_bytes(_ride(1_000_000_000 + 10_000 * k, 30))
    (folder / "copy.fit").write_bytes((folder / "1.fit").read_bytes())
    (folder / "run.fit").write_bytes(fit_file([(1_000_000_000, 41.0, 2.0, 0.0, None)] * 3, sport=1))
    (folder / "broken.fit").write_bytes(b"nothing")
    (folder / "note.txt").write_text("no ride")
    t = "2023-11-14T22:{:02d}:00Z"
    (folder / "a.gpx").write_text(HEAD + "".join(point(41 + k / 1000, 2.0, t.format(10 + k)) for k in range(5)) + TAIL)
    return folder


def _rides(store):
    return sorted((r["track_id"], r["n"]) for r in store.points().groupBy("track_id").agg(F.count("*").alias("n")).collect())


def _run(spark, inbox, store, log, files_a_batch=3):
    importing.import_stream(importing.arriving(spark, str(inbox), files_a_batch), store, str(log)).awaitTermination()


def test_a_batch_killed_between_two_writes_leaves_no_double_ride(spark, inbox, tmp_path, monkeypatch):
    want = RideStore(spark, str(tmp_path / "want"))
    _run(spark, inbox, want, tmp_path / "want-log")
    rides = _rides(want)
    assert len(rides) == 5 and {n for k, n in rides if k.startswith("fit")} == {15}
    assert {r["path"].rsplit("/")[-1]: r["outcome"] for r in want.outcomes().collect()} == {"0.fit": "imported", "2.fit": "imported", "3.fit": "imported", "a.gpx": "imported", "run.fit": "invalid", "broken.fit": "failed", "note.txt": "failed"} | {
        r["path"].rsplit("/")[-1]: r["outcome"] for r in want.outcomes().where("path LIKE '%1.fit' OR path LIKE '%copy.fit'").collect()
    }
    assert sorted(r["outcome"] for r in want.outcomes().where("path LIKE '%1.fit' OR path LIKE '%copy.fit'").collect()) == ["duplicate", "imported"]
    for stop in ("points", "ledger", "commits"):
        store, plain = RideStore(spark, str(tmp_path / stop)), RideStore.write
        tries = []

        def write(self, batch, kind, rows, stop=stop, plain=plain, tries=tries):
            if kind == stop and batch == 1 and not tries:
                tries.append(batch)
                raise OSError("the disk is full")
            plain(self, batch, kind, rows)

        monkeypatch.setattr(RideStore, "write", write)
        with pytest.raises(Exception, match="disk is full"):
            _run(spark, inbox, store, tmp_path / f"{stop}-log")
        assert {r["batch"] for r in store.commits().collect()} == {0} and len(_rides(store)) <= 3
        _run(spark, inbox, store, tmp_path / f"{stop}-log")
        monkeypatch.setattr(RideStore, "write", plain)
        assert _rides(store) == rides and store.last_scan_ms() == want.last_scan_ms()


def test_a_second_import_adds_nothing_and_a_scan_fills_in_heights(spark, inbox, tmp_path):
    store = RideStore(spark, str(tmp_path / "store"))
    # a live recording of the ride in 2.fit, without heights
    own = spark.createDataFrame([("live", "RECORDED", "x", 0, k, 41.0 + k * 20 / 111_195, 2.0, 20.0 * k, 4.0 * k, None) for k in range(15)], "track_id string, source string, source_key string, started_ms long, seq int, lat double, lng double, distance_m double, time_s double, ele_m double")
    start = (1_000_020_000 + fit.EPOCH) * 1000
    own = own.withColumn("source_key", F.lit(f"{start // 60_000}:28")).withColumn("started_ms", F.lit(start))
    store.write(0, "rides", own.select("track_id", "source", "source_key", "started_ms").distinct())
    store.write(0, "points", own)
    store.commit(0, 0)
    files_ = spark.read.format("binaryFile").load(str(inbox))
    importing.import_batch(store, 1, files_)
    first = _rides(store)
    assert ("live", 15) in first and len(first) == 5
    assert {r["path"].rsplit("/")[-1] for r in store.outcomes().where("enriched").collect()} == {"2.fit"}
    assert store.points().where("track_id = 'live' AND ele_m IS NULL AND seq > 0").count() == 0
    importing.import_batch(store, 2, files_)
    assert _rides(store) == first and {r["path"].rsplit("/")[-1] for r in store.outcomes().where("batch = 2").collect()} == {"broken.fit", "note.txt"}


def test_decoders_can_be_given(spark):
    mine = lambda data: ("decoded", [(0, k, 1.0, 2.0, 30.0 * k, float(k), None) for k in range(len(data))])
    rows = spark.createDataFrame([("a.own", bytearray(b"xyz")), ("b.fit", bytearray(b"xyz"))], "path string, content binary")
    got = importing.decoded(rows, {".own": lambda f: fit.decoded(f, mine)}).collect()
    assert sorted((r["path"], r["outcome"], r["seq"]) for r in got if r["seq"] is not None) == [("a.own", "decoded", k) for k in range(3)]
    assert [r["outcome"] for r in got if r["path"] == "b.fit"] == ["failed"]
