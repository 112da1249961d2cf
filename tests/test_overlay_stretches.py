"""Overlays against every pair of intervals, without joining every pair."""

from __future__ import annotations

from paceline.operators import route

SEG = "route_id long, start_m double, end_m double"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlays_meet_merged_primaries_by_stretch(spark):
    pri = [(k % 3, float(k * 7919 % 40_000), float(k * 7919 % 40_000 + 50 + k * 31 % 90)) for k in range(250)] + [(0, 9_000.0, 21_000.0), (0, 9_000.0, 9_500.0)]
    sec = [(k % 4, float(k * 104_729 % 39_000), float(k * 104_729 % 39_000 + 300 + k * 577 % 12_000)) for k in range(80)]
    got = route.uncovered(spark.createDataFrame(sec, SEG), spark.createDataFrame(pri, SEG))
    assert "LeftOuter" not in _plan(got)  # a join by route alone
    want = []
    for r, a, z in sec:
        hits = sorted((p, q) for o, p, q in pri if o == r and q > a and p < z)
        at = a
        for p, q in hits:
            want.append((r, a, z, at, min(p, z)))
            at = max(at, q)
        want.append((r, a, z, at, z))
    want = sorted(w for w in want if w[4] - w[3] >= 200)
    assert len(want) > 50
    assert sorted(tuple(r) for r in got.collect()) == want
