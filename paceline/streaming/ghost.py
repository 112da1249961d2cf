"""The ghost of a live ride: by how much the past self is behind, in seconds and metres.

The lead is a running sum: a stretch with a pace earns what the past self needed
for it less what the rider took; one without earns nothing.  Where the ghost is
follows from when it passed the places ridden, a path of places CRUMB_M apart,
looked up by the time.  Of the path, what lies KEEP_M behind the ghost goes, so
the state is bounded by the lead.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

CRUMB_M = 20.0
KEEP_M = 2000.0


@dataclass
class Ghost:
    lead_s: float = 0.0  # above 0: the rider is ahead
    lead_m: float = 0.0
    matched_m: float = 0.0
    filled_m: float = 0.0
    at: float | None = None
    clock: float = 0.0
    path: list[list[float]] = field(default_factory=list)  # [metres, seconds when the ghost passed], both rising


def followed(g: Ghost, distance: float, elapsed: float, pace: float | None) -> Ghost:
    """The ghost after the rider came to a distance; without a pace the gap stays."""
    if g.at is None:  # a first tick, or one after a resumption: the lead stands as it is
        g.at, g.clock, g.path = distance, elapsed, [[distance, elapsed + g.lead_s]]
    step, took = distance - g.at, elapsed - g.clock
    if step > 0:
        g.lead_s += (max(0.0, took) if pace is None else pace * step) - took
        g.filled_m += step if pace is None else 0.0
        g.matched_m += 0.0 if pace is None else step
        if distance - g.path[-1][0] >= CRUMB_M:
            g.path.append([distance, elapsed + g.lead_s])
    else:
        g.lead_s -= took
        if step < 0:
            g.path = g.path[: bisect_left(g.path, [distance, float("inf")])] or [[distance, elapsed]]
    g.at, g.clock = distance, elapsed
    place = _place(g)
    g.lead_m = distance - place
    old = bisect_left(g.path, place - KEEP_M, key=lambda c: c[0]) - 1
    if old > KEEP_M / CRUMB_M:
        del g.path[:old]
    return g


def _place(g: Ghost) -> float:
    """Where the ghost is now, on the ridden path; the rider's place when that is behind."""
    path = [*g.path[-1:], [g.at, g.clock + g.lead_s]] if g.clock > g.path[-1][1] else g.path
    k = bisect_left(path, g.clock, key=lambda c: c[1])
    if k == 0:
        return path[0][0]
    if k == len(path):
        return g.at
    (d0, t0), (d1, t1) = path[k - 1], path[k]
    return d0 + (min(1.0, (g.clock - t0) / (t1 - t0)) if t1 > t0 else 0.0) * (d1 - d0)


def resumed(g: Ghost, lead_s: float) -> Ghost:
    """The next tick starts anew with this lead."""
    g.lead_s, g.at, g.path = lead_s, None, []
    return g


def rebased(g: Ghost, distance: float, elapsed: float) -> Ghost:
    """Leave out an interval that was not raced: the lead stays, the path moves along."""
    if g.at is None:
        return g
    g.path = [[d + distance - g.at, t + elapsed - g.clock] for d, t in g.path]
    g.at, g.clock = distance, elapsed
    return g
