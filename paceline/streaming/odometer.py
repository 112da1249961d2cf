"""The odometer of a live ride: distance that goes on while the recorded one is frozen.

Every tick is named first, then the name alone decides what happens:

| event | the tick says | frozen time | pending | gained |
| --- | --- | --- | --- | --- |
| READING, SETTLING | the recorded distance changed (SETTLING: while metres were pending) | 0 | dropped | 0 |
| STANDING | frozen, and the speed is below walking | - | - | - |
| LOST | frozen without any speed so far, and the last change was not forward | 0 | dropped | 0 |
| STALLED | the same after a change forward | grows | paid out | - |
| HOLD | frozen for HOLD_S at most, with a speed | grows | grows | - |
| COAST | frozen for longer, or without a speed but with one known from before | grows | paid out | grows within budgets |
| UNREADABLE | no distance or no time | - | - | - |

Distance and quality are not kept: they follow from the reading, the metres
gained and the time frozen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from enum import StrEnum

#: Metres a second below which a rider stands, and above which a speed is no rider's.
MOVING, TOP_SPEED = 0.5, 30.0
#: Seconds that a frozen odometer is coasted without a speed, and with one.
BLIND_S, LIMIT_S = 30.0, 1800.0
#: Freezes up to this long are held back, not coasted.
HOLD_S = 2.0


class Event(StrEnum):
    UNREADABLE = "UNREADABLE"
    READING = "READING"
    SETTLING = "SETTLING"
    STANDING = "STANDING"
    LOST = "LOST"
    STALLED = "STALLED"
    HOLD = "HOLD"
    COAST = "COAST"


@dataclass(frozen=True)
class Odometer:
    reading: float | None = None
    clock: float | None = None
    gained_m: float = 0.0
    pending_m: float = 0.0
    pending_s: float = 0.0
    spent_s: float = 0.0  # coasted in this freeze
    blind_s: float = 0.0  # of it without a speed
    frozen_s: float = 0.0
    cruise: float = 0.0  # speed at the last reading that had one
    forward: bool = False
    event: str = Event.UNREADABLE

    @property
    def distance(self) -> float:
        return (self.reading or 0.0) + self.gained_m

    @property
    def held(self) -> bool:
        return self.pending_s > 0 or self.event == Event.HOLD

    @property
    def quality(self) -> str:
        if self.held or self.frozen_s <= 0:
            return "LIVE"
        return "COASTING" if self.frozen_s <= BLIND_S else "LONG_LOSS"


def finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def named(o: Odometer, raw: float | None, speed: float | None, elapsed: float | None) -> Event:
    """The event of a tick after the odometer's last one."""
    if finite(raw) is None or finite(elapsed) is None:
        return Event.UNREADABLE
    if raw != o.reading:
        return Event.SETTLING if o.held else Event.READING
    if speed is None and o.cruise <= 0:
        return Event.STALLED if o.forward else Event.LOST
    if speed is not None and speed < MOVING:
        return Event.STANDING
    frozen = o.frozen_s + _since(o, elapsed)
    return Event.HOLD if speed is not None and o.spent_s == 0 and 0 < frozen <= HOLD_S else Event.COAST


def _since(o: Odometer, elapsed: float) -> float:
    return max(0.0, elapsed - o.clock) if o.clock is not None else 0.0


def _paid(o: Odometer) -> Odometer:
    return replace(o, gained_m=o.gained_m + o.pending_m, spent_s=o.spent_s + o.pending_s, pending_m=0.0, pending_s=0.0)


def _coasted(o: Odometer, speed: float | None, dt: float) -> Odometer:
    o = _paid(o)
    room = min(dt, max(0.0, LIMIT_S - o.spent_s))
    if speed is None:
        room = min(room, max(0.0, BLIND_S - o.blind_s))
        return replace(o, gained_m=o.gained_m + o.cruise * room, spent_s=o.spent_s + room, blind_s=o.blind_s + room)
    return replace(o, gained_m=o.gained_m + min(speed, TOP_SPEED) * room, spent_s=o.spent_s + room)


def advanced(o: Odometer, raw: float | None, speed: float | None, elapsed: float | None) -> Odometer:
    """The odometer after a tick."""
    speed = finite(speed)
    event = named(o, raw, speed, elapsed)
    if event == Event.UNREADABLE:
        return replace(o, event=event)
    dt = _since(o, elapsed)
    if event in (Event.READING, Event.SETTLING):
        forward = o.reading is not None and raw > o.reading
        cruise = speed if speed is not None and MOVING <= speed <= TOP_SPEED else o.cruise
        return Odometer(reading=raw, clock=elapsed, cruise=cruise, forward=forward, event=event)
    o = replace(o, clock=elapsed, event=event, frozen_s=o.frozen_s + (0.0 if event == Event.STANDING else dt))
    if event == Event.LOST:
        return replace(o, gained_m=0.0, pending_m=0.0, pending_s=0.0, frozen_s=0.0)
    if event == Event.STALLED:
        return _paid(o)
    if event == Event.HOLD:
        return replace(o, pending_m=o.pending_m + min(speed, TOP_SPEED) * dt, pending_s=o.pending_s + dt)
    return _coasted(o, speed, dt) if event == Event.COAST else o
