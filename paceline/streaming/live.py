"""Live signals as rules over a stream: latest together, absences, repeats, losses.

Each has the meaning of a function over stored rows (``operators.signals``,
``streaming.alerts``), and keeps a few values of state.
"""

from __future__ import annotations

from paceline.operators.signals import GRACE_MS, HEARTBEAT_MS
from paceline.streaming.alerts import ALERT_S
from paceline.streaming.ordered import Rule

#: A number that has been extrapolated for so long is blanked.
GIVE_UP_MS = 180_000


class Latest(Rule):
    """The latest value of each name at every change, once all have one.

    drop_first: without the first that a key gives, which may replay what is stale.
    """

    rows = "at bigint, seq bigint, name string, value double"

    def __init__(self, signals: list[str], drop_first: bool = False):
        self.signals, self.drop_first = signals, drop_first
        values = ", ".join(f"{n} double" for n in signals)
        self.state, self.out = f"{values}, given boolean", f"at bigint, seq bigint, {values}"

    def first(self) -> tuple:
        return (*[None] * len(self.signals), not self.drop_first)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        at, seq, name, value = row
        if name not in self.signals:
            return state, []
        # a null value is no news: the last one stands
        values = [value if n == name and value is not None else v for n, v in zip(self.signals, state, strict=False)]
        if any(v is None for v in values):
            return (*values, state[-1]), []
        return (*values, True), [(at, seq, *values)] if state[-1] else []


class Absence(Rule):
    """``gone`` once something has been away for a grace, and ``back`` when it returns after that.

    With 4 s the teardown of a route, with 180 s the blanking of a number.
    """

    rows = "at bigint, seq bigint, present boolean"
    state = "present boolean, since bigint, gone boolean"
    out = "at bigint, kind string"

    def __init__(self, grace_ms: int = GRACE_MS):
        self.grace_ms = grace_ms

    def first(self) -> tuple:
        return None, None, False

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        at, _, here = row
        present, since, gone = state
        if here:
            return (True, None, False), [(at, "back")] if gone else []
        return (False, at, False) if present is not False else state, []

    def deadline(self, state: tuple) -> int | None:
        _, since, gone = state
        return None if since is None or gone else since + self.grace_ms

    def due(self, state: tuple, upto: int) -> tuple[tuple, list[tuple]]:
        at = self.deadline(state)
        return (state, []) if at is None or at > upto else ((*state[:2], True), [(at, "gone")])


class Repeats(Rule):
    """Each value, and again every ``every_ms`` until the next; the same value anew is not given out.

    changed_only: a value equal to the one shown is passed over, and does not put off a repeat.
    """

    rows = "at bigint, seq bigint, value double"
    state = "at bigint, seq bigint, value double, n int"
    out = "at bigint, seq bigint, value double, repeat int"
    strict = 1

    def __init__(self, every_ms: int = HEARTBEAT_MS, changed_only: bool = False):
        self.every_ms, self.changed_only = every_ms, changed_only

    def first(self) -> tuple:
        return None, None, None, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        at, seq, value = row
        if self.changed_only and state[0] is not None and value == state[2]:
            return state, []
        return (at, seq, value, 0), [(at, seq, value, 0)]

    def deadline(self, state: tuple) -> int | None:
        return None if state[0] is None else state[0] + (state[3] + 1) * self.every_ms

    def due(self, state: tuple, upto: int) -> tuple[tuple, list[tuple]]:
        at, seq, value, n = state
        if at is None or upto < at:
            return state, []
        last = max(n, (upto - at) // self.every_ms)
        return (at, seq, value, last), [(at + k * self.every_ms, seq, value, k) for k in range(n + 1, last + 1)]


class Losses(Rule):
    """Alerts of lost positions, as ``alerts.position_alerts`` gives them, tick by tick."""

    rows = "at bigint, seq bigint, now_s double, last_fix_s double, paused boolean"
    state = "anchor_s double, paused boolean, out boolean"
    out = "seq bigint, age_s double"

    def __init__(self, alert_s: float = ALERT_S):
        self.alert_s = alert_s

    def first(self) -> tuple:
        return None, False, False

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        anchor, rested, out = state
        _, seq, now, fix, paused = row
        if anchor is None or rested and not paused:
            anchor = now
        if paused or fix is None:
            return (anchor, bool(paused), out), []
        age = now - max(anchor, fix)
        late = age >= self.alert_s
        given = [(seq, age)] if late and not out else []
        return (anchor, False, late or out and now - fix >= self.alert_s / 2), given
