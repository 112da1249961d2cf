"""Streams of a key in the order of event time: rules that wait for the watermark.

Rows of a key may arrive in any order and from several sources.  They wait in
list state until the watermark has passed them, when no earlier one can come,
and then go through a rule in order of time and ``seq``.  A rule may also want
to be woken at a time of its own (a grace that ends, a repeat that is due); that
is an event-time timer, and between rows it fires in its place.  So the result
is that of the stored rows, however they arrive; rows later than the watermark's
delay are dropped by Spark.

A key has one timer, for the earliest of its waiting rows, its rule's own
deadline and ``idle_ms`` after its last row, when all its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: A key without a row for so long is forgotten.
IDLE_MS = 24 * 3600 * 1000


class Rule:
    """What happens to the rows of a key, one after the other.

    ``rows``, ``state`` and ``out`` are column lists (DDL); the first two columns
    of rows are ``at bigint, seq bigint``.  A state is a tuple, and so is a row.
    """

    rows: str
    state: str
    out: str
    #: 1 if a deadline at the very time of a row no longer counts, 0 if it comes before the row.
    strict = 0

    def first(self) -> Any:
        raise NotImplementedError

    def load(self, row: tuple) -> Any:
        """A state from its columns; ``save`` turns it back."""
        return tuple(row)

    def save(self, state: Any) -> tuple:
        return state

    def step(self, state: Any, row: tuple) -> tuple[Any, list[tuple]]:
        """The state after a row and what is given out."""
        raise NotImplementedError

    def deadline(self, state: Any) -> int | None:
        """When the rule wants to be woken, without a row."""
        return None

    def due(self, state: Any, upto: int) -> tuple[Any, list[tuple]]:
        """The state after all deadlines up to a time."""
        return state, []


def names(ddl: str) -> list[str]:
    """Top-level column names of a DDL list."""
    depth, out, at = 0, [], 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[at:k].split()[0])
            at = k + 1
    return out


def run(rule: Rule, state: Any, rows: list[tuple], upto: int | None, last: int | None = None, idle_ms: int | None = None) -> tuple[Any, list[tuple]]:
    """The state after rows (in order) and all deadlines up to a time, and what was given out.

    After idle_ms without a row (``last`` is the time of the one before) the state begins anew.
    """
    out: list[tuple] = []

    def until(at: int) -> None:
        nonlocal state
        rests = idle_ms is not None and last is not None and at >= last + idle_ms
        state, some = rule.due(state, last + idle_ms if rests else at)
        out.extend(some)
        state = rule.first() if rests else state

    for row in rows:
        until(row[0] - rule.strict)
        state, some = rule.step(state, row)
        out += some
        last = row[0]
    if upto is not None:
        until(upto)
    return state, out


class Ordered(StatefulProcessor):
    """Runs a rule over each key's rows behind the watermark."""

    def __init__(self, rule: Rule, key: str, idle_ms: int = IDLE_MS):
        self.rule, self.key, self.idle_ms = rule, key, idle_ms
        self.columns, self.given = names(rule.rows), names(rule.out)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rule.rows)
        self.held = handle.getValueState("held", self.rule.state)
        self.clock = handle.getValueState("clock", "timer bigint, last bigint")

    def handleInitialState(self, key: Any, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        state = tuple(initialState[c] for c in names(self.rule.state))
        self.held.update(state)
        own = self.rule.deadline(self.rule.load(state))
        if own is not None:
            self.handle.registerTimer(own)
        self.clock.update((own, None))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(new)
        timer, last = self.clock.get() or (None, None)
        self._set(timer, min([r[0] for r in new] + ([] if timer is None else [timer])), last)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        every = sorted(self.waiting.get(), key=lambda r: r[:2])
        ready = [r for r in every if r[0] <= upto]
        rest = every[len(ready) :]
        _, last = self.clock.get()
        held = self.held.get()
        state = self.rule.first() if held is None else self.rule.load(held)
        state, out = run(self.rule, state, ready, upto, last, self.idle_ms)
        last = ready[-1][0] if ready else last
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if last is not None and upto >= last + self.idle_ms:  # nothing is left to remember but rows that wait
            self.held.clear()
            last = None
        else:
            self.held.update(self.rule.save(state))
        times = [rest[0][0]] if rest else []
        if last is not None:
            own = self.rule.deadline(state)
            times += [last + self.idle_ms] + ([] if own is None else [own])
        if times:
            self._set(None, max(min(times), upto + 1), last)
        else:
            self.clock.clear()
        for row in out:
            yield Row(**{self.key: key[0]}, **dict(zip(self.given, row, strict=True)))

    def _set(self, old: int | None, new: int, last: int | None) -> None:
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        self.clock.update((new, last))

    def close(self) -> None:
        pass


def over_stream(rows: DataFrame, rule: Rule, key: str, delay: str, initial: DataFrame | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """key and the rule's output, for a stream of rows (key, the rule's columns; ``at`` in milliseconds).

    delay: by how much rows may be late.  initial: a state a key (key and the
    rule's state columns) to begin with.
    """
    timed = rows.select(key, *names(rule.rows), F.timestamp_millis("at").alias("ts_")).withWatermark("ts_", delay)
    kind = rows.schema[key].dataType.simpleString()
    given = None if initial is None else initial.select(key, *names(rule.state)).groupBy(key)
    return timed.groupBy(key).transformWithState(Ordered(rule, key, idle_ms), f"{key} {kind}, {rule.out}", "Append", "EventTime", given)
