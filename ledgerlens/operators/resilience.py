"""Failure windows, streaks and circuit breakers over logs of calls."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import ROWS_A_RANGE, range_fold

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
TRACE = "seq long, state_before string, decision string, state_after string, failures long"


def failure_rate(calls: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    """The failure rate of each service's last ``n`` calls, once there are so many, and whether it would trip."""
    last = Window.partitionBy("service").orderBy("ts", "seq").rowsBetween(1 - n, 0)
    full = F.count("*").over(last) >= n
    rate = F.when(full, F.avg(F.col("failed").cast("double")).over(last))
    return calls.withColumn("failure_rate", rate).withColumn("would_trip", F.coalesce(F.col("failure_rate") >= threshold, F.lit(False)))


def failure_streaks(calls: DataFrame) -> DataFrame:
    """Failures in a row up to each call; a success resets them."""
    ordered = Window.partitionBy("service").orderBy("ts", "seq")
    island = F.sum((~F.col("failed")).cast("int")).over(ordered)
    marked = calls.withColumn("_island", island)
    run = Window.partitionBy("service", "_island").orderBy("ts", "seq")
    return marked.withColumn("streak", F.sum(F.col("failed").cast("bigint")).over(run)).drop("_island")


def fallback(result: Column, message: str) -> Column:
    """A call's result, or the message where it has none."""
    return F.coalesce(result, F.lit(message))


@dataclass
class Breaker:
    """Consecutive failures open it; a call strictly later than the last failure and the pause is a trial."""

    threshold: int
    pause: timedelta
    state: str = CLOSED
    failures: int = 0
    last: object = None

    def call(self, ts, failed: bool) -> tuple[str, str, str, int]:
        before = self.state
        if before == OPEN and not ts > self.last + self.pause:
            return before, "REJECTED", before, self.failures
        if failed:
            self.failures, self.last = self.failures + 1, ts
            self.state = OPEN if self.failures >= self.threshold else self.state
        else:
            self.failures, self.state = 0, CLOSED
        return before, "CALLED", self.state, self.failures


@dataclass
class RateBreaker:
    """The failure rate of the last calls opens it; after a pause a few trial calls decide."""

    window: int
    threshold: float
    pause: timedelta
    trials: int
    state: str = CLOSED
    since: object = None
    recent: deque = field(default_factory=deque)

    def call(self, ts, failed: bool) -> tuple[str, str, str, int]:
        if self.state == OPEN and ts >= self.since + self.pause:
            self.state, self.recent = HALF_OPEN, deque()
        before = self.state
        if before == OPEN:
            return before, "REJECTED", before, sum(self.recent)
        self.recent.append(bool(failed))
        size = self.trials if before == HALF_OPEN else self.window
        while len(self.recent) > size:
            self.recent.popleft()
        if len(self.recent) == size:
            if sum(self.recent) / size >= self.threshold:
                self.state, self.since = OPEN, ts
            elif before == HALF_OPEN:
                self.state, self.recent = CLOSED, deque()
        return before, "CALLED", self.state, sum(self.recent)


_EPOCH = datetime(1970, 1, 1)


def _micros(moment: datetime) -> int:
    return (moment.replace(tzinfo=None) - _EPOCH) // timedelta(microseconds=1)


@dataclass(frozen=True)
class _End:
    """Where a way through a range ends. ``reopened``: trials failed since it was last opened by calls in a row; until the
    breaker has closed at least once (``settled``) that counts from what was before the range."""

    state: str
    since: int | None = None
    recent: tuple = ()
    reopened: int = 0
    settled: bool = False


class CallRange:
    """What a range of calls does to a breaker, whatever state that is in before.

    Both breakers open by a full window of calls (consecutive failures are a window of failures only) and are tried
    after a pause. So all ways through a range meet in two kinds of places: a trial that begins at some call, and a breaker
    that has just closed before some call. The ends of the ways from these places follow from the last call backwards.
    A way from outside reaches one of them within a window or a pause, and only so much of the range is kept.
    """

    def __init__(self, breaker: Breaker | RateBreaker, ts: list, failed: list[bool]) -> None:
        self.counting = isinstance(breaker, Breaker)
        self.size, self.trials = (breaker.threshold, 1) if self.counting else (breaker.window, breaker.trials)
        self.rate = 1.0 if self.counting else breaker.threshold
        self.side, self.pause = "right" if self.counting else "left", breaker.pause // timedelta(microseconds=1)
        at, bad, n = np.array([_micros(t) for t in ts], np.int64), np.array(failed, np.int64), len(ts)
        self.n, size, trials = n, self.size, self.trials
        total = np.concatenate([[0], np.cumsum(bad)])
        trips = np.zeros(n + 1, bool)
        if n >= size:
            trips[size - 1 : n] = (total[size:] - total[:-size]) / size >= self.rate
        next_trip = np.minimum.accumulate(np.where(trips, np.arange(n + 1), n)[::-1])[::-1]
        ready = np.maximum(np.searchsorted(at, at + self.pause, self.side), np.arange(1, n + 1))
        tried: list[_End | None] = [None] * (n + 1)
        closed: list[_End | None] = [None] * (n + 1)

        def opened(p: int, calls: int) -> _End:
            """After the call ``p`` opened it, by so many calls."""
            r = int(ready[p])
            return tried[r] if r < n else _End(OPEN, int(at[p]), tuple(bad[p - calls + 1 : p + 1].tolist()))

        def from_window(p: int, begun: int) -> _End:
            if p >= n:
                return _End(CLOSED, None, tuple(bad[max(begun, n - size) :].tolist()), settled=True)
            return replace(opened(p, size), settled=True) if not (e := opened(p, size)).settled else e

        for j in range(n, -1, -1):
            closed[j] = from_window(int(next_trip[min(n, j + size - 1)]), j)
            q = j + trials - 1
            if q >= n:
                tried[j] = _End(HALF_OPEN, None, tuple(bad[j:].tolist()))
            elif (total[q + 1] - total[j]) / trials >= self.rate:
                end = opened(q, trials)
                tried[j] = end if end.settled else replace(end, reopened=end.reopened + 1)
            else:
                tried[j] = closed[q + 1]
        self.own = from_window(int(next_trip[min(n, size)]), 0)
        head = max(size, trials)
        last = max(head, int(np.searchsorted(at, at[min(n, head) - 1] + self.pause, self.side)))
        self.at, self.bad, self.tried = at[: last + 1], bad[:head], tried[: last + 1]
        self.closed = closed[: trials + 1]

    def _open_end(self, since: int, recent: tuple) -> _End:
        r = int(np.searchsorted(self.at, since + self.pause, self.side))
        return self.tried[r] if r < self.n else _End(OPEN, since, recent)

    def _after_call(self, k: int, recent: tuple) -> _End:
        """After the call ``k`` opened it; a trial comes later than that call."""
        r = max(k + 1, int(np.searchsorted(self.at, int(self.at[k]) + self.pause, self.side)))
        return self.tried[r] if r < self.n else _End(OPEN, int(self.at[k]), recent)

    def _end(self, breaker: Breaker | RateBreaker) -> _End:
        if breaker.state == OPEN:
            since = _micros(breaker.last if self.counting else breaker.since)
            return self._open_end(since, () if self.counting else tuple(breaker.recent))
        recent = [1] * breaker.failures if self.counting else [int(x) for x in breaker.recent]
        size = self.trials if breaker.state == HALF_OPEN else self.size
        for k in range(min(self.n, len(self.bad), size)):
            recent = [*recent, int(self.bad[k])][-size:]
            if len(recent) == size:
                if sum(recent) / size >= self.rate:
                    return replace(e, settled=True) if not (e := self._after_call(k, tuple(recent))).settled else e
                if breaker.state == HALF_OPEN:
                    return self.closed[k + 1]
        if breaker.state == HALF_OPEN or self.n < self.size:
            return _End(breaker.state, None, tuple(recent), settled=True)
        return self.own

    def __call__(self, breaker: Breaker | RateBreaker) -> Breaker | RateBreaker:
        end = self._end(breaker)
        since = None if end.since is None else _EPOCH + timedelta(microseconds=end.since)
        if not self.counting:
            return replace(breaker, state=end.state, since=since, recent=deque(map(bool, end.recent)))
        if end.state == CLOSED:
            streak = next((k for k, x in enumerate(reversed(end.recent)) if not x), len(end.recent))
            return replace(breaker, state=CLOSED, failures=streak, last=None)
        return replace(breaker, state=OPEN, failures=(self.size if end.settled else breaker.failures) + end.reopened, last=since)


def breaker_trace(calls: DataFrame, threshold: int = 3, open_for: timedelta = timedelta(seconds=5), mode: str = "count",
                  window: int = 5, rate: float = 0.5, trials: int = 2, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Each call's state before, decision, state after and failures, by service in time order.

    ``mode="count"``: consecutive failures; ``mode="rate"``: the failure rate of a window of calls. A service's calls are
    gone through in ranges at once, each from the state that the ranges before it lead to.
    """

    def start(_row):
        return Breaker(threshold, open_for) if mode == "count" else RateBreaker(window, rate, open_for, trials)

    def step(state, row) -> tuple:
        return (row.seq, *state.call(row.ts, bool(row.failed)))

    def summary(first, rows: list) -> CallRange:
        return CallRange(first, [r.ts for r in rows], [bool(r.failed) for r in rows])

    asked = calls.select("seq", "ts", "service", "failed")
    return range_fold(asked, "service", ["ts", "seq"], start, step, summary, TRACE, rows_a_range)
