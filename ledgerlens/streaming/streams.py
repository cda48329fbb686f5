"""Streaming counterparts of the ledger, the breaker, the monitors and the rule join."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.eligibility import eligible_products
from ledgerlens.operators.ledger import APPLIED, LEDGER, apply_debit
from ledgerlens.operators.resilience import CLOSED, HALF_OPEN, OPEN, TRACE, Breaker, RateBreaker

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive, at most ``max_files`` a micro-batch: the admission control of a source."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def lag(query) -> list[dict]:
    """Rows in, rates and duration of each recent micro-batch: input above processing rate means a growing backlog."""
    return [
        {
            "batch": p["batchId"],
            "rows": p["numInputRows"],
            "input_rate": p.get("inputRowsPerSecond"),
            "processed_rate": p.get("processedRowsPerSecond"),
            "behind": (p.get("inputRowsPerSecond") or 0) > (p.get("processedRowsPerSecond") or 0),
        }
        for p in query.recentProgress
    ]


#: Rows of a key that are handled, and told, at a time.
ROWS_AT_ONCE = 10_000


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch by ``ts`` and ``seq``, in parts; of all rows only ``columns`` are held."""
    found = [frame[["ts", "seq", *columns]] for frame in rows if len(frame)]
    if found:
        held = pd.concat(found, ignore_index=True)
        found.clear()
        order = np.lexsort((held["seq"].to_numpy(), held["ts"].to_numpy()))
        for at in range(0, len(order), ROWS_AT_ONCE):
            yield held.iloc[order[at : at + ROWS_AT_ONCE]]


def _name(request) -> str:
    """A request id as a key of a map; null is one too."""
    return "-" if request is None or request != request else f"={request}"


class _Ledger(StatefulProcessor):
    """Balance of an account, and a map from each applied request to its time.

    Of the map, a micro-batch reads the requests that it has and writes those that it applies, so it costs what its
    own rows cost however many requests the account has made. Requests older than the time to live, by event time,
    count as new. The store drops entries by Spark's own time to live, in processing time.
    """

    def __init__(self, ttl_us: int | None, state_ttl_ms: int | None) -> None:
        self.ttl_us, self.state_ttl_ms = ttl_us, state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "cents bigint")
        self.done = handle.getMapState("done", "request string", "at_us bigint", self.state_ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        balance = self.balance.get()[0] if self.balance.exists() else None
        for part in _in_order(rows, "request_id", "amount_cents", "opening_cents"):
            names = [_name(r) for r in part["request_id"]]
            asked = dict.fromkeys(names) if balance is not None else ()  # an account without a balance has applied nothing
            done = {name: at[0] for name in asked if (at := self.done.getValue((name,))) is not None}
            out, fresh = [], {}
            for name, row in zip(names, part.itertuples(index=False), strict=True):
                balance = int(row.opening_cents) if balance is None else balance
                now = pd.Timestamp(row.ts).value // 1000
                known = name in done and (self.ttl_us is None or now - done[name] <= self.ttl_us)
                status, balance = apply_debit(balance, known, int(row.amount_cents))
                if status == APPLIED:
                    done[name] = fresh[name] = now
                out.append((int(row.seq), status, balance))
            for name, at in fresh.items():
                self.done.updateValue((name,), (at,))
            self.balance.update((balance,))
            yield pd.DataFrame(out, columns=["seq", "status", "balance_cents"])

    def close(self) -> None:
        pass


def debit_ledger_stream(requests: DataFrame, ttl: timedelta | None = None, state_ttl: timedelta | None = None) -> DataFrame:
    """The debit ledger on a stream. A micro-batch is put in time order by account; across micro-batches the
    order is that of arrival. An applied id is remembered for ``ttl`` of event time, or for good as in a batch.

    ``state_ttl`` bounds the store: an id that was applied so long ago, by the clock, is forgotten in any case. It should
    be longer than ``ttl`` by as much as the stream may stand still. Spark then has a batch to run at any time, so such a
    stream needs a trigger that goes on (not ``availableNow``).
    """
    ttl_us = None if ttl is None else int(ttl.total_seconds() * 1_000_000)
    state_ttl_ms = None if state_ttl is None else int(state_ttl.total_seconds() * 1000)
    mode = "None" if state_ttl is None else "ProcessingTime"
    return requests.groupBy("account_id").transformWithStateInPandas(_Ledger(ttl_us, state_ttl_ms), LEDGER, "Append", mode)


class _Breaker(StatefulProcessor):
    def __init__(self, threshold: int, pause: timedelta) -> None:
        self.threshold, self.pause = threshold, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, failures bigint, last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        breaker = Breaker(self.threshold, self.pause)
        if self.state.exists():
            breaker.state, breaker.failures, last = self.state.get()
            breaker.last = None if last is None else pd.Timestamp(last, unit="us")
        for part in _in_order(rows, "failed"):
            out = [(int(r.seq), *breaker.call(pd.Timestamp(r.ts), bool(r.failed))) for r in part.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["seq", "state_before", "decision", "state_after", "failures"])
        last = None if breaker.last is None else int(breaker.last.value // 1000)
        self.state.update((breaker.state or CLOSED, breaker.failures, last))

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, threshold: int, open_for: timedelta) -> DataFrame:
    """The circuit breaker on a stream, by service; order as for the ledger."""
    return calls.groupBy("service").transformWithStateInPandas(_Breaker(threshold, open_for), TRACE, "Append", "None")


TRANSITIONS = "seq long, service string, at_us long, state_before string, decision string, state_after string, failures long"
#: The decision of a row that no call has made: the pause is over.
PAUSE_OVER = "PAUSE_OVER"


class _RateBreaker(StatefulProcessor):
    """The outcomes of the last calls are a list, state and time of opening a value, the end of a pause a timer.

    A pause ends once: with the first call after it, or with the timer if the watermark passes it before.
    """

    def __init__(self, window: int, rate: float, pause: timedelta, trials: int) -> None:
        self.settings = window, rate, pause, trials
        self.pause_us = pause // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, since_us bigint")
        self.recent = handle.getListState("recent", "failed boolean")

    def _read(self) -> RateBreaker:
        window, rate, pause, trials = self.settings
        breaker = RateBreaker(window, rate, pause, trials)
        if self.state.exists():
            breaker.state, since = self.state.get()
            breaker.since = None if since is None else pd.Timestamp(since, unit="us")
            breaker.recent.extend(x[0] for x in self.recent.get())
        return breaker

    def _write(self, breaker: RateBreaker) -> None:
        self.state.update((breaker.state, None if breaker.since is None else breaker.since.value // 1000))
        if breaker.recent:
            self.recent.put([(bool(x),) for x in breaker.recent])
        else:
            self.recent.clear()

    def _ends(self, breaker: RateBreaker) -> int:
        return breaker.since.value // 1000 + self.pause_us

    def _over(self, breaker: RateBreaker, service) -> tuple:
        ended = self._ends(breaker)
        breaker.state, breaker.recent = HALF_OPEN, deque()
        return None, service, ended, OPEN, PAUSE_OVER, HALF_OPEN, 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        breaker = self._read()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        for part in _in_order(rows, "failed"):
            out = []
            for row in part.itertuples(index=False):
                at = pd.Timestamp(row.ts)
                at_us = at.value // 1000
                if at_us < passed_us:  # late: what followed it has been told
                    continue
                if breaker.state == OPEN and at_us >= self._ends(breaker):
                    out.append(self._over(breaker, key[0]))
                out.append((int(row.seq), key[0], at_us, *breaker.call(at, bool(row.failed))))
            yield self._table(out)
        if breaker.state == OPEN:
            self.handle.registerTimer(-(-self._ends(breaker) // 1000))
        self._write(breaker)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        breaker = self._read()
        out = [self._over(breaker, key[0])] if breaker.state == OPEN else []
        self._write(breaker)
        yield self._table(out)

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSITIONS.split(", ")]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def rate_breaker_stream(calls: DataFrame, delay: str, open_for: timedelta, window: int = 5, rate: float = 0.5, trials: int = 2) -> DataFrame:
    """The rate breaker on a stream, by service: a row a call, and a row when a pause is over.

    The latter comes at the end of the pause whether or not a call follows. Calls later than ``delay`` are dropped.
    """
    timed = calls.withWatermark("ts", delay).groupBy("service")
    return timed.transformWithStateInPandas(_RateBreaker(window, rate, open_for, trials), TRANSITIONS, "Append", "EventTime")


def dedup_stream(requests: DataFrame, delay: str) -> DataFrame:
    """The first row of each request id among those that come within ``delay`` of event time."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def traffic_metrics(stream: DataFrame, approved, delay: str, window: str = "5 seconds") -> DataFrame:
    """Requests and approvals by window of event time."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"))
    return counted.agg(F.count("*").alias("n"), F.count_if(approved).alias("approved")).select(
        F.unix_micros("w.start").alias("window_us"), "n", "approved"
    )


#: Just under 0.99, so that the double product with a count is never above the exact one, for up to 10^10 rows a group.
P99 = "0.989999999999D"


def sla_monitor(stream: DataFrame, target_ms: int, delay: str, window: str) -> DataFrame:
    """By window and endpoint: rows, rows over the target, the nearest-rank 99th percentile and whether it is over.

    The percentile is exact: a group's state counts its distinct whole milliseconds, however many rows it has.
    """
    grouped = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "endpoint")
    return grouped.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("latency_ms") > target_ms).alias("breaches"),
        F.expr(f"percentile_disc({P99}) WITHIN GROUP (ORDER BY latency_ms)").cast("bigint").alias("p99"),
    ).select(F.unix_micros("w.start").alias("window_us"), "endpoint", "n", "breaches", "p99", (F.col("p99") > target_ms).alias("breached"))


class RuleCache:
    """Rules that are read again when they are older than ``max_age``; a failed read raises."""

    def __init__(self, load: Callable[[], DataFrame], max_age: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.max_age, self.clock, self.read_at, self.rules = load, max_age, clock, None, None

    def get(self) -> DataFrame:
        if self.read_at is None or self.clock() - self.read_at >= self.max_age:
            self.rules, self.read_at = self.load(), self.clock()
        return self.rules


def score_batches(cache: RuleCache, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: profiles of a micro-batch joined to the rules as they are then."""

    def batch(profiles: DataFrame, batch_id: int) -> None:
        sink(eligible_products(profiles, cache.get()), batch_id)

    return batch


def audit_batches(path: str, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each micro-batch to an audit table before the real sink."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        then(rows, batch_id)

    return batch
