"""Streams with state over several micro-batches: expiry, late rows, timers, restarts."""

import tempfile
import time
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.resilience import Breaker
from ledgerlens.streaming import streams

DAY = datetime(2024, 1, 1)


@pytest.fixture
def run(spark):
    """Appends rows to a folder, runs a stream over what is new, and returns what its sink holds so far."""
    base = "file://" + tempfile.mkdtemp(prefix="spark-")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)

    def batch(rows, schema, build, endless=False):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

        def sink(df, batch_id):
            df.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

        query = build(streams.file_stream(spark, f"{base}/in", schema, max_files=1)).writeStream.outputMode("append")
        query = query.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
        if endless:  # with a time to live there may always be another batch
            started, ends = query.trigger(processingTime="500 milliseconds").start(), time.monotonic() + 60
            while not any(p["numInputRows"] for p in started.recentProgress) and time.monotonic() < ends:
                time.sleep(0.2)
            started.stop()
        else:
            query.trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.read.parquet(f"{base}/out").drop("batch").collect()]

    yield batch
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


DEBITS = "account_id string, request_id string, amount_cents long, ts timestamp, seq long, opening_cents long"


def debit(seq, request, hours, amount=10):
    return "a", request, amount, DAY + timedelta(hours=hours), seq, 100


def test_applied_requests_are_forgotten_by_event_time(run):
    def build(df):
        return streams.debit_ledger_stream(df, ttl=timedelta(hours=5))

    run([debit(0, "x", 0), debit(1, None, 0)], DEBITS, build)
    found = run([debit(2, "x", 4), debit(3, "x", 6), debit(4, None, 1), debit(5, "y", 6, 500)], DEBITS, build)
    said = {seq: (status, balance) for seq, status, balance in found}
    # within five hours "x" is known; after them it counts as new
    assert said == {0: ("APPLIED", 90), 1: ("APPLIED", 80), 4: ("DUPLICATE", 80), 2: ("DUPLICATE", 80), 3: ("APPLIED", 70), 5: ("INSUFFICIENT", 70)}


def test_the_store_drops_old_requests(run):
    def build(df):
        return streams.debit_ledger_stream(df, state_ttl=timedelta(seconds=20))

    run([debit(0, "x", 0)], DEBITS, build, endless=True)
    run([debit(1, "x", 0)], DEBITS, build, endless=True)
    time.sleep(20)
    found = run([debit(2, "x", 0)], DEBITS, build, endless=True)
    assert sorted(found) == [(0, "APPLIED", 90), (1, "DUPLICATE", 90), (2, "APPLIED", 80)]


CALLS = "seq long, ts timestamp, service string, failed boolean"


def call(seq, seconds, failed, service="s"):
    return seq, DAY + timedelta(seconds=seconds), service, failed


def test_a_pause_ends_without_a_call_and_late_calls_are_dropped(run):
    def build(df):
        return streams.rate_breaker_stream(df, "10 seconds", timedelta(seconds=30), window=2, rate=0.5, trials=1)

    run([call(0, 0, True), call(1, 1, True)], CALLS, build)  # opens at 1, to be tried from 31 on
    found = run([call(2, 100, False, "other")], CALLS, build)  # the watermark goes to 90
    over = [r for r in found if r[0] is None]
    at = int((DAY - datetime(1970, 1, 1)).total_seconds() + 31) * 1_000_000
    assert over == [(None, "s", at, "OPEN", streams.PAUSE_OVER, "HALF_OPEN", 0)]
    found = run([call(3, 80, True), call(4, 101, False)], CALLS, build)  # 80 is late
    last = {r[0]: r[3:6] for r in found}
    assert 3 not in last and last[4] == ("HALF_OPEN", "CALLED", "CLOSED")
    assert len([r for r in found if r[0] is None]) == 1  # the pause ended once


def test_a_call_after_the_pause_ends_it(run):
    def build(df):
        return streams.rate_breaker_stream(df, "1 hour", timedelta(seconds=30), window=2, rate=0.5, trials=1)

    run([call(0, 0, True), call(1, 1, True), call(2, 5, False)], CALLS, build)
    found = run([call(3, 40, True), call(4, 5000, False)], CALLS, build)
    order = sorted(found, key=lambda r: (r[2], r[0] is not None))
    assert [r[4] for r in order] == ["CALLED", "CALLED", "REJECTED", streams.PAUSE_OVER, "CALLED", streams.PAUSE_OVER, "CALLED"]
    assert [r[5] for r in order] == ["CLOSED", "OPEN", "OPEN", "HALF_OPEN", "OPEN", "HALF_OPEN", "CLOSED"]


def test_the_percentile_of_a_window_is_exact(spark):
    """Far more rows a window than an approximate percentile is exact for; a count whose hundredth is a whole number."""
    values = [int(k * k % 100_003 * 1.7) for k in range(60_000)]
    late = spark.createDataFrame([(DAY, v) for v in values], "ts timestamp, latency_ms long").withColumn("endpoint", F.lit("a"))
    found = streams.sla_monitor(late, 200, "40 days", "1 day").first()
    p99 = sorted(values)[60_000 * 99 // 100 - 1]
    assert (found["n"], found["p99"], found["breached"]) == (60_000, p99, True)


def test_a_large_key_is_told_in_parts():
    """What a task holds of a key's micro-batch are its times, numbers and outcomes; calls and answers are never all there."""

    class State:
        def exists(self):
            return False

        def update(self, value):
            self.value = value

    rows, at_once = 100_000, 10_000
    order = np.random.default_rng(2).permutation(rows)

    def frames():
        for at in range(0, rows, at_once):
            k = order[at : at + at_once]
            yield pd.DataFrame({"seq": k, "ts": pd.Timestamp(DAY) + pd.to_timedelta(k // 2, "s"), "service": "s" * 50, "failed": k % 5 < 3})

    processor = streams._Breaker(3, timedelta(seconds=30))
    processor.state = State()
    tracemalloc.start()
    found = [len(part) for part in processor.handleInputRows(("s",), frames(), None) if part.seq.is_monotonic_increasing]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [at_once] * (rows // at_once) and peak < 120 * rows
    breaker = Breaker(3, timedelta(seconds=30))
    for k in range(rows):
        breaker.call(pd.Timestamp(DAY) + timedelta(seconds=k // 2), k % 5 < 3)
    assert processor.state.value[:2] == (breaker.state, breaker.failures)
