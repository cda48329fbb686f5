"""Waiting and computing, threads, Little's law and backlogs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import ROWS_A_RANGE, in_ranges, range_fold
from ledgerlens.session import shared_folder


def capacity_report(activities: DataFrame, cores: int) -> DataFrame:
    """By request type: waiting and computing time, their ratio, threads for so many cores, blocking coefficient."""
    sums = activities.groupBy("request_type").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("ms")).otherwise(0.0)).alias(f"{k.lower()}_ms") for k in ("WAIT", "COMPUTE"))
    )
    ratio = F.try_divide("wait_ms", "compute_ms")
    return sums.select(
        "request_type",
        F.round("wait_ms", 4).alias("wait_ms"),
        F.round("compute_ms", 4).alias("compute_ms"),
        F.round(ratio, 6).alias("wait_compute_ratio"),
        F.round(cores * (1 + ratio), 4).alias("threads"),
        F.round(F.try_divide(F.col("wait_ms"), F.col("wait_ms") + F.col("compute_ms")), 6).alias("blocking_coefficient"),
    )


def littles_law(requests: DataFrame, seconds: int) -> DataFrame:
    """By window of time: arrivals a second, mean time in the system, and how many are in it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window = F.floor(micros / (seconds * 1_000_000)).cast("bigint")
    sums = requests.groupBy(window.alias("window")).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"))
    rate, mean = F.col("n") / F.lit(float(seconds)), F.col("total_ms") / F.col("n") / 1000.0
    return sums.select(
        "window", "n", F.round(rate, 6).alias("rate"), F.round(mean, 6).alias("mean_seconds"), F.round(rate * mean, 6).alias("in_system")
    )


def backlog(arrivals: DataFrame, completions: DataFrame, capacity: int) -> DataFrame:
    """``(ts, change, size, above)``: the queue's size after each instant, and whether it is over the capacity.

    Instants are added up first, so the running sum goes over one row an instant.
    """
    events = arrivals.select("ts", F.lit(1).alias("d")).unionByName(completions.select("ts", F.lit(-1).alias("d")))
    changes = events.groupBy("ts").agg(F.sum("d").alias("change"))
    # a running sum in two steps: within a month, and over the months before it
    month = F.date_trunc("month", "ts")
    months = changes.groupBy(month.alias("_month")).agg(F.sum("change").alias("_sum"))
    front = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    before = months.select("_month", F.coalesce(F.sum("_sum").over(front), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_month").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    sized = changes.withColumn("_month", month).withColumn("_within", F.sum("change").over(within))
    return sized.join(before, "_month").select(
        "ts", "change", (F.col("_before") + F.col("_within")).alias("size"),
        (F.col("_before") + F.col("_within") > capacity).alias("above"),
    )


@dataclass(frozen=True)
class Clamp:
    """``x -> min(high, max(low, x + shift))``. One after another they make another such function."""

    low: int
    high: int
    shift: int

    def __call__(self, x: int) -> int:
        return min(self.high, max(self.low, x + self.shift))

    def then(self, other: Clamp) -> Clamp:
        return Clamp(other(self.low), other(self.high), self.shift + other.shift)


def bounded_queue(events: DataFrame, capacity: int, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``(seq, size, refused, starved)`` of each put (``change`` 1) and take (-1) on queues ``queue``, in the order of ``ts, seq``.

    A put on a full queue is refused, a take from an empty one gets nothing; neither comes back. The size after each
    event is a running sum that is held between 0 and the capacity, by ranges of a queue's events.
    """

    def step(state: list, row) -> tuple:
        before = state[0]
        state[0] = min(capacity, max(0, before + row.change))
        return row.seq, state[0], row.change > 0 and before == capacity, row.change < 0 and before == 0

    def summary(_first, rows: list) -> _Filled:
        return _Filled(reduce(Clamp.then, (Clamp(0, capacity, row.change) for row in rows)))

    asked = events.select("seq", "ts", "queue", "change")
    return range_fold(
        asked, "queue", ["ts", "seq"], lambda _row: [0], step, summary, "seq long, size long, refused boolean, starved boolean", rows_a_range
    )


@dataclass(frozen=True)
class _Filled:
    clamp: Clamp

    def __call__(self, state: list) -> list:
        return [self.clamp(state[0])]


def blocking_queue(events: DataFrame, capacity: int, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``(seq, size, waiting_puts, waiting_takes)``: as ``bounded_queue``, but who can't go on waits for a turn.

    A put that waits goes in at the next take, so puts less takes, held between 0 and the capacity, is the size, and what is
    over it or below 0 waits.
    """
    folder = shared_folder(events.sparkSession, "queue")
    ranged = in_ranges(events.select("seq", "ts", "queue", "change"), "queue", ["ts", "seq"], folder, rows_a_range)
    front = Window.partitionBy("queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = ranged.groupBy("queue", "_part").agg(F.sum("change").alias("s"))
    before = sums.select(F.col("queue").alias("_queue"), F.col("_part").alias("_of"), F.coalesce(F.sum("s").over(front), F.lit(0)).alias("before"))
    within = Window.partitionBy("queue", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("within", F.sum("change").over(within))
    summed = summed.join(before, (summed["_part"] == before["_of"]) & summed["queue"].eqNullSafe(before["_queue"]))
    net = F.col("before") + F.col("within")
    return summed.select(
        "seq", F.greatest(F.lit(0), F.least(net, F.lit(capacity))).alias("size"),
        F.greatest(F.lit(0), net - capacity).alias("waiting_puts"), F.greatest(F.lit(0), -net).alias("waiting_takes"),
    )
