"""Latency percentiles, service-level reports, coordinated omission and load phases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scoring import expected_rate
from ledgerlens.operators.ordering import positions
from ledgerlens.operators.ranges import written
from ledgerlens.session import shared_folder

#: The targets in milliseconds, by percentile.
TARGETS = {"p50": 50, "p95": 150, "p99": 200, "p99_9": 500}
LEVELS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
#: Phantom values that one row lists at a time.
LISTED = 4096
#: Load phases that are sent to every task, at most.
PHASE_LIMIT = 10_000


def latency_of(start_ns: Column, end_ns: Column) -> Column:
    """Whole milliseconds between two clock readings; 0 while there is no end."""
    return F.when(end_ns > 0, F.floor((end_ns - start_ns) / 1_000_000)).otherwise(0).cast("bigint")


def ranks(grouped_counts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Nearest-rank percentiles from ``(keys, column, freq)``: exact, on one row a distinct value."""
    up_to = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = grouped_counts.withColumns(
        {"_cum": F.sum("freq").over(up_to), "_all": F.sum("freq").over(Window.partitionBy(*keys))}
    )
    levels = [
        F.min(F.when(F.col("_cum") >= F.ceil(F.round(F.col("_all") * q, 6)), F.col(column))).alias(name) for name, q in LEVELS.items()
    ]
    return ranked.groupBy(*keys).agg(
        F.sum("freq").alias("n"),
        *levels,
        F.max(column).alias("max"),
        F.floor(F.sum(F.col(column) * F.col("freq")) * 1000 / F.sum("freq")).cast("bigint").alias("mean_us"),
    )


def latency_percentiles(df: DataFrame, keys: list[str], column: str = "latency_ms") -> DataFrame:
    """Count, nearest-rank percentiles, maximum and mean (in thousandths) by key.

    Values are whole milliseconds, so counting them first leaves few rows and no group is sorted whole.
    """
    return ranks(df.groupBy(*keys, column).agg(F.count("*").alias("freq")), keys, column)


def latency_percentiles_approx(df: DataFrame, keys: list[str], column: str = "latency_ms", accuracy: int = 10_000) -> DataFrame:
    """The same levels by sketches, for values that aren't whole."""
    return df.groupBy(*keys).agg(*(F.percentile_approx(column, q, accuracy).alias(name) for name, q in LEVELS.items()))


def running_mean(column: str) -> Column:
    """The mean, 0 without rows."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def expand_omitted(df: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    """``(keys, latency_ms, freq)`` with what a blocked caller would have measured besides.

    A value v over the interval i stands also for v - i, v - 2 i, ... down to i, however large it is. Equal values are
    counted first, and a value's list is made in parts.
    """
    counted = df.groupBy(*keys, "latency_ms").agg(F.count("*").alias("freq"))
    v, i = F.col("latency_ms"), F.lit(interval_ms)
    steps = F.greatest(F.floor(v / i) - 1, F.lit(0))  # v - steps * i is the last from i on
    parts = counted.withColumn("_steps", steps).withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_steps")) / LISTED))))
    first = F.col("_part") * LISTED
    last = F.least(F.col("_steps"), first + LISTED - 1)
    listed = parts.select(*keys, F.explode(F.transform(F.sequence(first, last), lambda k: v - k * i)).alias("latency_ms"), "freq")
    return listed.groupBy(*keys, "latency_ms").agg(F.sum("freq").alias("freq"))


def corrected_percentiles(df: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    return ranks(expand_omitted(df, keys, interval_ms), keys, "latency_ms")


def sla_report(df: DataFrame, keys: list[str], targets: dict[str, int] | None = None) -> DataFrame:
    """A row a key and level: ``(metric, actual, target, status)``; it passes if it isn't over the target."""
    targets = targets or TARGETS
    wide = latency_percentiles(df, keys)
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual"), F.lit(t).cast("bigint").alias("target")) for m, t in targets.items()))
    report = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return report.withColumn("status", F.when(F.col("actual") <= F.col("target"), "PASS").otherwise("FAIL"))


def breach_counts(df: DataFrame, keys: list[str], limit_ms: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("latency_ms") > limit_ms).alias("breaches"))


def throughput(n: Column, elapsed_ms: Column) -> Column:
    return F.floor(n * 1000 / F.greatest(F.lit(1), elapsed_ms)).cast("bigint")


def tracker_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """By key: rows, running mean, and whole rows a second over the time between the first and the last."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    elapsed = F.floor((F.max(micros) - F.min(micros)) / 1000)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), running_mean("latency_ms").alias("mean_ms"), throughput(F.count("*"), elapsed).alias("per_second")
    )


def compare_variants(df: DataFrame, base: str, candidate: str) -> DataFrame:
    """The 99th percentiles of two variants, and how much lower the candidate's is, in whole ms and percent."""
    p = latency_percentiles(df, ["variant"])
    both = p.agg(*(F.max(F.when(F.col("variant") == v, F.col("p99"))).alias(f"{name}_p99") for name, v in (("base", base), ("candidate", candidate))))
    saved = F.col("base_p99") - F.col("candidate_p99")
    return both.withColumns(
        {"saved_ms": saved, "saved_percent": F.round(100.0 * saved / F.greatest(F.lit(1), F.col("base_p99")), 6)}
    )


#: Blocks that one task goes through, as long as that makes at most ``MOST_GROUPS`` groups of blocks, and groups of a level.
BLOCKS_A_GROUP, MOST_GROUPS, GROUPS_A_LEVEL = 1_000, 50_000, 256
_HISTOGRAM = "names binary, counts binary"


class _Histogram:
    """How often each whole value occurs, as sorted values and their counts."""

    def __init__(self, names=None, counts=None) -> None:
        self.names = np.zeros(0, np.int64) if names is None else np.asarray(names, np.int64)
        self.counts = np.zeros(0, np.int64) if counts is None else np.asarray(counts, np.int64)

    @classmethod
    def read(cls, names: bytes, counts: bytes) -> _Histogram:
        return cls(np.frombuffer(names, np.int64), np.frombuffer(counts, np.int64))

    def plus(self, names, counts) -> _Histogram:
        every, place = np.unique(np.concatenate([self.names, np.asarray(names, np.int64)]), return_inverse=True)
        return _Histogram(every, np.bincount(place, np.concatenate([self.counts, counts]), len(every)).astype(np.int64))

    def stored(self) -> tuple[bytes, bytes]:
        return self.names.tobytes(), self.counts.tobytes()


def _before_each(cells: pd.DataFrame, by: str, start: _Histogram) -> pd.DataFrame:
    """``(by, names, counts)``: the histogram of all that comes before each value of ``by``, on top of ``start``."""
    out = []
    for name, held in cells.groupby(by, sort=True):
        out.append((name, *start.stored()))
        start = start.plus(held["latency_ms"].to_numpy(), held["c"].to_numpy())
    return pd.DataFrame(out, columns=[by, "names", "counts"])


def sla_breaches(df: DataFrame, every: int = 100, target: int = TARGETS["p99"], order: str = "seq") -> DataFrame:
    """After every ``every`` rows, the 99th percentile of all rows so far, and whether it is over the target.

    Rows are cut into groups of blocks, and each group goes on from the histogram of all groups before it. These come from
    two levels: histograms of many groups each are added up in order, and under each of them those of its own groups. So
    there is a histogram a group, of the values that have come up by then, and no table of all groups by all values.
    """
    folder = shared_folder(df.sparkSession, "percentiles")
    rows = every * max(BLOCKS_A_GROUP, -(-df.count() // (every * MOST_GROUPS)))
    placed = positions(df.select(order, F.col("latency_ms").cast("bigint").alias("latency_ms")), order).select("position", "latency_ms")
    placed = written(placed.withColumn("group", F.floor(F.col("position") / rows).cast("bigint")), folder, "placed")
    cells = placed.groupBy("group", "latency_ms").agg(F.count("*").alias("c"))
    cells = written(cells.withColumn("upper", F.floor(F.col("group") / GROUPS_A_LEVEL).cast("bigint")), folder, "cells")
    counted = cells.where("latency_ms IS NOT NULL")
    uppers = counted.groupBy("upper", "latency_ms").agg(F.sum("c").alias("c"))
    # at most MOST_GROUPS / GROUPS_A_LEVEL histograms in one task
    of_upper = uppers.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(lambda t: _before_each(t, "upper", _Histogram()), f"upper long, {_HISTOGRAM}")
    of_upper = written(of_upper, folder, "upper-starts")

    def of_groups(held: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return _before_each(held, "group", _Histogram.read(*start[["names", "counts"]].iloc[0]) if len(start) else _Histogram())

    starts = counted.groupBy("upper").cogroup(of_upper.groupBy("upper")).applyInPandas(of_groups, f"group long, {_HISTOGRAM}")
    starts = written(starts, folder, "starts")

    def blocks(key: tuple, held: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        before = _Histogram.read(*start[["names", "counts"]].iloc[0]) if len(start) else _Histogram()
        held = held.sort_values("position")["latency_ms"]
        own = np.unique(held.dropna().to_numpy(np.int64))
        before = before.plus(own, np.zeros(len(own), np.int64))
        names, counts, out = before.names, before.counts.copy(), []
        for k in range(len(held) // every):
            block = held.iloc[k * every : (k + 1) * every].dropna().to_numpy(np.int64)
            counts += np.bincount(np.searchsorted(names, block), minlength=len(names))
            so_far = counts.cumsum()
            p99 = int(names[np.searchsorted(so_far, -(-99 * so_far[-1] // 100))]) if len(so_far) and so_far[-1] else None
            out.append((key[0] * rows + (k + 1) * every, p99, p99 is not None and p99 > target))
        return pd.DataFrame(out, columns=["rows_so_far", "p99", "breached"]).astype({"p99": "Int64"})

    both = placed.groupBy("group").cogroup(starts.groupBy("group"))
    return both.applyInPandas(blocks, "rows_so_far long, p99 long, breached boolean")


def phase_report(df: DataFrame, phases: DataFrame, start) -> DataFrame:
    """Per phase ``(phase, profile, from_s, to_s)``: rows, rate achieved and expected, and percentiles.

    A row is in the phase that its seconds since ``start`` fall in. The phase table is small, which is checked.
    """
    if len(phases.head(PHASE_LIMIT + 1)) > PHASE_LIMIT:
        raise ValueError(f"more than {PHASE_LIMIT} phases")
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    timed = df.withColumn("_s", F.floor(elapsed / 1_000_000))
    met = timed.join(F.broadcast(phases), (F.col("_s") >= F.col("from_s")) & (F.col("_s") < F.col("to_s")))
    keys = ["phase", "profile", "from_s", "to_s"]
    report = latency_percentiles(met, keys)
    middle = (F.col("to_s") - F.col("from_s")) * 500
    return report.select(
        "phase", "n", "p50", "p95", "p99",
        F.round(F.col("n") / (F.col("to_s") - F.col("from_s")), 6).alias("achieved_rate"),
        expected_rate(F.col("profile"), middle).alias("expected_rate"),
    )
