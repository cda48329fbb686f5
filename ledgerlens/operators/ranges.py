"""Order-dependent folds over ranges of a key's rows, so that a key of any size is spread over many tasks.

A key of no more rows than a range is folded in one pass. The rows of all others are put in order of key and time and cut into ranges of about equal size. Each range of a key that goes over several
is summed up as a function from the state before it to the state after it. These functions are applied one after
another, a row a range, which gives the state that each range begins with; then all ranges are gone through at once.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.folds import sorted_fold
from ledgerlens.session import shared_folder

#: Rows of a range, about, as long as that makes at most ``MOST_RANGES``.
ROWS_A_RANGE, MOST_RANGES = 1 << 14, 1 << 15


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table in a shared folder, so that ranges stay what they are if executors are lost."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def in_ranges(df: DataFrame, key: str, order: list[str], folder: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with ``_part``, its range in the order of ``key`` and ``order``, and ``_at``, which goes up in that order."""
    parts = min(MOST_RANGES, 1 + df.count() // rows_a_range)
    ordered = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    # the id counts up within a sorted partition, from the partition's number times 2^33
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    return written(ordered, folder, "ranges")


def large_keys(df: DataFrame, key: str, rows_a_range: int, folder: str) -> DataFrame:
    """The keys of more rows than a range, as a table: fewer than the rows have ranges."""
    large = df.groupBy(key).count().where(F.col("count") > rows_a_range).select(F.col(key).alias("_large"))
    return written(large, folder, "large")


def spread_keys(ranged: DataFrame, key: str) -> DataFrame:
    """The keys that go over several ranges: fewer than there are ranges."""
    parts = ranged.select(key, "_part").distinct()
    return parts.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key"))


def _rows(table: pa.Table, row_of: type) -> list:
    return list(map(row_of, *(c.to_pylist() for c in table.columns))) if table.num_rows else []


def range_fold(
    df: DataFrame,
    key: str,
    order: list[str],
    start: Callable[[Any], Any],
    step: Callable[[Any, Any], tuple],
    summary: Callable[[Any, list], Callable[[Any], Any]],
    schema: str,
    rows_a_range: int = ROWS_A_RANGE,
) -> DataFrame:
    """``step(state, row)`` over the rows of each key in order; it changes the state and returns a result row.

    ``start(row)`` is the state before a key's first row. ``summary(first state, rows)`` is what a range does: a function
    (one that can be pickled) from any state before its rows to the state after them. Null keys are one key.
    """
    folder = shared_folder(df.sparkSession, "ranges")
    result = df.sparkSession.createDataFrame([], schema).toArrow().schema
    names = df.columns
    row_of = namedtuple("Row", names)
    large = large_keys(df, key, rows_a_range, folder)
    is_large = df[key].eqNullSafe(large["_large"])
    folded = sorted_fold(df.join(large, is_large, "left_anti"), key, order, start, step, schema)
    if large.isEmpty():
        return folded
    ranged = in_ranges(df.join(large, is_large, "left_semi"), key, order, folder, rows_a_range)
    spread = written(spread_keys(ranged, key), folder, "spread")
    kind = df.schema[key].dataType.simpleString()

    def sum_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        rows = _rows(table.select(names), row_of)
        first = start(rows[0])
        said = pickle.dumps((first, summary(first, rows)))
        return pa.table({"_part": table["_part"][:1], "_key": table[key][:1], "said": pa.array([said], pa.binary())})

    def scan(table: pa.Table) -> pa.Table:
        """The state that each range of a key begins with."""
        table, states, state = table.sort_by("_part"), [], None
        for k, said in enumerate(table["said"].to_pylist()):
            first, after = pickle.loads(said)
            state = state if k else first
            states.append(pickle.dumps(state))
            state = after(state)
        return pa.table({"_part": table["_part"], "_key": table["_key"], "state": pa.array(states, pa.binary())})

    # fewer rows than ranges, at most MOST_RANGES: a broadcast with a bound
    of_spread = ranged.join(F.broadcast(spread), ranged[key].eqNullSafe(spread["_key"]), "left_semi")
    said = written(of_spread.groupBy("_part", key).applyInArrow(sum_up, f"_part long, _key {kind}, said binary"), folder, "summaries")
    states = written(said.groupBy("_key").applyInArrow(scan, f"_part long, _key {kind}, state binary"), folder, "states")

    def replay(table: pa.Table, begun: pa.Table) -> pa.Table:
        known = {k: pickle.loads(s) for k, s in zip(begun["_key"].to_pylist(), begun["state"].to_pylist(), strict=True)}
        current, state, out = object(), None, []
        for row in _rows(table.sort_by("_at").select(names), row_of):
            name = getattr(row, key)
            if name != current:
                current, state = name, known[name] if name in known else start(row)
            out.append(step(state, row))
        columns = zip(*out, strict=True) if out else [[] for _ in result]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, result, strict=True)], schema=result)

    replayed = ranged.groupBy("_part").cogroup(states.groupBy("_part")).applyInArrow(replay, schema)
    return replayed.unionByName(folded)
