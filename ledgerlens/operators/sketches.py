"""Histograms of bounded relative error as a column: stored once, merged from hours to days, read for percentiles.

A cell holds whole values that agree in their first eleven binary digits, so what a cell stands for is off by less than
one part in 1024 (three decimal digits); values under 2048 are exact, and there is no largest value. A sketch is a row
with an array of its cells that have rows, at most some 1024 for each power of two between the smallest and the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators.latency import ranks
from ledgerlens.operators.ranges import written
from ledgerlens.session import shared_folder

#: Cells for each power of two; a fixed value of the three-digit tracker.
CELLS = 1024
#: One more than the cell of the largest 64-bit value.
ALL_CELLS = 54 * CELLS
#: Omitted values of one value that are listed one by one, at most, and of many values, about, that a task lists at once.
LISTED, AT_ONCE = 1 << 14, 1 << 19
SKETCH = "n bigint, largest bigint, cells array<struct<cell: bigint, freq: bigint>>"


def _times_two_to(x: Column, exponent: Column) -> Column:
    return F.call_function("shiftleft", x, exponent.cast("int"))


def cell_of(value: Column) -> Column:
    """The cell of a whole value from 0 on."""
    exponent = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))) - 10).cast("int")
    return exponent.cast("bigint") * CELLS + F.call_function("shiftright", value.cast("bigint"), exponent)


def _exponent(cell: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(cell / CELLS) - 1)


def lowest(cell: Column) -> Column:
    """The smallest value of a cell."""
    return _times_two_to(cell - _exponent(cell) * CELLS, _exponent(cell))


def _collected(cells: DataFrame, keys: list[str]) -> DataFrame:
    counted = cells.groupBy(*keys, "cell").agg(F.sum("freq").alias("freq"), F.max("largest").alias("largest"))
    return counted.groupBy(*keys).agg(
        F.sum("freq").alias("n"),
        F.max("largest").alias("largest"),
        F.sort_array(F.collect_list(F.struct("cell", "freq"))).alias("cells"),
    )


def _cells(v: np.ndarray) -> np.ndarray:
    """``cell_of`` for an array."""
    exponent = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 11, 0)
    return exponent * CELLS + (v >> exponent)


def _lows(cell: np.ndarray) -> np.ndarray:
    """``lowest`` for an array."""
    exponent = np.maximum(cell // CELLS - 1, 0)
    return (cell - exponent * CELLS) << exponent


def _add_omitted(counts: np.ndarray, v: np.ndarray, freq: np.ndarray, i: int) -> None:
    """Adds to each cell's count the values from v - i down to i in steps of i: one by one if few, else from cells' bounds."""
    steps = np.maximum(v // i - 1, 0)
    few = np.flatnonzero((steps > 0) & (steps <= LISTED))
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(steps[few]) // AT_ONCE)) + 1):
        n = steps[part]
        k = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
        cells = _cells(np.repeat(v[part], n) - k * i)
        found = np.bincount(cells, np.repeat(freq[part], n)).astype(np.int64)
        counts[: len(found)] += found
    for value, times in zip(v[steps > LISTED].tolist(), freq[steps > LISTED].tolist(), strict=True):
        first, last = _cells(np.array([i, value - i]))
        cells = np.arange(first, last + 1)
        low, high = np.maximum(_lows(cells), i), np.minimum(_lows(cells + 1) - 1, value - i)
        counts[cells] += times * np.where(high >= low, (value - low) // i - (value - high - 1) // i, 0)


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Numbers from 0 on, equal for rows with equal ``keys``."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
    return codes


def _corrected(values: DataFrame, keys: list[str], i: int) -> DataFrame:
    """``(keys, n, largest, cells, edge)`` from ``(keys, v, freq)``, omitted values included.

    Rows are cut into ranges by key and value, so one key's can go over many tasks; only the first and the last key of a
    task, its ``edge``, can have rows in another. A task holds the counts of one key's cells at a time.
    """
    result = StructType([*(values.schema[k] for k in keys), *StructType.fromDDL(f"{SKETCH}, edge boolean").fields])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        named = pa.Table.from_batches([r[0] for r in rows]).combine_chunks().to_batches()[0]
        cells, freqs = ([r[k] for r in rows] for k in (2, 3))
        ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (cells, freqs)], ["cell", "freq"])
        held = [pa.array([int(f.sum()) for f in freqs], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        held += [pa.ListArray.from_arrays(pa.array(ends), pairs), pa.array([r[4] for r in rows])]
        return pa.RecordBatch.from_arrays([*named.columns, *held], names=result.names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, largest, edge, counts, rows, size = None, 0, True, np.zeros(ALL_CELLS, np.int64), [], 0

        def row(edge: bool) -> tuple:
            used = counts[: int(_cells(np.array([largest]))[0]) + 1]
            cells = np.flatnonzero(used)
            freqs = used[cells]
            used[:] = 0
            return key, largest, cells, freqs, edge

        for batch in batches:
            if not batch.num_rows:
                continue
            v, freq = (batch.column(name).to_numpy() for name in ("v", "freq"))
            codes = _codes(batch, keys)
            found = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
            for a, b in zip(found, [*found[1:], batch.num_rows], strict=True):
                own = batch.select(keys).slice(a, 1)
                if key is not None and (a or not key.equals(own)):
                    rows.append(row(edge))
                    size += len(rows[-1][2])
                    largest, edge = 0, False
                    if size > AT_ONCE:
                        yield told(rows)
                        rows, size = [], 0
                key, largest = own, max(largest, int(v[a:b].max()))
                np.add.at(counts, _cells(v[a:b]), freq[a:b])
                _add_omitted(counts, v[a:b], freq[a:b], i)
        if key is not None:
            yield told([*rows, row(True)])

    dealt = values.select(*keys, "v", "freq").repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    return dealt.mapInArrow(pieces, result)


def sketch(df: DataFrame, keys: list[str], column: str, interval: int | None = None) -> DataFrame:
    """``(keys, n, largest, cells)`` of a whole, non-negative column; nulls aren't counted, values below 0 count as 0.

    With ``interval``, what a blocked caller would have measured besides is counted too: a value v stands also for v - i,
    v - 2 i, ... down to i. They are added up in the task that has v and never become rows, and all are exact, as they come
    from v itself and not from its cell. Of a value of very many intervals, how many fall into a cell follows from its bounds.
    """
    v = F.greatest(F.col(column), F.lit(0)).cast("bigint").alias("v")
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("freq"))
    if interval is None:
        return _collected(values.select(*keys, cell_of(F.col("v")).alias("cell"), "freq", F.col("v").alias("largest")), keys)
    found = written(_corrected(values, keys, interval), shared_folder(df.sparkSession, "sketches"), "pieces")
    return found.where("NOT edge").drop("edge").unionByName(merged(found.where("edge"), keys))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches with equal ``keys`` as one, as if made from all their values; no value is read again.

    A task adds up the sketches that it has side by side before their cells become rows.
    """
    cells = StructType([*(sketches.schema[k] for k in keys), *StructType.fromDDL("cell bigint, freq bigint, largest bigint").fields])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, held = _codes(batch, keys), batch.column("cells")
            _, first = np.unique(codes, return_index=True)
            largest = np.zeros(len(first), np.int64)
            np.maximum.at(largest, codes, batch.column("largest").to_numpy())
            cell, freq = (x.to_numpy() for x in held.flatten().flatten())
            each = np.repeat(codes, held.value_lengths().to_numpy()) * ALL_CELLS + cell
            every, place = np.unique(each, return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, freq)
            for at in range(0, len(every), AT_ONCE):
                group, cell = np.divmod(every[at : at + AT_ONCE], ALL_CELLS)
                named = batch.select(keys).take(pa.array(first[group])).columns
                counts = [pa.array(x) for x in (cell, total[at : at + AT_ONCE], largest[group])]
                yield pa.RecordBatch.from_arrays([*named, *counts], names=cells.names)

    return _collected(sketches.select(*keys, "largest", "cells").mapInArrow(sums, cells), keys)


def sketch_percentiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest-rank percentiles, at most one part in 1024 above the true ones and never below; ``n`` and ``max`` are exact."""
    cells = sketches.select(*keys, "largest", F.explode("cells").alias("c"))
    value = F.least(lowest(F.col("c.cell") + 1) - 1, F.col("largest"))
    return ranks(cells.select(*keys, value.alias("value"), F.col("c.freq").alias("freq")), keys, "value").drop("mean_us")
