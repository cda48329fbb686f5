"""Order-dependent folds: one pass over the sorted rows of each key, with the state of one key in memory."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_fold(
    df: DataFrame,
    key: str,
    order: list[str],
    start: Callable[[Any], Any],
    step: Callable[[Any, Any], tuple],
    schema: str,
) -> DataFrame:
    """``step(state, row)`` over the rows of each key in order; it changes the state and returns a result row.

    The rows of a key meet in one partition and stream through it in Arrow batches; the state is carried
    from batch to batch and dropped when the key changes. Null keys are one key, and nulls arrive as None.
    """
    result = df.sparkSession.createDataFrame([], schema).toArrow().schema
    row_of = namedtuple("Row", df.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            out = []
            for row in map(row_of, *(column.to_pylist() for column in batch.columns)):
                if getattr(row, key) != current:
                    current = getattr(row, key)
                    state = start(row)
                out.append(step(state, row))
            columns = zip(*out, strict=True) if out else [[] for _ in result]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, result, strict=True)], schema=result)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, schema)
