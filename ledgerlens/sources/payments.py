"""Payment requests as a streaming source of its own: ``spark.readStream.format("payment_requests")``.

A row follows from its number and the seed alone, and a micro-batch is a span of numbers. So a batch that is run
again, on whatever executors, gives the rows that it gave before, and Spark's checkpoint says where to go on.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerlens.schemas import PAYMENT_REQUEST

NAME = "payment_requests"
SCHEMA = f"ts timestamp, {PAYMENT_REQUEST}"
#: Rows of an Arrow batch.
ROWS_AT_ONCE = 10_000


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit numbers of whole numbers: add, multiply, shift."""
    z = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def request_rows(first: int, last: int, seed: int, began_us: int, rate: float) -> pa.RecordBatch:
    """The requests from number ``first`` to before ``last``: customers to 99 999, amounts under 100 000, five thousand merchants."""
    n = np.arange(first, last, dtype=np.uint64)
    base = seed * 4
    customer = _mixed(n, base) % np.uint64(100_000)
    amount = (_mixed(n, base + 1) >> np.uint64(11)) / float(1 << 53) * 100_000
    merchant = _mixed(n, base + 2) % np.uint64(5000)
    ts = began_us + (n.astype(np.float64) * (1e6 / rate)).astype(np.int64)
    names = ["ts", "txn_id", "customer_id", "amount", "merchant_id"]
    columns = [
        pa.array(ts, pa.timestamp("us", "UTC")), pa.array(n.astype(np.int64)), pa.array(customer.astype(np.int64)), pa.array(amount),
        pa.array([f"M-{m}" for m in merchant], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


@dataclass
class _Span(InputPartition):
    first: int
    last: int


class _Reader(DataSourceStreamReader):
    """Offsets are numbers of rows. What has come due by the clock is there, at most so many rows a batch.

    A new process doesn't know where the checkpoint stands until Spark asks for a batch, so its first batch has no such
    limit; it is cut into spans of the same size, each a task.
    """

    def __init__(self, options: dict) -> None:
        self.rate = float(options.get("rowspersecond", "10"))
        self.most = int(options.get("maxrowsperbatch", "100000"))
        self.span = int(options.get("rowsperpartition", "20000"))
        self.seed = int(options.get("seed", "0"))
        self.total = int(options["rows"]) if "rows" in options else None
        self.began_us = int(datetime.fromisoformat(options["since"]).replace(tzinfo=UTC).timestamp() * 1e6)
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        due = max(0, int((time.time() - self.began_us / 1e6) * self.rate))
        if self.total is not None:
            due = min(due, self.total)
        if self.at is not None:
            due = max(self.at, min(due, self.at + self.most))
        self.at = due
        return {"row": due}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(k, min(k + self.span, end["row"])) for k in range(start["row"], end["row"], self.span)]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        for k in range(partition.first, partition.last, ROWS_AT_ONCE):
            yield request_rows(k, min(k + ROWS_AT_ONCE, partition.last), self.seed, self.began_us, self.rate)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class PaymentRequests(DataSource):
    """Options: ``since`` (ISO time of row 0, UTC), ``rowsPerSecond``, ``maxRowsPerBatch``, ``rowsPerPartition``, ``seed``,
    and ``rows`` for a stream that ends."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(PaymentRequests)
