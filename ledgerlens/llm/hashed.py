"""Hashed terms of texts, and models over them that are fitted by gradients from all partitions.

A fit reads a bounded sample of labelled documents. Its terms are kept as a table in the shared folder;
each evaluation of the objective is one job, in which every partition has the loss and the gradient of its rows,
in blocks that are added up by a shuffle, and the driver takes a quasi-Newton step. What comes back is one vector of
the model's length, however many partitions there are, and its parameters are sent anew and dropped for each evaluation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD_GAP, fetched

#: Buckets of hashed terms.
TERM_BUCKETS = 1 << 18
#: Partitions of a sample; fixed, so that a fit doesn't depend on the cluster.
FIT_PARTITIONS = 6
#: Numbers of a gradient in one row.
BLOCK = 1 << 15
#: Rows whose terms are laid out side by side at a time.
ROWS_AT_ONCE = 1_000


def letter_terms(text: Column, buckets: int = TERM_BUCKETS) -> Column:
    """Distinct hashes of the runs of letters in a text, lower-cased, and of their first four and six letters."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")
    mask = F.lit(buckets - 1).cast("long")
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.array_distinct(runs),
                lambda w: F.array(
                    F.xxhash64(w).bitwiseAND(mask),
                    F.xxhash64(F.lit(4), F.substring(w, 1, 4)).bitwiseAND(mask),
                    F.xxhash64(F.lit(6), F.substring(w, 1, 6)).bitwiseAND(mask),
                ),
            )
        )
    )


def word_terms(text: Column, buckets: int = TERM_BUCKETS) -> Column:
    """Distinct hashes of a text's words, lower-cased, of the runs of letters and digits in them, and of their shapes:
    letters and digits as one sign each run. By the runs a word is the same term whatever punctuation stands beside it.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_remove(F.split(lowered, WORD_GAP), "")
    mask = F.lit(buckets - 1).cast("long")
    distinct = F.array_distinct(words)
    named = F.array_union(distinct, F.array_remove(F.split(lowered, r"[^\p{L}\p{N}]+"), ""))
    shapes = F.array_distinct(F.transform(distinct, lambda w: F.regexp_replace(w, r"[\p{L}\p{N}]+", "a")))
    # how often words repeat: tenths of the share of distinct words, and the text's length by powers of two
    tenths = F.floor(10 * F.size(distinct) / F.greatest(F.size(words), F.lit(1))).cast("string")
    length = F.floor(F.log2(F.greatest(F.size(words), F.lit(1)))).cast("string")
    extra = F.array(F.concat(F.lit("share "), tenths), F.concat(F.lit("length "), length))
    hashed = F.concat(
        F.transform(named, lambda w: F.xxhash64(w).bitwiseAND(mask)),
        F.transform(shapes, lambda w: F.xxhash64(F.lit("shape"), w).bitwiseAND(mask)),
        F.transform(extra, lambda w: F.xxhash64(F.lit("extra"), w).bitwiseAND(mask)),
    )
    return F.array_distinct(hashed)


def frequent_terms(sample: DataFrame, least: int) -> np.ndarray:
    """The buckets that at least ``least`` documents of a bounded sample hold, sorted."""
    counts = sample.select(F.explode("terms").alias("t")).groupBy("t").count().where(F.col("count") >= least)
    return np.sort(fetched(counts.select("t"))["t"].to_numpy(np.int64))


def evidence(sample: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that at least ``least`` documents hold, sorted, and how clearly each goes with ``y`` (0 or 1) by itself.

    The latter is the likelihood-ratio statistic of a bucket's documents against the sample's rate.
    """
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).first()
    rate = (total["y"] + 0.5) / (total["n"] + 1)
    counts = sample.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    found = fetched(counts.where(F.col("n") >= least)).sort_values("t")
    n, y = found["n"].to_numpy(float), found["y"].to_numpy(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(y > 0, y * np.log(y / n / rate), 0) + np.where(n > y, (n - y) * np.log((n - y) / n / (1 - rate)), 0)
    return found["t"].to_numpy(np.int64), 2 * parts


def packed(terms: pd.Series, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each known term, the columns numbered by ``known``."""
    if not len(terms) or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = terms.map(len).to_numpy(np.int64)
    flat = np.concatenate([np.asarray(t, np.int64) for t in terms]) if sizes.sum() else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(terms)), sizes)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    held = known[at] == flat
    return rows[held], at[held]


Objective = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def fit(
    sample: DataFrame, known: np.ndarray, objective: Objective, start: np.ndarray, penalty: np.ndarray, steps: int
) -> np.ndarray:
    """The parameters that L-BFGS reaches from ``start``.

    ``sample`` has ``y`` and ``terms``. ``objective(params, rows, columns, y)`` is the loss and gradient of
    some rows; ``penalty`` is the weight of each parameter's square. All is divided by the number of rows.
    """
    context = sample.sparkSession.sparkContext
    rows, names = sample.count(), context.broadcast(known)

    def evaluate(params: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(params)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            values = shared.value
            sums = np.zeros(1 + len(values))  # the loss, then the gradient
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    held = batch.iloc[at : at + ROWS_AT_ONCE]
                    r, c = packed(held["terms"], names.value)
                    some, slope = objective(values, r, c, held["y"].to_numpy(float))
                    sums[0] += some
                    sums[1:] += slope
            for at in range(0, len(sums), BLOCK):
                yield pd.DataFrame({"at": [at], "sums": [sums[at : at + BLOCK].tobytes()]})

        def added(held: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in held.sort_values("part")["sums"])
            return pd.DataFrame({"at": held["at"].iloc[:1], "sums": [total.tobytes()]})

        parts = sample.select("y", "terms").mapInPandas(partial, "at long, sums binary").withColumn("part", F.spark_partition_id())
        found = fetched(parts.groupBy("at").applyInPandas(added, "at long, sums binary")).sort_values("at")
        shared.destroy()
        total = np.concatenate([np.frombuffer(x) for x in found["sums"]]) / rows
        return total[0] + float((penalty * params**2).sum()), total[1:] + 2 * penalty * params

    try:
        return _minimised(evaluate, start, steps) if rows else start
    finally:
        names.destroy()


def _minimised(evaluate, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    value, slope = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = slope.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * s @ q)
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - rho * y @ q)
        if slope @ q <= 0:
            q, past = slope.copy(), []
        size = 1.0
        for _ in range(12):
            after, new_slope = evaluate(x - size * q)
            if after <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            break
        s, y = -size * q, new_slope - slope
        done = value - after < 1e-6 * abs(value)
        x, value, slope = x + s, after, new_slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        if done:
            break
    return x
