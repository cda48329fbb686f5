"""Toxicity: a factorization machine over hashed terms.

``score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)`` with ``x_i`` 1 for a term that the text
has. The vectors let two terms weigh together what neither weighs alone, such as an insult beside the
mention of a group. Terms are runs of letters and their beginnings, in hash buckets; buckets that fewer than
``MIN_DOCS`` documents of the sample hold aren't part of the model. No other term is left out: terms that go with the
label by themselves are fitted first, and then all terms with their pairs, held more firmly to 0, explain what these
leave open.

Defined results: null texts and texts without a letter have no terms, so their score is the model's for no
terms. Without labelled rows every score is 0.5. An empty table gives an empty one. Rows that repeat get equal scores. Other columns pass
through, and those named as a result give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_folder, written
from ledgerlens.llm.hashed import FIT_PARTITIONS, ROWS_AT_ONCE, evidence, fit, letter_terms, packed

#: Labelled documents that the model is fitted on, at most.
SAMPLE_LIMIT = 12_000
#: Documents of the sample that a bucket must be in.
MIN_DOCS = 5
#: A bucket tells by itself from here on: what chance exceeds in a chi-squared value of one degree of freedom once in
#: a thousand buckets.
CLEAR = 10.83
FACTORS = 4
STEPS = 25
THRESHOLD = 0.7
#: A term's weight is held to 0 more firmly if the term doesn't go with the label by itself.
PENALTY, FACTOR_PENALTY, UNCLEAR_PENALTY, UNCLEAR_FACTOR_PENALTY = 2e-5, 1e-4, 1e-2, 1e-2


def _sums(params: np.ndarray, width: int, rows: np.ndarray, columns: np.ndarray, n: int):
    w, v = params[1 : 1 + width], params[1 + width :].reshape(FACTORS, width)
    linear = np.bincount(rows, w[columns], n)
    each = v[:, columns]
    sums = np.stack([np.bincount(rows, e, n) for e in each])
    squares = np.bincount(rows, (each**2).sum(0), n)
    return params[0] + linear + 0.5 * ((sums**2).sum(0) - squares), each, sums


def _loss(params: np.ndarray, rows: np.ndarray, columns: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss and its gradient."""
    width = (len(params) - 1) // (1 + FACTORS)
    z, each, sums = _sums(params, width, rows, columns, len(y))
    slope = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
    per_term = slope[rows]
    gradient = np.concatenate(
        [[slope.sum()], np.bincount(columns, per_term, width)]
        + [np.bincount(columns, per_term * (sums[f][rows] - each[f]), width) for f in range(FACTORS)]
    )
    return float((np.logaddexp(0, z) - y * z).sum()), gradient


@dataclass(frozen=True)
class Model:
    known: np.ndarray
    params: np.ndarray


def train(labelled: DataFrame) -> Model:
    """A model from ``text`` and ``y`` (0 or 1), at most ``SAMPLE_LIMIT`` rows that the caller has drawn."""
    terms = labelled.select(F.col("y").cast("double").alias("y"), letter_terms(F.col("text")).alias("terms"))
    sample = written(terms.repartition(FIT_PARTITIONS), shared_folder(labelled.sparkSession), "toxicity-sample")
    known, told = evidence(sample, MIN_DOCS)
    width, clear = len(known), told >= CLEAR

    def fitted(start: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        held = np.where(clear[chosen], PENALTY, UNCLEAR_PENALTY)
        paired = np.where(clear[chosen], FACTOR_PENALTY, UNCLEAR_FACTOR_PENALTY)
        penalty = np.concatenate([[0.0], held, np.tile(paired, FACTORS)])
        return fit(sample, known[chosen], _loss, start, penalty, STEPS)

    # The terms that tell by themselves first; all terms, with their pairs, explain what these leave open.
    start = np.concatenate([np.zeros(1 + width), np.random.default_rng(5).normal(0, 0.01, FACTORS * width)])
    places = np.concatenate([[0], 1 + np.flatnonzero(clear), *(1 + (1 + f) * width + np.flatnonzero(clear) for f in range(FACTORS))])
    start[places] = fitted(start[places], clear)
    return Model(known, fitted(start, np.ones(width, bool)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(terms: pd.Series) -> pd.Series:
        model, z = shared.value, np.zeros(len(terms))
        for at in range(0, len(terms), ROWS_AT_ONCE):
            some = terms.iloc[at : at + ROWS_AT_ONCE]
            rows, columns = packed(some, model.known)
            z[at : at + ROWS_AT_ONCE], _, _ = _sums(model.params, len(model.known), rows, columns, len(some))
        return pd.Series(np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6))

    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*rest, probability(letter_terms(F.col("text"))).alias("score"))
    return scored.select(*rest, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
