"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's latent quality is the sum of its hashed terms' weights over the square root of their number, the same weights
for every grade, and ordered thresholds cut the latent scale: ``P(grade <= k) = sigmoid(t_k - s)``. From these come the expected
grade and the tail probability of a grade or better, by which documents are selected.

The thresholds are ``t_0`` and then sums of exponentials, so they keep their order through the fit.

Defined results: null and empty texts have only the terms for an empty text. Without labelled rows, or with a
single grade, every probability is the one for no terms under thresholds of 0, 1, .... An empty table gives an empty one. Rows that repeat get equal results. Other
columns pass through, and those named as a result give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_folder, written
from ledgerlens.llm.hashed import FIT_PARTITIONS, fit, frequent_terms, packed, word_terms

#: Rated documents that the model is fitted on, at most.
SAMPLE_LIMIT = 12_000
MIN_DOCS = 5
STEPS = 30
PENALTY = 1e-6
#: Selected documents have the wanted grade, or a better one, at least this likely.
MIN_TAIL = 0.5


def _latent(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    return np.bincount(rows, weights[columns], n) / size, size


def _thresholds(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(grades: int):
    def loss(params: np.ndarray, rows: np.ndarray, columns: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        free, weights = params[: grades - 1], params[grades - 1 :]
        s, size = _latent(weights, rows, columns, len(y))
        cuts, k, n = _thresholds(free), y.astype(int), np.arange(len(y))
        below = np.concatenate([np.zeros((len(y), 1)), _sigmoid(cuts[None, :] - s[:, None]), np.ones((len(y), 1))], 1)
        dense = below * (1 - below)  # slopes, 0 at both ends
        p = np.maximum(below[n, k + 1] - below[n, k], 1e-12)
        upper, lower = dense[n, k + 1] / p, dense[n, k] / p
        by_cut = np.bincount(k, -upper, grades)[: grades - 1] + np.bincount(k, lower, grades)[1:]
        # t_j moves with t_0 and with every exponential up to j
        tail = np.cumsum(by_cut[::-1])[::-1]
        by_free = np.concatenate([[tail[0]], tail[1:] * np.exp(free[1:])])
        by_latent = (upper - lower) / size
        return float(-np.log(p).sum()), np.concatenate([by_free, np.bincount(columns, by_latent[rows], len(weights))])

    return loss


@dataclass(frozen=True)
class Model:
    known: np.ndarray
    cuts: np.ndarray
    weights: np.ndarray


def train(rated: DataFrame, grades: int) -> Model:
    """A model from ``text`` and ``grade`` (0 to ``grades - 1``), at most ``SAMPLE_LIMIT`` rows drawn by the caller."""
    terms = rated.select(F.col("grade").cast("double").alias("y"), word_terms(F.col("text")).alias("terms"))
    sample = written(terms.repartition(FIT_PARTITIONS), shared_folder(rated.sparkSession), "quality-sample")
    known = frequent_terms(sample, MIN_DOCS)
    start = np.zeros(grades - 1 + len(known))
    penalty = np.concatenate([np.zeros(grades - 1), np.full(len(known), PENALTY)])
    params = fit(sample, known, _loss(grades), start, penalty, STEPS)
    return Model(known, _thresholds(params[: grades - 1]), params[grades - 1 :])


def grade(docs: DataFrame, model: Model, wanted: int, min_tail: float = MIN_TAIL) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` of ``wanted`` or better, and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rate(terms: pd.Series) -> pd.DataFrame:
        model = shared.value
        rows, columns = packed(terms, model.known)
        s, _ = _latent(model.weights, rows, columns, len(terms))
        at_least = 1 - _sigmoid(model.cuts[None, :] - s[:, None])  # column k: grade k + 1 or better
        return pd.DataFrame(
            {"expected_grade": np.round(at_least.sum(1), 6), "tail_probability": np.round(at_least[:, wanted - 1], 6)}
        )

    rest = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    rated = docs.select(*rest, rate(word_terms(F.col("text"))).alias("_r"))
    return rated.select(
        *rest, "_r.expected_grade", "_r.tail_probability", (F.col("_r.tail_probability") >= min_tail).alias("kept")
    )
