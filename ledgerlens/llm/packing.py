"""Best-fit packing: documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document longer than a sequence is cut into full sequences, with the shorter rest in front; the
full pieces need no choice. Every other piece goes where the sum over gaps of the squared number of
open sequences with that gap becomes smallest: moving a sequence from gap g to g - s changes that sum
by ``2 (N[g - s] - N[g] + 1)``, opening one by ``2 N[size - s] + 1``, and closed sequences don't count.
Among equal changes the smallest gap wins.

The rule works on pieces as they come, so they come in the order of a hash. What it leaves open at the
end is emptied, and those few pieces are placed again from the longest on, each where it fits best.

Pieces are dealt into lots by a hash of document id and piece, and each lot is packed on its own, so only
ids and lengths move and a lot's open sequences are all the state there is. A lot has about ``LOT_PIECES``
pieces, whatever the size of the input; a lot leaves one or two sequences partly filled.

Defined results: null texts are empty; an empty text is one end token. Equal rows are separate
documents. Rows with a null id are packed too. An empty table gives no rows. Other columns of the
documents are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_folder, written
from ledgerlens.llm.tokens import TokenCache

SEQUENCE = 2048
END = 0
LOT_PIECES = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(
    docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, end: int = END, specials: dict[str, int] | None = None
) -> DataFrame:
    """The pieces of every document, with the checksum of their token ids."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = TokenCache(ranks_path, specials)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = cache.encode(text or "") + tail
                total = len(data) // 4
                first = total % sequence or min(total, sequence)
                start, length, piece = 0, first, 0
                while start < total:
                    crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                    out.append((doc_id, piece, start, length, crc))
                    start, length, piece = start + length, sequence, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"doc_id": "Int64"}
            )

    return docs.select("doc_id", "text").mapInPandas(pieces, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the place in it of each piece, for lengths from 1 to ``size``, in their order."""
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by gap: (sequence, filled)
    counts = np.zeros(size + 1, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for k, s in enumerate(lengths.tolist()):
        if s < size:
            # half the change of the sum for gaps s..size-1; an exact fit's new gap 0 isn't counted
            change = np.where(counts[s:size] > 0, counts[: size - s] - counts[s:size] + 1.0, np.inf)
            change[0] -= 0.5
            best, fresh = int(np.argmin(change)), counts[size - s] + 0.5
        if s < size and change[best] <= fresh:
            gap = best + s
            which, filled = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, which, filled, used = size, used, 0, used + 1
        sequence[k], offset[k] = which, filled
        if gap > s:
            open_at[gap - s].append((which, filled + s))
            counts[gap - s] += 1
    return sequence, offset


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each piece: the open sequence with the smallest gap that holds it."""
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    counts = np.zeros(size + 1, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for k, s in enumerate(lengths.tolist()):
        fits = counts[s:] > 0
        gap = s + int(np.argmax(fits)) if fits.any() else size
        if fits.any():
            which, filled = open_at[gap].pop()
            counts[gap] -= 1
        else:
            which, filled, used = used, 0, used + 1
        sequence[k], offset[k] = which, filled
        if gap > s:
            open_at[gap - s].append((which, filled + s))
            counts[gap - s] += 1
    return sequence, offset


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, place and whether the clean-up placed it, for each piece: sum of squares over all pieces in their
    order, then best fit over the pieces of sequences left open.
    """
    sequence, offset = sum_of_squares(lengths, size)
    filled = np.bincount(sequence, lengths, minlength=1).astype(np.int64)
    former = sequence.copy()
    again = np.flatnonzero(filled[former] < size)
    longest_first = again[np.argsort(-lengths[again], kind="stable")]
    number, place = best_fit(lengths[longest_first], size)
    sequence[longest_first], offset[longest_first] = len(filled) + number, place
    return sequence, offset, filled[former] < size


def pack(
    docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, end: int = END, specials: dict[str, int] | None = None
) -> DataFrame:
    """A row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, cleaned_up``.

    ``cleaned_up`` is true for pieces that the rule had left in an open sequence, which were placed again at the end.
    """
    pieces = written(cut(docs, ranks_path, sequence, end, specials), shared_folder(docs.sparkSession), "pieces")
    lots = max(1, round(pieces.count() / LOT_PIECES))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def placed(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["key", *columns], kind="stable")
        number, place, again = pack_lengths(lot["length"].to_numpy(), sequence)
        return lot[columns].assign(sequence_id=number + (int(lot["lot"].iloc[0]) << 40), offset=place, cleaned_up=again)

    key = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    return (
        pieces.withColumn("key", key)
        .withColumn("lot", F.pmod("key", F.lit(lots)))
        .groupBy("lot")
        .applyInPandas(placed, f"{PIECES}, sequence_id long, offset long, cleaned_up boolean")
    )
