"""Byte-level tokens: a fast exact encoder, flat token files, and counts from a scan for separators.

A token file holds nothing but fixed-width little-endian ids; a document ends with the end-of-document
id, and there is no index. ``count_tokens`` reads a file in blocks, searches each block for the id with
one vectorised comparison, and stitches documents across blocks with a prefix scan: a block reports the
separators it holds and the tokens after its last one, and running sums of these over the blocks in front
give each block the ordinal and the open length that it starts with.

Defined results: null and empty texts are documents of no tokens. A file that doesn't end with a
separator has a last document with ``closed`` false. An empty file has no documents, an empty table gives none,
a missing file raises. Files whose size isn't a multiple of the id's width raise, and so do ids that don't fit into
16 bits. Special tokens in a text are plain text here, so that no text forges a separator. Rows that repeat, null ids
and other columns don't matter: every row is a document of its own.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Distinct chunks of text whose tokens a worker remembers.
REMEMBERED = 400_000
#: Bytes of a token file that one search looks at.
BLOCK_BYTES = 8 << 20
END_OF_DOCUMENT = 50256

_AWKWARD = re.compile(r" \s|[^\S ] ")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Remembered(dict):
    """Text to the bytes of its ids, filled on demand and emptied when full."""

    def __init__(self, encode, prefix: str) -> None:
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, text: str) -> bytes:
        ids = np.array(self.encode(self.prefix + text), "<u4").tobytes()
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


class TokenCache:
    """The byte-level BPE of a rank file, a chunk at a time.

    The public pattern never lets a token cross from a non-space character over a single space into
    the next word, so a text may be cut before each such space, and words repeat. ``specials`` are strings that
    are one token wherever a text has them; what lies between them is encoded by itself.
    """

    def __init__(self, ranks_path: str, specials: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoder = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.first, self.later = _Remembered(encoder.encode_ordinary, ""), _Remembered(encoder.encode_ordinary, " ")
        self.specials = specials or {}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if any(special in text for special in self.specials):
            parts = self.apart.split(text)  # texts and specials in turn
            said = [np.array([self.specials[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)]
            return b"".join(said)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or _AWKWARD.search(text):
            chunks = _SINGLE_SPACE.split(text)
        else:
            chunks = text.split(" ")
        return self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))


def special_tokens(json_path: str) -> dict[str, int]:
    """The strings that the tokenizer of a JSON file takes as one token wherever a text has them, and their ids."""
    with open(json_path, encoding="utf-8") as source:
        return {token["content"]: token["id"] for token in json.load(source)["added_tokens"]}


def _sixteen_bits(ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"the id {int(ids.max())} doesn't fit into 16 bits")
    return ids.astype("<u2").tobytes()


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Write ``docs`` as flat files of 16-bit ids in ``folder``; ``(path, ordinal, doc_id)`` of what they hold.

    A task writes a file of its own under a name no other attempt uses; only files named in the returned
    table belong to the data. The table is written beside the files, so nothing is tokenised again.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/tokens/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        cache, ordinal, tail = TokenCache(ranks_path), 0, np.array([end], "<u2").tobytes()
        fs.create_dir(os.path.dirname(name), recursive=True)
        with fs.open_output_stream(name) as out:
            for batch in batches:
                for text in batch["text"]:
                    out.write(_sixteen_bits(np.frombuffer(cache.encode(text or ""), "<u4")) + tail)
                n = len(batch)
                yield pd.DataFrame(
                    {"path": name, "ordinal": np.arange(ordinal, ordinal + n), "doc_id": batch["doc_id"].astype("Int64")}
                )
                ordinal += n

    held = docs.select("doc_id", "text").mapInPandas(store, "path string, ordinal long, doc_id long")
    held.write.parquet(f"{folder}/held")
    return docs.sparkSession.read.parquet(f"{folder}/held")


def count_tokens(
    spark: SparkSession,
    folder: str,
    paths: DataFrame,
    end: int = END_OF_DOCUMENT,
    dtype: str = "<u2",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(path, ordinal, start, n_tokens, closed)`` for each document of the flat files that ``paths`` names."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                size = fs.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{path} has {size} bytes, not a multiple of {width}")
                yield pd.DataFrame({"path": path, "first": np.arange(0, size, step), "size": size})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first, size in batch.itertuples(index=False):
                with fs.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(min(step, size - first), first), dtype)
                ends = np.flatnonzero(ids == end)
                yield pd.DataFrame(
                    {
                        "path": [path],
                        "first": [first // width],
                        "n": [len(ids)],
                        "last": [first + step >= size],
                        "ends": [(ends + first // width).astype("int64")],
                    }
                )

    found = (
        paths.select("path").distinct().mapInPandas(blocks, "path string, first long, size long")
        .repartition("path", "first")
        .mapInPandas(search, "path string, first long, n long, last boolean, ends array<long>")
    )
    # Documents that blocks in front have closed, and where the last of these ended.
    front = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "path",
        "ends",
        F.when(F.col("last"), F.col("first") + F.col("n")).alias("file_end"),
        F.coalesce(F.sum(F.size("ends")).over(front), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.array_max("ends")).over(front) + 1, F.lit(0)).alias("open_from"),
    )
    closing = F.concat(
        F.transform("ends", lambda e: F.struct(e.alias("at"), F.lit(True).alias("closed"))),
        F.when(
            F.col("file_end") > F.coalesce(F.array_max("ends") + 1, "open_from"),
            F.array(F.struct(F.col("file_end").alias("at"), F.lit(False).alias("closed"))),
        ).otherwise(F.array().cast("array<struct<at:bigint,closed:boolean>>")),
    )
    starts = F.concat(F.array("open_from"), F.transform("ends", lambda e: e + 1))
    # Start, end and whether it is closed lie in one struct, so that a document's row carries nothing of its block.
    spans = F.zip_with(starts, closing, lambda start, c: F.struct(start.alias("start"), c["at"].alias("at"), c["closed"].alias("closed")))
    each = scanned.select("path", "before", F.posexplode(spans).alias("k", "s")).where("s.at IS NOT NULL")
    return each.select(
        "path",
        (F.col("before") + F.col("k")).alias("ordinal"),
        "s.start",
        (F.col("s.at") - F.col("s.start")).alias("n_tokens"),
        "s.closed",
    )
