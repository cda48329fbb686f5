"""Media columns: payloads as content-addressed PNG members of tar shards, described by rows.

A payload (any bytes, padded with spaces to whole rows of 192 samples) is stored losslessly as an
8-bit grey PNG, 192 samples wide. Each task packs its payloads into one tar shard, a payload once under
its own SHA-256, and rows carry digest, shard, offset and length. Metadata columns come from range reads
of the members' headers alone; payload columns from range reads of whole members.

A shard's name holds the task's attempt, so an attempt that is lost leaves a file that no row names.
The index is a table in the shared folder, written once. A payload that many rows share is stored once
a shard, hence at most as often as there are shards, and no row moves for it.

Defined results: null is the empty payload, which is padded to one row of spaces. Equal payloads give
equal columns. An empty table gives an empty index. Rows with a null id are carried. Other columns of
the documents are not.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

WIDTH = 192
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes with spaces up to a positive multiple of the width."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def to_png(payload: bytes) -> bytes:
    """Whole rows of 8-bit samples as a grey PNG without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first ``HEADER_BYTES`` bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    width, height, _ = png_header(data)
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the texts of ``docs`` (``doc_id, text``) as shards in ``folder`` and return the index."""

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/shards/part-{task.partitionId():06d}-{task.taskAttemptId()}.tar"
        fs.create_dir(os.path.dirname(name), recursive=True)
        places: dict[bytes, tuple[int, int]] = {}
        with fs.open_output_stream(name) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    payload = padded(text)
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in places:
                        png = to_png(payload)
                        info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                        info.size = len(png)
                        places[digest.digest()] = (tar.offset + tarfile.BLOCKSIZE, len(png))
                        tar.addfile(info, io.BytesIO(png))
                    n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
                    rows.append((doc_id, n_bytes, digest.hexdigest(), name, *places[digest.digest()]))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length"]).astype(
                    {"doc_id": "Int64"}
                )

    docs.select("doc_id", "text").mapInPandas(shard, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def _each_member(index: DataFrame, folder: str, schema: str, read) -> DataFrame:
    """The index with columns that ``read(file, offset, length)`` gives; a member is read once a task."""
    kept = [c for c in index.columns]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, rows in batch.groupby("shard", sort=False):
                with fs.open_input_file(path) as source:
                    found: dict[int, tuple] = {}
                    for offset, length in zip(rows["offset"], rows["length"], strict=True):
                        if offset not in found:
                            found[offset] = read(source, offset, length)
                columns = list(zip(*(found[o] for o in rows["offset"]), strict=True))
                yield rows[kept].assign(**dict(zip(names, columns, strict=True)))

    names = [part.split()[0] for part in schema.split(", ")]
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInPandas(members, f"{given}, {schema}")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with ``width, height, bits`` from the members' headers; samples are not read."""

    def read(source, offset: int, length: int) -> tuple:
        return png_header(source.read_at(min(HEADER_BYTES, length), offset))

    return _each_member(index, folder, "width long, height long, bits long", read)


def with_payload(index: DataFrame, folder: str) -> DataFrame:
    """The index with the digests, checksums and features of the payloads as they are read back."""

    def read(source, offset: int, length: int) -> tuple:
        width, height, bits = png_header(source.read_at(min(HEADER_BYTES, length), offset))
        data = source.read_at(length, offset)
        payload = from_png(data)
        samples = np.frombuffer(payload, np.uint8)
        quarters = np.bincount(samples >> 6, minlength=4)
        rises = int(np.count_nonzero(samples[1:] > samples[:-1]))
        feature = (
            f"png {width}x{height}x{bits} sum={int(samples.sum(dtype=np.int64))} rises={rises} "
            f"quarters={'/'.join(map(str, quarters))}"
        )
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
            len(data), hashlib.sha256(data).hexdigest(), feature,
        )

    return _each_member(
        index, folder,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        read,
    )
