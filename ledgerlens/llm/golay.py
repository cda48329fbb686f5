"""Near-duplicates by SimHash fingerprints, found by fuzzy hashing with the binary Golay code.

The code is perfect: each 23-bit word is within 3 bits of exactly one of its 4096 codewords. A fingerprint is cut into
three segments, each of which is decoded to its own codeword and to those that one flipped bit leads to. Words that
differ in one bit thus share the codeword of either, and words that differ in two share that of the word between.

Of 4 differing bits at most, spread over three segments, either some segment has none and another at most two, or two
segments have one each. So fingerprints that link meet under one of these keys, and what meets is compared exactly:

* a segment as it is, and a nearby codeword of another segment;
* nearby codewords of two segments, one of the fingerprints being there by its own codewords.

Equal fingerprints are one class from the start. A bucket of very many classes isn't compared by pairs: its members go
to all points within two bits, where linked ones meet again, and a point holds at most 2081 of them.

Defined results: a text without words, or null, has fingerprint zero and links like any other. Null ids are never the
smallest of a component unless it has no other; then ``component_id`` is null. Equal ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_folder, written
from ledgerlens.llm.jaccard import connected

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: First bit and length of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the [23, 12, 7] code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Members of a bucket that are compared in one task; in buckets up to the second size all pairs are written out.
BUCKET, SMALL_BUCKET = 8192, 32
#: Fingerprints whose keys one task makes, each some 120.
KEYS_A_TASK = 100_000
#: Pairs that one step compares at once.
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text: a bit is set if it is in over half of the shingles' hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes).tolist(), ends[SHINGLE_WORDS - 1 :].tolist()) if len(words) >= SHINGLE_WORDS else ((0, len(joined)),)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``; ``fp`` is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@cache
def codewords() -> np.ndarray:
    """The index of the codeword that each 23-bit word is decoded to."""
    words = np.zeros(4096, np.int64)
    for bit in range(12):
        words ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0)
    table = np.full(1 << 23, -1, np.int16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table[words ^ sum(1 << b for b in bits)] = np.arange(4096)
    return table


def nearby(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of every key of each segment: its own codeword's index, then those that one flipped bit leads to."""
    table = codewords()
    own = table[segment].astype(np.int64)
    flipped = table[segment[:, None] ^ (1 << np.arange(bits))].astype(np.int64)
    found = np.sort(np.where(flipped == own[:, None], -1, flipped), axis=1)
    fresh = (found >= 0) & np.diff(found, axis=1, prepend=-1).astype(bool)
    word, place = np.nonzero(fresh)
    return np.concatenate([np.arange(len(own)), word]), np.concatenate([own, found[word, place]])


def _products(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int):
    """(word, left key, right key, own) of all combinations; ``own`` says that both are the words' own codewords."""
    order = np.argsort(right[0], kind="stable")
    sizes = np.bincount(right[0], minlength=n)
    starts = np.cumsum(sizes) - sizes
    times = sizes[left[0]]
    ends = np.cumsum(times)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
    a = np.repeat(np.arange(len(left[0])), times)
    b = order[np.repeat(starts[left[0]], times) + nth]
    return left[0][a], left[1][a], right[1][b], (a < n) & (b < n)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, own, which fingerprint) of all keys of some fingerprints."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [nearby(part, bits) for part, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    keys, own, which = [], [], []
    for family, (i, j) in enumerate(combinations(range(3), 2)):
        word, x, y, both = _products(near[i], near[j], len(fps))
        keys.append(family << 40 | x << 12 | y)
        own.append(both)
        which.append(word)
    for family, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        word, y = near[j]
        keys.append(3 + family << 40 | parts[i][word] << 12 | y)
        own.append(np.ones(len(word), bool))
        which.append(word)
    return np.concatenate(keys), np.concatenate(own), np.concatenate(which)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of some fingerprints that links connect, one fewer than each component has members."""
    left, a, b = np.unique(fps), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        for x in queue:
            if not len(left):
                break
            met = _close(x, left)
            found = left[met]
            left = left[~met]
            queue.extend(found)
            a.append(np.full(len(found), x, fps.dtype))
            b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _small_links(sizes: np.ndarray, own: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in many small groups that lie one after another, each between a fingerprint by its own codewords and another."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    held = np.flatnonzero(own)
    cuts = np.cumsum(size[held])
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        some = held[at:to]
        times = size[some]
        ends = np.cumsum(times)
        nth = np.arange(ends[-1]) - np.repeat(ends - times, times)
        a, b = fps[np.repeat(some, times)], fps[np.repeat(starts[some], times) + nth]
        met = _close(a, b) & (a != b)
        yield a[met], b[met]
        at = to


LINKS = "a long, b long"


def bucket_links(keys: DataFrame) -> DataFrame:
    """``(a, b)`` links from ``(key, own, fp)``; of buckets that are too large, ``(a, null)`` for each member.

    Rows come sorted by key and go through in batches; what is held is a batch and at most one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(a, b=None) -> pa.RecordBatch:
            a = pa.array(np.asarray(a).view(np.int64))
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.asarray(b).view(np.int64))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        def closed(key: np.ndarray, own: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The links of whole buckets."""
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            sizes = np.diff(np.append(first, len(key)))
            useful = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), first) > 0)
            small = np.repeat(useful & (sizes <= SMALL_BUCKET), sizes)
            for a, b in _small_links(sizes[useful & (sizes <= SMALL_BUCKET)], own[small], fps[small]):
                links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield row(links[0].copy(), links[1].copy())
            for k in np.flatnonzero(useful & (sizes > SMALL_BUCKET)):
                members = fps[first[k] : first[k] + sizes[k]]
                yield row(members) if sizes[k] > BUCKET else row(*forest(members))

        empty = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
        held, too_large = empty, None
        for batch in batches:
            key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            fps = batch.column(2).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if too_large is not None:
                more = key == too_large
                if more.any():
                    yield row(fps[more])
                key, own, fps = key[~more], own[~more], fps[~more]
                if not len(key):
                    continue
                too_large = None
            key, own, fps = (np.concatenate(x) for x in zip(held, (key, own, fps), strict=True))
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from closed(key[:last], own[:last], fps[:last])
            held = key[last:], own[last:], fps[last:]
            if len(held[0]) > BUCKET:
                yield row(held[2])
                held, too_large = empty, int(key[-1])
        if len(held[0]):
            yield from closed(*held)

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, LINKS)


def linked_by_points(members: DataFrame) -> DataFrame:
    """``(a, b)`` links among ``members (fp)``, enough to connect what links connect, by the points within two bits of each."""
    masks = np.array([0, *(1 << a for a in range(64)), *(1 << a | 1 << b for a, b in combinations(range(64), 2))], np.uint64)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                fps = batch.column(0)[k : k + 256].to_numpy().view(np.uint64)
                near = (fps[:, None] ^ masks).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fps, len(masks)).view(np.int64))], ["point", "fp"])

    met = members.mapInArrow(points, "point long, fp long").groupBy("point").agg(F.collect_list("fp").alias("l")).where("size(l) > 1")
    return met.select(F.array_min("l").alias("a"), F.explode("l").alias("b")).where("a != b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of ``docs (doc_id, text)``."""
    folder = shared_folder(docs.sparkSession)
    marked = written(fingerprints(docs), folder, "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "classes")

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                fps = batch.column(0)[k : k + 2048].to_numpy().view(np.uint64)
                key, own, which = keys_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(fps[which].view(np.int64))], ["key", "own", "fp"])

    spread = classes.select("fp").repartition(-(-classes.count() // KEYS_A_TASK) or 1)
    found = written(bucket_links(spread.mapInArrow(all_keys, "key long, own boolean, fp long")), folder, "links")
    links, crowded = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if not crowded.isEmpty():
        links = links.unionByName(written(linked_by_points(crowded), folder, "point-links"))
    roots = connected(links, folder, "linked")
    smallest = roots.join(classes, roots["id"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("smallest"))
    smallest = roots.join(smallest, "root").select(F.col("id").alias("fp"), "smallest")
    of_class = classes.join(smallest, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    of_class = written(of_class, folder, "components")
    return marked.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
