"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of like size. A block's slices are bitmaps over its documents: a term sets a few of
them, and sets others besides for each count that its occurrences reach, so the conjunction of a term's slices shows a
superset of the documents that hold it so often. For a search, the slices of an item's terms are summed with the most
that each may add to a score: an upper bound for every document of the block. The documents with the highest bounds are
scored exactly first; the score at the wanted rank is then a threshold, and every document whose bound reaches it is
scored exactly. Only documents below it are left out, and those can't be among the wanted ones.

Nothing of the index depends on a search. It is made in one pass without a shuffle; blocks are tied to no key, so a hot
source or group of copies is nothing special, and a long document shares a block with a few others.

Defined results: a null text has no term; such documents and those without a common term don't appear. Equal scores go
by ascending id, null ids first. Equal ids are documents of their own and each has a rank; so is each of equal items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_folder

#: Slices that an entry sets, slices of a block for each entry of its largest documents, bytes of a block.
HASHES, SLICES_AN_ENTRY, BLOCK_BYTES = 6, 12, 1 << 19
#: A term has an entry for each of these numbers that its occurrences in a document reach.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Distinct terms that a task counts before it hands the counts on.
TERMS_HELD = 200_000
#: Items that are searched for in one pass, documents by bound that an item's threshold is taken from, a wanted one.
ITEMS_A_PASS, FIRST_A_WANTED = 1024, 2
#: Pairs of document and item that are sent to all tasks; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

#: ASCII letters lower-cased; digits and bytes beyond ASCII stay, all else separates.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
INDEX = "held long, with_terms long, occurrences long, width int, doc_ids array<bigint>, sizes binary, slices binary, term string, df long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def _entry_hashes(hashes: np.ndarray, level: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _rows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The slices of each entry, as (entry, HASHES)."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(width)).astype(np.int64)


class _Block:
    """Documents of one size class until they fill a block."""

    def __init__(self, width: int) -> None:
        self.width, self.room = width, max(8, min(4096, 8 * BLOCK_BYTES // width))
        self.ids, self.sizes, self.hashes, self.counts = [], [], [], []

    def row(self) -> dict:
        bits = np.zeros((self.width, -(-len(self.ids) // 8) * 8), bool)
        slot = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.hashes])
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        for level, least in enumerate(LEVELS):
            reached = counts >= least
            bits[_rows(_entry_hashes(hashes[reached], level), self.width), slot[reached][:, None]] = True
        sizes = np.array(self.sizes, np.int64)
        return {
            "held": len(sizes), "with_terms": int((sizes > 0).sum()), "occurrences": int(sizes.sum()), "width": self.width,
            "doc_ids": self.ids, "sizes": sizes.tobytes(), "slices": np.packbits(bits, axis=1).tobytes(),
        }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in rows], schema=schema)


def index(docs: DataFrame, folder: str) -> DataFrame:
    """The index of ``docs (doc_id, text)``, written to ``folder``: a row a block, and rows ``(term, df)`` to be added up."""
    schema = docs.sparkSession.createDataFrame([], INDEX).toArrow().schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        df: Counter = Counter()

        def dictionary() -> pa.RecordBatch:
            columns = {"term": pa.array(list(df), pa.binary()).cast(pa.string()), "df": pa.array(df.values(), pa.int64())}
            arrays = [columns.get(f.name, pa.nulls(len(df), f.type)).cast(f.type) for f in schema]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(terms_of(text.as_py()))
                df.update(found.keys())
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
                counts = np.fromiter(found.values(), np.int64, len(found))
                entries = int(np.searchsorted(LEVELS, counts, "right").sum())
                width = SLICES_AN_ENTRY << max(5, (max(1, entries) - 1).bit_length())
                block = blocks.setdefault(width, _Block(width))
                block.ids.append(doc)
                block.sizes.append(int(counts.sum()))
                block.hashes.append(hashes)
                block.counts.append(counts)
                if len(block.ids) == block.room:
                    yield _batch([blocks.pop(width).row()], schema)
                if len(df) > TERMS_HELD:
                    yield dictionary()
                    df.clear()
        for block in blocks.values():
            yield _batch([block.row()], schema)
        if df:
            yield dictionary()

    built = docs.select("doc_id", "text").mapInArrow(build, INDEX)
    # rows of up to half a megabyte: small row groups keep what a reader holds small
    writer = built.write.option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 10)
    writer.option("parquet.block.size.row.check.max", 1000).parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(built.schema).parquet(f"{folder}/index")


@dataclass
class Totals:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    occurrences: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def damping(self, sizes):
        """The m of documents of so many terms."""
        return 100 - 50 + (50 * sizes * self.documents) // max(1, self.occurrences)


def saturated(tf, m):
    """What ``tf`` occurrences add for each unit of a term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Items:
    """The items of one pass: their terms, weights, and which items hold each term."""

    def __init__(self, items: list[tuple[int, dict[bytes, int]]]) -> None:
        self.ids = [q for q, _ in items]
        self.terms = [t for _, t in items]
        weights: dict[bytes, int] = {}
        holders: dict[bytes, list[int]] = {}
        for k, (_, terms) in enumerate(items):
            for term, weight in terms.items():
                weights[term] = weight
                holders.setdefault(term, []).append(k)
        self.weights = np.array(list(weights.values()), np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, weights), np.uint64, len(weights))
        self.sizes = np.array([len(holders[t]) for t in weights], np.int64)
        self.holders = np.array([k for t in weights for k in holders[t]], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places: dict[tuple[int, int], np.ndarray] = {}

    def rows(self, width: int, level: int) -> np.ndarray:
        if (width, level) not in self.places:
            self.places[width, level] = _rows(_entry_hashes(self.hashes, level), width)
        return self.places[width, level]

    def bounds(self, width: int, sizes: np.ndarray, slices: np.ndarray, totals: Totals) -> np.ndarray:
        """(item, document): the most that a document of a block may score."""
        n, m = len(sizes), totals.damping(sizes)
        out = np.zeros((len(self.ids), n), np.int64)
        alive, masks, before = np.arange(len(self.weights)), None, np.zeros(n, np.int64)
        for level in range(len(LEVELS)):
            bits = np.bitwise_and.reduce(slices[self.rows(width, level)[alive]], axis=1)
            masks = bits if masks is None else bits & masks
            some = masks.any(axis=1)
            alive, masks = alive[some], masks[some]
            if not len(alive):
                break
            most = np.minimum(LEVELS[level + 1] - 1, sizes) if level + 1 < len(LEVELS) else sizes
            reached = saturated(most, m)
            gain, before = reached - before, reached
            held = np.unpackbits(masks, axis=1, count=n).astype(bool)
            common = held.sum(axis=1) * 4 > n
            for t, row in zip(alive[common], held[common], strict=True):
                out[self.holders[self.starts[t] : self.starts[t] + self.sizes[t]]] += np.where(row, gain * self.weights[t], 0)
            a, slot = np.nonzero(held[~common])
            t = alive[~common][a]
            times = self.sizes[t]
            ends = np.cumsum(times)
            nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
            item = self.holders[np.repeat(self.starts[t], times) + nth]
            np.add.at(out.reshape(-1), item * n + np.repeat(slot, times), np.repeat(gain[slot] * self.weights[t], times))
        return out


PAIRS, BOUNDS = "q long, doc_id long", "q long, doc_id long, bound long"


def _columns(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in schema.split(", ")])


def _each_block(batches: Iterator[pa.RecordBatch], items: Items, totals: Totals):
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int64)
            slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
            yield row["doc_ids"], items.bounds(row["width"], sizes, slices, totals)


def highest_bounds(blocks: DataFrame, items, totals: Totals, k: int) -> DataFrame:
    """``(q, doc_id, bound)``: of each item the ``k`` documents with the highest bounds."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        docs, bounds = np.zeros((len(asked.ids), 0), object), np.zeros((len(asked.ids), 0), np.int64)
        for ids, found in _each_block(batches, asked, totals):
            bounds = np.concatenate([bounds, found], axis=1)
            docs = np.concatenate([docs, np.broadcast_to(np.array(ids, object), found.shape)], axis=1)
            if bounds.shape[1] > k:
                top = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
                docs, bounds = np.take_along_axis(docs, top, 1), np.take_along_axis(bounds, top, 1)
        item, place = np.nonzero(bounds)
        yield _columns(BOUNDS, np.array(asked.ids, np.int64)[item], docs[item, place].tolist(), bounds[item, place])

    found = blocks.mapInArrow(best, BOUNDS)
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "doc_id")
    return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth")


def reaching(blocks: DataFrame, items, totals: Totals, least: dict[int, int]) -> DataFrame:
    """``(q, doc_id)``: every document whose bound reaches its item's threshold."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        limits = np.array([least.get(q, 1) for q in asked.ids], np.int64)[:, None]
        for ids, found in _each_block(batches, asked, totals):
            item, place = np.nonzero(found >= limits)
            yield _columns(PAIRS, np.array(asked.ids, np.int64)[item], np.array(ids, object)[place].tolist())

    return blocks.mapInArrow(all_of, PAIRS)


def scored(docs: DataFrame, pairs: DataFrame, items, totals: Totals, folder: str, name: str) -> DataFrame:
    """``(q, doc_id, score)`` of all documents with an id of ``pairs``, for that id's items: exact, where above 0."""
    pairs.write.parquet(f"{folder}/{name}")
    held = docs.sparkSession.read.schema(PAIRS).parquet(f"{folder}/{name}")
    asked_of = held.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("q").alias("_items"))
    # documents aren't moved while the pairs are few; that they are is checked
    asked_of = F.broadcast(asked_of) if held.count() <= BROADCAST_PAIRS else asked_of.hint("merge")
    met = docs.join(asked_of, docs["doc_id"].eqNullSafe(asked_of["_id"])).select("doc_id", "text", "_items")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        terms = dict(zip(asked.ids, asked.terms, strict=True))
        for batch in batches:
            out = []
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Counter(terms_of(text))
                m = totals.damping(found.total())
                parts = {}
                for q in wanted:
                    total = 0
                    for term, weight in terms[q].items():
                        if term in found:
                            if term not in parts:
                                parts[term] = saturated(found[term], m)
                            total += weight * parts[term]
                    if total > 0:
                        out.append((q, doc, total))
            yield _columns(f"{PAIRS}, score long", *(zip(*out, strict=True) if out else ([], [], [])))

    return met.mapInArrow(score, f"{PAIRS}, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """``(q, item_id, term)``: the distinct terms of each item, which has a number of its own."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids, texts = (c.to_pylist() for c in batch.columns)
            rows = [(q, i, t.decode()) for q, i, text in zip(numbers, ids, texts, strict=True) for t in dict.fromkeys(terms_of(text))]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            types = (pa.int64(), batch.schema.field(1).type, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["q", "item_id", "term"])

    numbered = items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text")
    return numbered.mapInArrow(split, f"q long, item_id {kind}, term string")


def search(docs: DataFrame, items: DataFrame, wanted: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``wanted`` highest-scoring of ``docs (doc_id, text)`` for each of
    ``items (item_id, text)``, exactly. Items go in passes of a bounded number over the index."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    built = index(docs, folder)
    blocks = built.where("slices IS NOT NULL").select("width", "doc_ids", "sizes", "slices")
    sums = built.where("slices IS NOT NULL").agg(F.sum("with_terms"), F.sum("occurrences")).first()
    totals = Totals(sums[0] or 0, sums[1] or 0)
    _item_terms(items).write.parquet(f"{folder}/items")
    terms = spark.read.parquet(f"{folder}/items")
    # a row an item: numbers of passes
    order = Window.orderBy("q")
    numbers = terms.select("q").distinct().withColumn("pass", F.floor((F.row_number().over(order) - 1) / ITEMS_A_PASS))
    dictionary = built.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    known = terms.join(dictionary, "term").join(numbers, "q")
    known.write.parquet(f"{folder}/known")
    known = spark.read.parquet(f"{folder}/known")
    passes = known.agg(F.max("pass")).first()[0]
    for p in range(0 if passes is None else passes + 1):
        by_item: dict[int, dict[bytes, int]] = {}
        for row in known.where(F.col("pass") == p).select("q", "term", "df").toLocalIterator():
            by_item.setdefault(row["q"], {})[row["term"].encode()] = totals.weight(row["df"])
        asked = spark.sparkContext.broadcast(Items(sorted(by_item.items())))
        first = highest_bounds(blocks, asked, totals, FIRST_A_WANTED * wanted).select("q", "doc_id")
        nth = Window.partitionBy("q").orderBy(F.desc("score"))
        tried = scored(docs, first, asked, totals, folder, f"first-{p}").withColumn("nth", F.row_number().over(nth))
        least = {r["q"]: r["score"] for r in tried.where(F.col("nth") == wanted).collect()}  # a number an item of the pass
        found = scored(docs, reaching(blocks, asked, totals, least), asked, totals, folder, f"reaching-{p}")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).write.parquet(f"{folder}/ranked/pass={p}")
    kind = items.schema["item_id"].dataType.simpleString()
    if passes is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    ranked = spark.read.parquet(f"{folder}/ranked").drop("pass")
    return ranked.join(terms.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")
