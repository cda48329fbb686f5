"""SentencePiece encoding and decoding as a relational lattice.

A text with spaces written as U+2581 falls apart into units that no piece of the vocabulary crosses: a run of
such signs with the letters after it, a run of punctuation, a sign that no longer piece has. Which characters go
together is read from the vocabulary. For every distinct unit the substrings of two characters and more, up to the
longest piece, are exploded and equi-joined to the piece table; the matches, grouped by unit, are the edges of its
lattice, and Viterbi runs over them in the order of their ends as one ``aggregate`` in the projection.

What a path weighs depends on the model:

* unigram: the sum of its pieces' negated scores, the least wins;
* BPE: the merges that build its pieces, as a sorted list of (rank, place). Of two paths the one whose list comes
  first wins, where a list that goes on beats one that ends. The encoding merges the least (rank, place) that can be
  merged until nothing can; as no piece is built from parts that rank after it, that greedy choice is the first of
  all sorted lists, so Viterbi gives the model's own ids. Pieces that their own merges never build aren't edges.

Single characters are edges without a merge. Those without a piece become the pieces of their bytes, or the unknown
piece where there are none. BPE units of more than ``LONG`` characters (a line of one sign, a sequence of letters
without a break) have long lists; they are merged one by one in an Arrow function, with the same ids.

Units follow a long tail. The most frequent ones, as a bounded sample of documents has them, are encoded first and
sent to every task, which puts their ids in place; all other occurrences, far fewer, are encoded once a distinct unit
and joined by a shuffle. The sample decides which way a unit goes and never what its ids are.

The encoding of a document is a table of blocks: ``place`` is the number of a block's first unit, and the ids of a
document's blocks in the order of ``place`` are the document's ids, so a very long text isn't one row. Decoding works
on these ids.

Defined results: a null or empty text is one block without ids, its text is empty. U+2581 in a text counts as a
space, as it does for the model, and comes back as one. Rows that share an id are told apart by ``text_key``, a hash
of the text; rows that are equal give equal blocks, each its own. An empty table gives no blocks. Other columns
aren't carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, shared_folder, written

SPACE = "▁"
#: Documents that the frequent units are taken from, about.
SAMPLE_DOCS = 20_000
#: Units that are sent to every task, at most.
FREQUENT = 300_000
#: Distinct units that one task encodes, about.
UNITS_A_TASK = 30_000
#: Longer units aren't frequent ones.
FREQUENT_CHARS = 64
#: BPE units of more characters are merged in an Arrow function.
LONG = 96
#: Bits of a place in a unit and of a piece's id in an edge that is one number.
PLACE_BITS, ID_BITS = 20, 22
#: The id of a character's own edge.
ALONE = (1 << ID_BITS) - 1
UNIGRAM, BPE = 1, 2
#: Bytes of text that are cut at a time, about.
TEXT_AT_ONCE = 4 << 20
#: What a character is: a unit of its own, a space, part of a run of letters or of other signs.
SINGLE, SPACES, LETTERS, SIGNS = range(4)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as rows ``(piece, id, score)`` and the ids of bytes."""

    kind: int
    pieces: list[tuple[str, int, float]]
    byte_ids: dict[int, int]
    unknown: int
    dummy_prefix: bool = True

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def ranks(self) -> dict[str, int]:
        """The order of merges: pieces of equal scores share a rank."""
        order = {score: rank for rank, score in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return {piece: order[score] for piece, _, score in self.pieces}

    def check(self) -> None:
        crossing = [p for p, _, _ in self.pieces if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces that go on after a space aren't supported: {crossing[:3]}")
        if max(i for _, i, _ in self.pieces) >= ALONE:
            raise ValueError("ids are too large for an edge")

    def merges(self, piece: str) -> list[tuple[int, int]] | None:
        """(rank, place) of the merges that build a piece, in order; None if they end in something else."""
        cuts, found = [*range(len(piece) + 1)], []
        while len(cuts) > 2:
            options = ((self.ranks.get(piece[a:b]), a, k) for k, (a, b) in enumerate(zip(cuts, cuts[2:], strict=False)))
            least = min((o for o in options if o[0] is not None), default=None)
            if least is None:
                return None
            found.append(least[:2])
            del cuts[least[2] + 1]
        if any(rank > found[-1][0] for rank, _ in found):
            raise ValueError(f"a part of {piece!r} ranks after it")
        return found


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as source:
        proto.ParseFromString(source.read())
    kinds = model.ModelProto.SentencePiece
    pieces = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
    byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only the identity normalizer is supported")
    return Vocabulary(
        proto.trainer_spec.model_type, pieces, byte_ids, proto.trainer_spec.unk_id, proto.normalizer_spec.add_dummy_prefix
    )


def kinds_of_signs(vocabulary: Vocabulary) -> np.ndarray:
    """What each code point is to ``Cutter``.

    Characters are linked where a piece has them side by side, and a piece never crosses from one linked group
    into another but for the spaces that it starts with. Groups with a letter make up one class, the others a
    second one, and any other character stands alone.
    """
    group: dict[str, str] = {}

    def root(sign: str) -> str:
        while group.setdefault(sign, sign) != sign:
            sign = group[sign]
        return sign

    for piece, _, _ in vocabulary.pieces:
        body = piece.lstrip(SPACE)
        if len(piece) > 1 and body:
            for other in body:
                group[root(other)] = root(body[0])
    with_letters = {root(sign) for sign in group if sign.isalpha()}
    kinds = np.full(0x110000, SINGLE, np.uint8)
    for sign in group:
        kinds[ord(sign)] = LETTERS if root(sign) in with_letters else SIGNS
    kinds[ord(" ")] = SPACES
    return kinds


class Cutter:
    """Texts' units, in order; none for null and empty texts.

    A unit is a run of letters, or of other linked signs, with the spaces before it; spaces that neither follows; or any
    other character. Units of many texts are cut at once. They have a space where the model has U+2581, see ``_marked``.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.kinds, self.first = kinds_of_signs(vocabulary), " " * vocabulary.dummy_prefix

    def __call__(self, texts: list[str | None]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The units of all texts, one after another, and how many each text has."""
        texts = [self.first + text if text else "" for text in texts]
        ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
        text = "".join(texts).replace(SPACE, " ")
        if not text:
            return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kinds[points]
        before, here = kinds[:-1], kinds[1:]
        begins = np.ones(1 + len(points), bool)
        begins[1:-1] = (before != here) & ((before != SPACES) | (here < LETTERS)) | (here == SINGLE)
        begins[ends] = True
        starts = np.flatnonzero(begins[:-1])
        data = text.encode()
        if len(data) == len(points):
            places = np.append(starts, len(points))
        else:
            widths = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
            places = np.concatenate([[0], np.cumsum(np.add.reduceat(widths, starts, dtype=np.int64))])
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
        return units, np.diff(np.searchsorted(starts, ends), prepend=0)


def _marked(units: pa.Array) -> pa.Array:
    return pc.replace_substring(units, " ", SPACE).cast(pa.string())


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``TEXT_AT_ONCE`` bytes of text at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        lots = np.cumsum(sizes, dtype=np.int64) // TEXT_AT_ONCE
        for start, end in pairwise([0, *(1 + np.flatnonzero(np.diff(lots))).tolist(), len(lots)]):
            yield batch.slice(start, end - start)


def _by_id(spark: SparkSession, values: dict[int, object], kind: str) -> Column:
    """``values`` as one array that is looked up by id; null where there is none.

    Such a table is selected beside a row's columns and named once in the projection right above, which therefore
    takes it in: no row ever holds a copy.
    """
    rows = spark.createDataFrame([(i, values.get(i)) for i in range(1 + max(values, default=0))], f"id int, v {kind}")
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("a")).scalar()


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(unit, edges)`` for the distinct units in ``units``; an edge is ``end, start, id`` in one number.

    Every unit has the empty piece at its start, so that units without a match stay.
    """
    known = [("", ALONE), *((p, i) for p, i, _ in vocabulary.pieces if vocabulary.kind == UNIGRAM or len(p) > 1 and vocabulary.merges(p))]
    pieces = units.sparkSession.createDataFrame(pd.DataFrame(known, columns=["piece", "id"]), "piece string, id int")
    least = 1 if vocabulary.kind == UNIGRAM else 2
    # Dealt by unit first: neither the explosion nor the broadcast join moves a row of a unit away. Units are short
    # and their lattices are work, so partitions go by their number and not by their bytes.
    parts = 1 + units.count() // UNITS_A_TASK
    dealt = units.select("unit").repartition(parts, "unit").withColumn("n", F.char_length("unit"))
    starts = dealt.select("unit", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - least, F.lit(0)))).alias("start"))
    sizes = F.sequence(F.when(F.col("start") == 0, 0).otherwise(least), F.least(F.lit(vocabulary.longest), F.col("n") - F.col("start")))
    spans = starts.select("unit", "start", F.explode(sizes).alias("size"))
    piece = F.coalesce(F.substring("unit", F.col("start") + 1, F.col("size")), F.lit("")).alias("piece")
    substrings = spans.select("unit", "start", "size", piece)
    edge = _edge(F.col("start") + F.col("size"), F.col("start"), F.col("id"))
    found = substrings.join(F.broadcast(pieces), "piece").select("unit", edge.alias("edge"))
    return found.groupBy("unit").agg(F.collect_list("edge").alias("edges"))


def _edge(end: Column, start: Column, piece: Column) -> Column:
    ends = F.shiftleft(end.cast("long"), PLACE_BITS + ID_BITS)
    return ends.bitwiseOR(F.shiftleft(start.cast("long"), ID_BITS)).bitwiseOR(piece.cast("long"))


def _start(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _piece(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit(ALONE)).cast("int")


def viterbi(unit: Column, edges: Column, weights: Column, kind: int) -> Column:
    """The best path's edges; ``ALONE`` is the piece of a character's own edge.

    ``weights`` are looked up by id. The state has, for every place so far, the weight of the best path to it and
    that path's last edge; the next place takes the least of what its edges offer.
    """
    n = F.char_length(unit)
    weight = "array<bigint>" if kind == BPE else "array<double>"
    state = f"struct<weight:{weight},edge:bigint>"
    # a BPE list ends with what follows every merge, so that a list that goes on comes before one that ends
    first = F.array(F.lit((1 << 63) - 1) if kind == BPE else F.lit(0.0))

    def offer(best: Column, edge: Column) -> Column:
        start, piece = _start(edge), _piece(edge)
        before = F.get(best, start)["weight"]
        if kind == BPE:
            total = F.sort_array(F.concat(before, F.transform(F.get(weights, piece), lambda m: m + start)))
        else:
            total = F.array(F.get(before, F.lit(0)) + F.get(F.get(weights, piece + 1), F.lit(0)))
        return F.struct(total.alias("weight"), edge.alias("edge"))

    def alone(best: Column, end: Column) -> Column:
        before = F.get(best, end - 1)["weight"]
        total = before if kind == BPE else F.array(F.get(before, F.lit(0)) + F.get(F.get(weights, F.lit(0)), F.lit(0)))
        return F.struct(total.alias("weight"), _edge(end, end - 1, F.lit(ALONE)).alias("edge"))

    def forward(best: Column, end: Column) -> Column:
        ending = F.filter(edges, lambda e: F.shiftright(e, PLACE_BITS + ID_BITS) == end)
        offers = F.transform(ending, lambda e: offer(best, e))
        return F.array_append(best, F.array_min(F.array_append(offers, alone(best, end))))

    start = F.array(F.struct(first.alias("weight"), F.lit(0).cast("bigint").alias("edge"))).cast(f"array<{state}>")

    # backwards from the last edge, over every place, to the edges that start where the path has come to
    best = F.aggregate(F.sequence(F.lit(1), n), start, forward, lambda best: F.transform(best, lambda s: s["edge"]))

    def path(lasts: Column) -> Column:
        def back(path: Column, end: Column) -> Column:
            reached = _start(F.get(path, F.lit(0))) == end
            return F.when(reached & (end > 0), F.array_prepend(path, F.get(lasts, end))).otherwise(path)

        return F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.array(F.element_at(lasts, -1)), back)

    return let(best, path)


def _weights(spark: SparkSession, vocabulary: Vocabulary) -> Column:
    """What each piece adds to a path's weight; for a unigram model one place on, after the unknown character's."""
    if vocabulary.kind == BPE:
        merges = {i: vocabulary.merges(p) for p, i, _ in vocabulary.pieces if len(p) > 1}
        return _by_id(spark, {i: [rank << 32 | at for rank, at in sorted(m)] for i, m in merges.items() if m}, "array<bigint>")
    unknown = 10.0 - min(s for _, _, s in vocabulary.pieces)
    return _by_id(spark, {0: [unknown]} | {i + 1: [-s] for _, i, s in vocabulary.pieces}, "array<double>")


def _spelt(unit: Column, path: Column, singles: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a path, with a character's own edge spelt as its piece, its bytes or the unknown piece.

    ``singles`` are the ids of single characters by code point.
    """
    byte_ids = F.array(*(F.lit(vocabulary.byte_ids[b]) for b in range(256))) if vocabulary.byte_ids else None

    def one(edge: Column) -> Column:
        sign = F.substr(unit, _start(edge) + 1, F.lit(1))
        if byte_ids is None:
            other = F.array(F.lit(vocabulary.unknown))
        else:
            digits = F.hex(F.encode(sign, "UTF-8"))
            pairs = F.sequence(F.lit(1), F.char_length(digits), F.lit(2))
            other = F.transform(pairs, lambda k: F.get(byte_ids, F.conv(F.substr(digits, k, F.lit(2)), 16, 10).cast("int")))
        spelt = let(F.get(singles, F.ascii(sign)), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(other))
        return F.when(_piece(edge) == ALONE, spelt).otherwise(F.array(_piece(edge)))

    return F.flatten(F.transform(path, one))


def coded(units: DataFrame, vocabulary: Vocabulary, folder: str, name: str) -> DataFrame:
    """``encode_units`` as a table.

    A task's units are bounded, so that their edges are grouped in memory: the session's limit of 128 groups, beyond
    which they would be sorted, is lifted meanwhile.
    """
    conf, key = units.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    former = conf.get(key)
    conf.set(key, str(4 * UNITS_A_TASK))
    try:
        return written(encode_units(units, vocabulary), folder, name)
    finally:
        conf.set(key, former)


def merge(text: str, ranks: dict[str, int], longest: int) -> list[int]:
    """Where the pieces that BPE leaves of a text begin, and its length: one merge at a time, by a queue."""
    n = len(text)
    after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (end := after[j]) - i <= longest:
            rank = ranks.get(text[i:end])
            if rank is not None:
                heapq.heappush(queue, (rank, i, j, end))

    for i in range(n):
        offer(i)
    while queue:
        _, i, j, end = heapq.heappop(queue)
        if not (alive[i] and alive[j] and after[i] == j and after[j] == end):
            continue
        after[i], alive[j] = end, False
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [*(i for i in range(n) if alive[i]), n]


def _merged(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(unit, ids)`` of long BPE units."""
    ranks, longest = vocabulary.ranks, vocabulary.longest
    ids_of = {p: i for p, i, _ in vocabulary.pieces}
    byte_ids, unknown = vocabulary.byte_ids, vocabulary.unknown

    @F.pandas_udf("array<int>")
    def ids(units: pd.Series) -> pd.Series:
        out = []
        for text in units:
            found: list[int] = []
            for start, end in pairwise(merge(text, ranks, longest)):
                piece = ids_of.get(text[start:end])
                if piece is not None:
                    found.append(piece)
                else:
                    found.extend([byte_ids[b] for b in text[start:end].encode("utf-8", "surrogatepass")] if byte_ids else [unknown])
            out.append(found)
        return pd.Series(out)

    return units.select("unit", ids("unit").alias("ids"))


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(unit, ids)`` for the distinct units in ``units``."""
    vocabulary.check()
    spark = units.sparkSession
    is_long = (F.char_length("unit") > LONG) if vocabulary.kind == BPE else F.lit(False)
    found = lattice(units.where(~is_long), vocabulary)
    singles = _by_id(spark, {ord(p): i for p, i, _ in vocabulary.pieces if len(p) == 1}, "int")
    found = found.select("unit", "edges", _weights(spark, vocabulary).alias("weights"), singles.alias("singles"))
    path = viterbi(F.col("unit"), F.col("edges"), F.col("weights"), vocabulary.kind)
    encoded = found.select("unit", _spelt(F.col("unit"), path, F.col("singles"), vocabulary).alias("ids"))
    return encoded.unionByName(_merged(units.where(is_long), vocabulary)) if vocabulary.kind == BPE else encoded


def frequent_units(docs: DataFrame, vocabulary: Vocabulary, folder: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(unit, ids)`` of the units that are most frequent in the sample, at most ``FREQUENT``."""
    total = docs.count()
    part = int((1 << 30) * min(1.0, sample_docs / max(1, total)))
    some = docs.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) < part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(vocabulary)
        for batch in _lots(batches):
            units, _ = cut(batch.column("text").to_pylist())
            found = pc.value_counts(units.filter(pc.less_equal(pc.utf8_length(units), FREQUENT_CHARS)))
            yield pa.RecordBatch.from_arrays([_marked(found.field("values")), found.field("counts")], ["unit", "n"])

    counts = some.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    best = counts.where("n > 1").orderBy(F.desc("n"), "unit").limit(FREQUENT).select("unit")
    return coded(written(best, folder, "frequent"), vocabulary, folder, "frequent-coded")


def _passes(docs: DataFrame, known: Broadcast, vocabulary: Vocabulary, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """The blocks of known units, ``(doc_id, text_key, place, ids)``, and the others, ``(doc_id, text_key, place, unit)``.

    ``known`` has the units, as ``Cutter`` has them, and lists of their ids.
    """
    spell = _speller(vocabulary)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows, their units, the numbers of these among the known ones (or null), where a row's begin, how many it has."""
        cut, units_known = Cutter(vocabulary), known.value[0]
        for batch in _lots(batches):
            units, counts = cut(batch.column("text").to_pylist())
            yield batch, units, pc.index_in(units, units_known), np.cumsum(counts) - counts, counts

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_known = known.value[1]
        for batch, units, found, firsts, counts in cut_up(batches):
            is_known = found.is_valid().to_numpy(zero_copy_only=False)
            new = np.ones(1 + len(units), bool)  # a row's first unit, or one after another that isn't known
            new[1:] = ~is_known
            new[firsts] = True
            begins = np.flatnonzero(is_known & new[:-1])
            ids = ids_known.take(found.drop_null())
            # where the ids of each known unit begin; a block's first one is so many known units on
            places = ids.offsets.to_numpy()[np.append(np.cumsum(is_known)[begins] - 1, len(ids))]
            rows, none = np.searchsorted(firsts + counts, begins, side="right"), np.flatnonzero(counts == 0)
            blocks = pa.ListArray.from_arrays(pa.array(np.append(places, np.full(len(none), places[-1])), pa.int32()), ids.values)
            at = np.append(begins - firsts[rows], np.zeros(len(none), np.int64))
            yield _rows(batch, np.append(rows, none), at, blocks, "ids")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, units, found, firsts, counts in cut_up(batches):
            holes = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            rows = np.searchsorted(firsts + counts, holes, side="right")
            yield _rows(batch, rows, holes - firsts[rows], _marked(units.take(pa.array(holes))), "unit")

    keys = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, place int"
    said = lambda batches: spell(runs(batches))
    blocks = docs.mapInArrow(said, f"{keys}, ids array<int>, text string") if with_text else docs.mapInArrow(runs, f"{keys}, ids array<int>")
    return blocks, docs.mapInArrow(others, f"{keys}, unit string")


def _rows(batch: pa.RecordBatch, rows: np.ndarray, places: np.ndarray, last: pa.Array, name: str) -> pa.RecordBatch:
    of = pa.array(rows, pa.int32())
    keys = [batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(places, pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, last], ["doc_id", "text_key", "place", name])


BLOCK = ("doc_id", "text_key", "place", "ids")


def encode(docs: DataFrame, vocabulary: Vocabulary, sample_docs: int = SAMPLE_DOCS, with_text: bool = False) -> DataFrame:
    """The blocks of every document: ``doc_id, text_key, place, ids``, and on request ``text``, see ``decode``."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    table = frequent_units(docs, vocabulary, folder, sample_docs).toArrow()
    units = pc.replace_substring(table.column("unit").combine_chunks().cast(pa.large_string()), SPACE, " ")
    known = (units, table.column("ids").combine_chunks().cast(pa.list_(pa.int32())))
    blocks, others = _passes(docs, spark.sparkContext.broadcast(known), vocabulary, with_text)
    others = written(others, folder, "others")
    units = written(others.select("unit").distinct(), folder, "units")
    others = others.join(coded(units, vocabulary, folder, "others-coded"), "unit").select(*BLOCK)
    return blocks.unionByName(decode(others, vocabulary) if with_text else others)


def _speller(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that adds ``text`` to batches of blocks: what their ids spell, one after another."""
    size = 1 + max([i for _, i, _ in vocabulary.pieces] + [*vocabulary.byte_ids.values(), vocabulary.unknown])
    spelling = [b""] * size
    for piece, i, _ in vocabulary.pieces:
        spelling[i] = piece.replace(SPACE, " ").encode()
    for byte, i in vocabulary.byte_ids.items():
        spelling[i] = bytes([byte])
    # the same once more without a first character, for the pieces that a dummy space begins
    if vocabulary.dummy_prefix:
        spelling += [spelt[1:] for spelt in spelling]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(spelling, pa.large_binary())
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy().astype(np.int64)
            pieces = ids.values.to_numpy()[ends[0] : ends[-1]].copy()
            ends = ends - ends[0]
            if vocabulary.dummy_prefix:
                begins = (batch.column("place").to_numpy() == 0) & (ends[1:] > ends[:-1])
                pieces[ends[:-1][begins]] += size
            spelt = table.take(pa.array(pieces))
            _, offsets, data = spelt.buffers()
            places = np.frombuffer(offsets, np.int64, len(spelt) + 1)[ends] if len(spelt) else ends
            text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(places.tobytes()), data or pa.py_buffer(b""))
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], [*batch.schema.names, "text"])

    return spell


def decode(blocks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``blocks`` with ``text``, decoded from their ids; a document's texts in the order of ``place`` make up its own."""
    blocks = blocks.select(*(c for c in blocks.columns if c != "text"))
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.mapInArrow(_speller(vocabulary), f"{given}, text string")


def together(blocks: DataFrame) -> DataFrame:
    """``(doc_id, text_key, ids)``: whole documents, where one row holds a document's ids."""
    ordered = F.sort_array(F.collect_set(F.struct("place", "ids")))  # equal rows have equal blocks
    return blocks.groupBy("doc_id", "text_key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
