"""N-gram Jaccard join: documents whose sets of word shingles overlap by 90 percent, as linked groups.

The join is size-aware. Sets with equal members are one class, and classes are compared by signatures:

* a small set is given every pair out of a short prefix of its members (fixed-size subsets), so two small
  sets become candidates only if they share two of them;
* a large set is put in the inverted list of each member of a shorter prefix.

Members are ordered by how often their hash bucket occurs in the corpus, rarest first, and a prefix is as
long as a pair with the wanted overlap needs in order to share two members, or one. The boundary between
small and large is where the two ways cost least on the corpus at hand; sets just under it go both ways, so
that a pair across it meets in an inverted list.

Signatures that few classes share give pairs, which must pass a bound on sizes and two on the overlap: for large
sets one from the number of members that their prefixes share, which needs no look at a set and leaves out nearly
all pairs that met by chance; then one from counts of members by residue, of which a set has as many as fit its size. Of the members of
signatures that many classes share (families of near copies) only those that pass this bound are connected, by as few
edges as do; the longest lists of all give a star of their members. Connected candidates are then compared exactly, and a pair is looked at only as
long as it isn't connected by links that were found before. A group of few members is compared in one task. A larger
one is dealt into blocks, each with the same few members as anchors, and compared in two rounds:

* each block by itself: what is close to an anchor, or to what is, becomes one component across the blocks;
* whatever isn't part of the group's largest component then meets every block. Two members of that component are
  connected already, so no pair that could link is left out, and a family of near copies isn't paired block by block.

Defined results: texts without words, and null texts, have no shingles and link with nothing; a text of
fewer words than a shingle is one shingle. Every row is a document of its own, whether its id is null, repeated
or neither; rows are told apart by their place in a file, or by a number that they get at the start. An empty table gives an empty one. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fetched, shared_folder, written

#: Buckets in which members are counted for their order.
ORDER_BUCKETS = 1 << 20
#: A signature that more classes share gives no pairs: its members are compared by their counts in one task.
LONG_LIST = 64
#: A signature that more classes share gives a star of candidates.
STAR_LIST = 4096
#: Residues by which members are counted for the bound on an overlap, at least; larger sets have more.
RESIDUES = 64
#: Members that a residue has in a set of more, at least.
RESIDUE_MEMBERS = 8
#: Buckets whose counts are one row.
COUNT_BLOCK = 1 << 14
#: Counts of so many lots of tasks are added up for themselves first.
COUNT_LOTS = 64
#: Members of one block of a candidate group, about.
BLOCK_MEMBERS = 1_000_000
#: Sets that all blocks of a group share.
ANCHORS = 16
#: Ids up to this many are broadcast instead of shuffling the texts that they pick.
BROADCAST_IDS = 2_000_000
#: What a look at a candidate costs in signature rows: it goes through a distinct and two joins with wide rows.
LOOK_COST = 8.0
#: Classes whose lists are all looked at to measure these costs.
LOOKED_AT = 20_000

_EMPTY = np.zeros(0, np.uint64)


class _WordHashes(dict):
    """Words to 64-bit hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, hashes: dict[bytes, int], words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    # bytes.lower() changes A-Z only and bytes.split() splits at the six ASCII white-space characters
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return _EMPTY
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(each))
    total = np.full(len(each) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + each[k : len(each) - width + 1 + k])
    return np.unique(total)


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set that it links with."""
    return -(-percent * size // 100)


def residues(size: int) -> int:
    """How many residues the members of a set of this size are counted by: a power of two, more for larger sets.

    With a fixed number, two large sets of like size have like counts, so chance would pass the bound.
    """
    return max(RESIDUES, (1 << (size.bit_length() - 1)) // RESIDUE_MEMBERS) if size else RESIDUES


def residue_counts(members: np.ndarray) -> bytes:
    """A set's members counted by residue, in as few bytes a count as hold the largest."""
    counts = np.bincount((members % np.uint64(residues(len(members)))).astype(np.int64), minlength=residues(len(members)))
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def most_shared(n: int, x: bytes, m: int, y: bytes) -> int:
    """A bound on the overlap of sets of ``n`` and ``m`` members with these counts by residue."""
    left, right = (np.frombuffer(c, f"<u{len(c) // residues(size)}") for size, c in ((n, x), (m, y)))
    few = min(len(left), len(right))
    return int(np.minimum(*(c.reshape(-1, few).sum(0, dtype=np.int64) for c in (left, right))).sum())


def alike_by_counts(ids: np.ndarray, sizes: np.ndarray, counts: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs of ids that connect all sets whose counts by residue let them link, and no others."""
    order = np.lexsort((ids, sizes))
    n = sizes[order].astype(np.int64)
    width = np.array([residues(int(x)) for x in n], np.int64)
    label, found = np.arange(len(n)), []
    held: dict[int, np.ndarray] = {}  # counts of the sets with so many residues, in order; a larger set has no fewer
    for w in np.unique(width).tolist():
        some = [counts[k] for k in order[width == w].tolist()]
        held[w] = np.stack([np.frombuffer(c, f"<u{len(c) // w}").astype(np.uint32) for c in some])
    starts = {w: int(np.searchsorted(width, w)) for w in held}
    for k in range(1, len(n)):
        own, first = held[int(width[k])][k - starts[int(width[k])]], int(np.searchsorted(100 * n, percent * n[k]))
        for w in np.unique(width[first:k]).tolist():
            low, high = max(first, starts[w]), min(k, starts[w] + len(held[w]))
            other = low + np.flatnonzero(label[low:high] != label[k])  # the others are connected with it already
            both = np.minimum(held[w][other - starts[w]], own.reshape(-1, w).sum(0)).sum(1, dtype=np.int64)
            for j in other[(100 + percent) * both >= percent * (n[other] + n[k])].tolist():
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    found.append((int(ids[order[j]]), int(ids[order[k]])))
    return found


def bucket_counts(docs: DataFrame, words: int) -> DataFrame:
    """``(block, counts)``: documents' shingles by hash bucket, packed; a task adds up its own before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashes = np.zeros(ORDER_BUCKETS, np.int64), _WordHashes()
        for batch in batches:
            for text in batch["text"]:
                total[(shingles(text, hashes, words) >> np.uint64(40)).astype(np.int64) % ORDER_BUCKETS] += 1
        for block, at in enumerate(range(0, ORDER_BUCKETS, COUNT_BLOCK)):
            some = total[at : at + COUNT_BLOCK]
            if some.any():
                yield pd.DataFrame({"block": [block], "counts": [_packed(some)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(map(_unpacked, group["counts"]))
        return pd.DataFrame({"block": group["block"].iloc[:1], "counts": [_packed(total)]})

    counted = docs.select("text").mapInPandas(count, "block int, counts binary")
    counted = counted.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(COUNT_LOTS)))
    return counted.groupBy("block", "lot").applyInPandas(add, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), "<i8")


def _ranks(counts: DataFrame) -> np.ndarray:
    """Counts by bucket: ``ORDER_BUCKETS`` numbers, whatever the corpus."""
    order = np.zeros(ORDER_BUCKETS, np.int32)
    for block, some in fetched(counts).itertuples(index=False):
        order[block * COUNT_BLOCK : (block + 1) * COUNT_BLOCK] = np.minimum(_unpacked(some), np.iinfo(np.int32).max)
    return order


def _in_order(members: np.ndarray, order: np.ndarray) -> np.ndarray:
    return members[np.lexsort((members, order[(members >> np.uint64(40)).astype(np.int64) % ORDER_BUCKETS]))]


SET_ROW = "row long, said string, n_shingles long, class binary, counts binary, prefix array<long>"


def _sets(docs: DataFrame, order, words: int, percent: int) -> DataFrame:
    """A row a document: the size and class of its set, its counts by residue and its longer prefix.

    Ids pass as text, as pandas would turn whole numbers beside a null into floating-point ones.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            out = []
            for row, said, text in zip(batch["row"], batch["said"], batch["text"], strict=True):
                members = shingles(text, hashes, words)
                n = len(members)
                prefix = _in_order(members, order.value)[: n - needed(n, percent) + 2]
                key = hashlib.blake2b(members.tobytes(), digest_size=16).digest() if n else None
                out.append((row, said, n, key, residue_counts(members), prefix.view(np.int64)))
            yield pd.DataFrame(out, columns=["row", "said", "n_shingles", "class", "counts", "prefix"])

    said = F.col("doc_id").cast("string").alias("said")
    found = docs.select("row", said, "text").mapInPandas(rows, SET_ROW)
    return found.withColumn("doc_id", F.col("said").cast("long")).drop("said")


def _prefix(n, percent: int, share: int):
    """How many of a set's members, in order, two sets with the needed overlap share ``share`` of."""
    return n - F.ceil(F.lit(percent) * n / 100) + share


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """``(signature, rep)`` of single members, for every class."""
    return classes.select("rep", "n", F.explode(F.slice("prefix", 1, _prefix(F.col("n"), percent, 1))).alias("signature"))


def boundary_by_cost(classes: DataFrame, percent: int) -> int:
    """The size up to which pairs of members are cheaper than inverted lists.

    Each signature costs a row. An inverted list costs, besides, the looks at its candidates; how many these are
    for sets of each size is measured on all lists of few classes, and on a 64th of the lists of many. A pair of members is taken to give no look: two sets
    that share one nearly always link. Sets just under the boundary pay for both ways. Of equal costs the larger
    boundary wins.
    """
    part = min(64, 1 + classes.count() // LOOKED_AT)
    lists = _lists(classes, percent).where(F.pmod("signature", F.lit(part)) == 0)
    # long lists become stars, whose cost doesn't depend on their length
    lengths = lists.groupBy("signature").agg(F.count("*").alias("size")).where(F.col("size").between(2, LONG_LIST))
    looks = fetched(lists.join(lengths, "signature").groupBy("n").agg((part * F.sum(F.col("size") - 1)).alias("looks")))
    sizes = fetched(classes.groupBy("n").count()).merge(looks, "left", "n").fillna({"looks": 0}).sort_values("n")
    n, c, seen = (sizes[x].to_numpy(np.int64) for x in ("n", "count", "looks"))  # a row a size of a set
    if not len(n):
        return 0
    single = n + (-percent * n // 100) + 1
    pairs, lists_cost = c * single * (single + 1) / 2, c * single + LOOK_COST * seen
    # high enough over size n[k] that it needn't go both ways, if no other size lies between
    bounds = np.minimum(np.append(n[1:] - 1, n[-1]), -(-100 * n // percent))
    first_large = np.searchsorted(100 * n, percent * bounds, side="right")  # sizes that go through lists
    below, above = np.cumsum(pairs), np.append(np.cumsum(lists_cost[::-1])[::-1], 0.0)
    cost = np.concatenate([[above[0]], below + above[first_large]])
    return int(np.concatenate([[0], bounds])[len(cost) - 1 - int(np.argmin(cost[::-1]))])


def _signatures(classes: DataFrame, percent: int, boundary: int) -> DataFrame:
    """``(signature, rep, n)``: subsets of two for small sets, single members for large ones.

    Two sets that need an overlap of one member have a single one each, so they are one class and need no pair.
    """
    large = _lists(classes.where(100 * F.col("n") > percent * boundary), percent)
    small = classes.where(F.col("n") <= boundary)
    longer = F.slice("prefix", 1, _prefix(F.col("n"), percent, 2))
    pairs = F.flatten(
        F.transform(
            longer,
            lambda x, i: F.transform(F.slice(longer, i + 2, F.size(longer)), lambda y: F.xxhash64(F.lit(2), x, y)),
        )
    )
    return large.select("signature", "rep", "n").unionByName(
        small.select(F.explode(pairs).alias("signature"), "rep", "n")
    )


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``(id, root)`` for every id of ``edges (a, b)``: the smallest id it is connected with.

    Rounds of randomised contraction: every id goes to the first of itself and its neighbours, in an order that a hash
    draws anew each round, and the next round has only the edges between ids that went to different ones. At most three
    quarters of the ids are expected to be left whatever the shape, so a component that takes more rounds doesn't make
    the edges of all others be read again.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a != b").distinct(), folder, f"{name}-edges-0")
    went: list[DataFrame] = []
    while not both.isEmpty():

        def drawn(column: str, step: int = len(went)) -> Column:
            return F.struct(F.xxhash64(F.lit(step), column).alias("draw"), F.col(column).alias("id"))

        first = both.groupBy("a").agg(F.min(drawn("b")).alias("m"))
        to = written(first.select(F.col("a").alias("id"), F.least(drawn("a"), "m")["id"].alias("root")), folder, f"{name}-{len(went)}")
        went.append(to)
        ends = both.join(to.select(F.col("id").alias("a"), F.col("root").alias("to_a")), "a")
        ends = ends.join(to.select(F.col("id").alias("b"), F.col("root").alias("to_b")), "b").where("to_a != to_b")
        both = written(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), folder, f"{name}-edges-{len(went)}")
    # where an id went, from the last round back to the first: rounds have ever fewer ids
    found = both.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for to in reversed(went):
        later = found.select(F.col("id").alias("root"), F.col("root").alias("last"))
        found = to.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    found = written(found, folder, f"{name}-went")
    least = found.groupBy("root").agg(F.min("id").alias("least"))
    return written(found.join(least, "root").select("id", F.col("least").alias("root")), folder, name + "-roots")


def _candidates(classes: DataFrame, percent: int, boundary: int, folder: str) -> DataFrame:
    """Edges ``(a, b)`` between classes that may link; every pair that links is connected by them."""
    postings = written(_signatures(classes, percent, boundary), folder, "postings")
    shared = postings.groupBy("signature").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
    held = written(postings.join(shared, "signature"), folder, "shared")
    known = classes.select("rep", "n", "counts")
    star = held.where(F.col("size") > STAR_LIST).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    long = held.where((F.col("size") > LONG_LIST) & (F.col("size") <= STAR_LIST)).select("signature", "rep")

    def alike(group: pd.DataFrame) -> pd.DataFrame:
        found = alike_by_counts(group["rep"].to_numpy(), group["n"].to_numpy(), list(group["counts"]), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    families = long.join(known, "rep").groupBy("signature").applyInPandas(alike, "a long, b long").distinct()
    lists = held.where(F.col("size") <= LONG_LIST).groupBy("signature").agg(
        F.sort_array(F.collect_list(F.struct("n", "rep"))).alias("l")
    )
    near = F.flatten(
        F.transform(
            "l",
            lambda x, i: F.transform(
                F.filter(F.slice("l", i + 2, LONG_LIST), lambda y: 100 * x["n"] >= percent * y["n"]),
                lambda y: F.struct(
                    F.least(x["rep"], y["rep"]).alias("a"),
                    F.greatest(x["rep"], y["rep"]).alias("b"),
                    x["n"].alias("least"),
                    y["n"].alias("most"),
                ),
            ),
        )
    )
    met = lists.select(F.explode(near).alias("p")).select("p.*").where("a != b")
    pairs = met.groupBy("a", "b", "least", "most").agg(F.count("*").alias("met")).where(_met_enough(percent, boundary)).select("a", "b")

    @F.pandas_udf("boolean")
    def may_link(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        found = [(100 + percent) * most_shared(i, p, j, q) >= percent * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
        return pd.Series(found, dtype=bool)

    pairs = (
        pairs.join(known.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca")), "a")
        .join(known.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "b")
        .where(may_link("na", "nb", "ca", "cb"))
    )
    return star.unionByName(families).unionByName(pairs.select("a", "b")).where("a != b")


def _met_enough(percent: int, boundary: int) -> Column:
    """Whether two sets of ``least`` and ``most`` members that met in ``met`` lists of single members may link.

    Of two prefixes one ends first in the order. All that the sets share up to its end is in both prefixes, and has met
    unless one of it has a long list, by which the two are connected if they link. Beyond its end its set has as many members as aren't
    in the prefix. Sets up to the boundary meet by pairs of members, which say nothing about that.
    """
    beyond = F.col("most") - _prefix(F.col("most"), percent, 1)
    enough = (100 + percent) * (F.col("met") + beyond) >= percent * (F.col("least") + F.col("most"))
    return (F.col("least") <= boundary) | enough


class _Forest:
    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, enough to connect all that are connected, as pairs of ids.

    Sets with equal values in ``known`` are connected already.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2 or not sizes.sum():
        return []
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)  # rarest first, by value among equals
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    ranked = [np.sort(x) for x in np.split(rank[place], np.cumsum(sizes)[:-1])]
    lists: dict[int, list[int]] = defaultdict(list)
    forest, links, whole = _Forest(len(sets)), [], {}
    if known is not None:
        _, first, component = np.unique(known, return_index=True, return_inverse=True)
        forest.up = first[component].tolist()

    def members(k: int) -> set[int]:
        if k not in whole:
            if len(whole) >= 2048:
                whole.clear()
            whole[k] = set(ranked[k].tolist())
        return whole[k]

    for k in np.lexsort((ids, sizes)).tolist():
        n = int(sizes[k])
        seen: set[int] = set()
        for key in ranked[k][: n - needed(n, percent) + 1].tolist():
            for j in lists[key]:
                if j in seen:
                    continue
                seen.add(j)
                if 100 * sizes[j] < percent * n or forest.root(j) == forest.root(k):
                    continue
                both = len(members(k) & members(j))
                if 100 * both >= percent * (n + int(sizes[j]) - both):
                    forest.up[forest.root(j)] = forest.root(k)
                    links.append((int(ids[j]), int(ids[k])))
            lists[key].append(k)
    return links


def _verified(docs: DataFrame, groups: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """Links ``(a, b)`` inside candidate groups ``(id, root, n)``, enough to connect what is connected."""
    sizes = groups.groupBy("root").agg(F.sum("n").alias("members"), F.count("*").alias("sets"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK_MEMBERS)).cast("int")
    sizes = sizes.select("root", blocks.alias("blocks"), (ANCHORS / F.col("sets")).alias("part"))
    dealt = groups.join(sizes, "root")
    draw = F.xxhash64(F.lit(1), "id")
    # anchors are drawn by a hash, about ANCHORS of a group
    dealt = dealt.select(
        "id",
        "root",
        "blocks",
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        (F.pmod(draw, F.lit(1 << 30)) < F.col("part") * (1 << 30)).alias("anchor"),
    )
    dealt = written(dealt, folder, "groups")

    def links(chosen: DataFrame, name: str) -> DataFrame:
        """Links of sets ``(id, root, known, meetings)`` that meet; ``known`` sets with one value are connected."""
        chosen = written(chosen, folder, f"{name}-chosen")
        few = chosen.count() <= BROADCAST_IDS
        texts = docs.select(F.col("row").alias("id"), "text").join(F.broadcast(chosen) if few else chosen, "id")

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = _WordHashes()
            for batch in batches:
                found = [shingles(text, hashes, words).view(np.int64) for text in batch["text"]]
                yield batch[["id", "root", "known", "meetings"]].assign(members=found)

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            sets = [np.asarray(m) for m in group["members"]]
            found = exact_links(group["id"].to_numpy(), sets, percent, group["known"].to_numpy())
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        sets = texts.mapInPandas(members, "id long, root long, known long, meetings array<long>, members array<long>")
        met = sets.select("id", "root", "known", F.explode("meetings").alias("meeting"), "members")
        return written(met.groupBy("root", "meeting").applyInPandas(compare, "a long, b long"), folder, name)

    def at(lot: Column, block: Column) -> Column:
        return F.shiftleft(lot.cast("long"), 32) + block

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    none = F.lit(0)
    own = F.when(F.col("anchor"), F.transform(every, lambda y: at(none, y))).otherwise(F.array(at(none, F.col("block"))))
    first = links(dealt.select("id", "root", F.col("id").alias("known"), own.alias("meetings")), "links-1")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return first
    found = connected(first, folder, "links-1-roots").withColumnRenamed("root", "known")
    large = large.join(found, "id", "left").withColumn("known", F.coalesce("known", "id"))
    counts = large.groupBy("root", "known").count()
    most = counts.groupBy("root").agg(F.max(F.struct("count", "known"))["known"].alias("most"))
    large = written(large.join(most, "root").withColumn("asks", F.col("known") != F.col("most")), folder, "asking")
    # those that ask are dealt into lots as large as blocks; each lot meets each block
    share = F.ceil(F.count_if("asks") * F.max("blocks") / F.count("*")).cast("int")
    lots = large.groupBy("root").agg(share.alias("lots")).where("lots > 0")
    large = large.join(lots, "root")
    lot = F.pmod(F.xxhash64(F.lit(2), "id"), F.col("lots"))
    there = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda x: at(x, F.col("block")))
    asks = F.when(F.col("asks"), F.transform(every, lambda y: at(lot, y))).otherwise(F.array().cast("array<bigint>"))
    second = links(large.select("id", "root", "known", F.array_union(there, asks).alias("meetings")), "links-2")
    return first.unionByName(second)


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is columns of files as they are read, so that a row is one of a file and stays there."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        return False
    try:  # only Parquet has rows' numbers
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a number of its own for each row that stays as it is however often it is read.

    Rows of files are numbered by their place there, so nothing is written anew; others are written with their numbers.
    """
    if not _is_scan(docs):
        return written(docs.withColumn("row", F.monotonically_increasing_id()), shared_folder(docs.sparkSession), "numbered")
    paths = sorted(fetched(docs.select(F.col("_metadata.file_path").alias("_path")).distinct())["_path"])
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "_file long, _path string")
    placed = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
    row = F.shiftleft("_file", 36) + F.col("_place")
    return placed.join(F.broadcast(files), "_path").select(*docs.columns, row.alias("row"))


def row_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``(row, doc_id, n_shingles, root, component_id)`` for every row of ``numbered`` documents.

    Rows that links connect have one ``root``, a row's number. ``component_id`` is their smallest id.
    """
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark)
    order = spark.sparkContext.broadcast(_ranks(written(bucket_counts(docs, words), folder, "order")))
    sets = written(_sets(docs, order, words, percent), folder, "sets")
    classes = (
        sets.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min(F.struct("row", F.col("n_shingles").alias("n"), "counts", "prefix")).alias("s"),
            F.min("doc_id").alias("least"),
        )
        .select("class", F.col("s.row").alias("rep"), "s.n", "s.counts", "s.prefix", "least")
    )
    classes = written(classes, folder, "classes")
    boundary = boundary_by_cost(classes, percent)
    candidates = _candidates(classes, percent, boundary, folder)
    groups = connected(candidates, folder, "candidates")
    groups = groups.join(classes.select(F.col("rep").alias("id"), "n"), "id")
    links = _verified(docs, groups, words, percent, folder)
    roots = connected(links, folder, "links-roots")
    named = classes.select("class", "rep", "least").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("class", F.coalesce("root", "rep").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("class", "root").join(ids, "root")
    found = sets.select("row", "doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("row", "doc_id", "n_shingles", F.coalesce("root", "row").alias("root"), component.alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row; the id of a group without any id is null."""
    found = row_components(numbered(docs.select("doc_id", "text")), words, percent)
    return found.select("doc_id", "n_shingles", "component_id")
