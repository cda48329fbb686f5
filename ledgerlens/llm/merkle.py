"""A manifest of a table as hash trees, and proofs of its rows by octopus multiproofs.

Each language has a tree of runs of eight; the roots of these trees are the leaves of a last tree, whose root stands
for the table. Rows are put in order by ranges of (language, id), so a language may hold all rows. Levels are built
bottom up, a shuffle of digests each, an eighth of the level below.

For proofs, each leaf partition computes the coordinates of the nodes that its leaves need and that they don't give
themselves, gets those nodes by one join, derives the interior nodes that its leaves share, and then expands the proof
of every leaf on its own.

Defined results: nulls are hashed as ``-``; null ids come first within their language, equal ids are ordered by their
leaves, and rows that are equal throughout stand side by side, each with a place and a proof of its own. A table without
rows has no root and no proofs. Columns besides the five that are hashed are left alone, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, residue, shared_folder, written

#: Children of a node.
RUN = 8
#: Leaves that one partition proves, about, as long as that makes at most ``MOST_PARTITIONS``.
LEAVES_A_PARTITION, MOST_PARTITIONS = 16_384, 1 << 17
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the roots of the others; theirs are ``-`` for no language and ``=`` before its name.
TOP = ""


def digest(*parts: Column) -> Column:
    """SHA-256 over strings one after another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaf(**replaced: Column) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its value, or a dash."""
    columns = [replaced.get(name, F.col(name)) for name in FIELDS]
    return digest(
        *(
            F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
            for c in columns
        )
    )


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text someone has lower-cased, where crc32 of the id is divisible by 3; else null."""
    return F.when(residue(F.col("doc_id"), 3) == 0, leaf(text=ascii_lower(F.col("text"))))


@dataclass
class Trees:
    """``rows``: what was given, with ``part, tree, idx, n`` (``n`` leaves in the tree). ``nodes``: ``tree, level, idx, hash``.
    ``roots``: ``tree, hash``."""

    rows: DataFrame
    nodes: DataFrame
    roots: DataFrame


def build(rows: DataFrame, order: list[str], folder: str, name: str) -> Trees:
    """The trees of ``rows (tree, hash, ...)``, whose leaves stand in the order of ``order`` and then ``hash``."""
    parts = min(MOST_PARTITIONS, 1 + rows.count() // LEAVES_A_PARTITION)
    by = ["tree", *order, "hash"]
    # an id that counts up within a sorted partition holds the partition's number and the row's place in it
    sorted_rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = written(sorted_rows.withColumn("part", F.shiftright("at", 33)), folder, f"{name}-placed")
    spans = placed.groupBy("part", "tree").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")  # a row a partition and tree
    before = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    spans = written(
        spans.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n")), folder, f"{name}-spans"
    )
    numbered = placed.join(spans, ["part", "tree"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "shift")
    numbered = written(numbered, folder, f"{name}-rows")
    most = spans.agg(F.max("n")).first()[0] or 0
    levels = [numbered.select("tree", F.lit(0).alias("level"), "idx", "n", "hash")]
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        joined = F.concat_ws("", F.transform(run, lambda x: F.lower(F.hex(x["hash"]))))
        upper = F.floor(F.col("idx") / RUN).cast("bigint").alias("idx"), F.ceil(F.col("n") / RUN).cast("bigint").alias("n")
        above = levels[-1].where("n > 1").groupBy("tree", *upper).agg(F.unhex(F.sha2(joined, 256)).alias("hash"))
        above = above.select("tree", F.lit(len(levels)).alias("level"), "idx", "n", "hash")
        levels.append(written(above, folder, f"{name}-level-{len(levels)}"))
        most = -(-most // RUN)
    nodes = reduce(DataFrame.unionByName, levels)
    return Trees(numbered, nodes.drop("n"), nodes.where("n = 1").select("tree", "hash"))


@dataclass
class Manifest:
    """The trees of the languages, the tree over their roots, and the root of all (None without rows)."""

    trees: Trees
    top: Trees
    root: bytes | None


def manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``changed`` may give another leaf for some rows, which is kept beside the true one."""
    folder = shared_folder(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree")
    other = (F.lit(None).cast("binary") if changed is None else changed).alias("changed")
    rows = written(docs.select("doc_id", tree, leaf().alias("hash"), other), folder, "leaves")
    trees = build(rows, ["doc_id"], folder, "languages")
    roots = trees.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "hash")
    top = build(roots, ["of"], folder, "top")
    found = top.roots.first()  # the one digest of the whole table
    return Manifest(trees, top, bytes(found["hash"]) if found else None)


def missing(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of some of ``n`` leaves need and that those leaves don't give."""
    known, level, out = np.unique(np.asarray(known, np.int64)), 0, []
    while n > 1:
        parents = np.unique(known // RUN)
        runs = (parents[:, None] * RUN + np.arange(RUN)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(runs[runs < n], known, assume_unique=True)]
        known, n, level = parents, -(-n // RUN), level + 1
    return out


class Paths:
    """What stands left and right of each node on the way up from some leaves of a tree; ``root`` is derived from them."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> None:
        self.levels: list[dict[int, tuple[str, str]]] = []
        known = leaves
        while n > 1:
            sides, above = {}, {}
            for p in sorted({i // RUN for i in known}):
                run = range(RUN * p, min(RUN * (p + 1), n))
                joined = "".join(known[i] if i in known else fetched[len(self.levels), i] for i in run)
                for place, i in enumerate(run):
                    if i in known:
                        sides[i] = joined[: 64 * place], joined[64 * place + 64 :]
                above[p] = sha256(joined.encode()).hexdigest()
            self.levels.append(sides)
            known, n = above, -(-n // RUN)
        self.root = known.get(0)

    def siblings(self, i: int) -> list[tuple[str, str]]:
        out = []
        for sides in self.levels:
            out.append(sides[i])
            i //= RUN
        return out


def fold(h: str, siblings: Iterable[tuple[str, str]]) -> str:
    """The root that a digest leads to."""
    for left, right in siblings:
        h = sha256(f"{left}{h}{right}".encode()).hexdigest()
    return h


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(manifest: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """A proof of each asked row: by default all rows, else some of ``manifest.trees.rows``.

    ``leaf, subroot, root`` are the manifest's; ``folded_root`` follows from the changed leaf, or from the true one where
    none is given, and the true siblings. ``verified`` says that it equals the root.
    """
    asked = manifest.trees.rows if asked is None else asked
    folder = shared_folder(asked.sparkSession)
    tops = manifest.top.rows.select(F.col("of").alias("tree"), F.col("idx").alias("place"), F.col("n").alias("trees"), "hash")
    of_part = asked.select("part", "tree").distinct().join(tops, "tree")
    of_part = written(of_part, folder, "trees-of-partitions")
    given = asked.select("part", "tree", "idx", "n").unionByName(
        of_part.select("part", F.lit(TOP).alias("tree"), F.col("place").alias("idx"), F.col("trees").alias("n"))
    )

    def coordinates(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], tree, *c) for tree, some in rows.groupby("tree", sort=False) for c in missing(some["idx"], int(some["n"].iloc[0]))]
        return pd.DataFrame(out, columns=["part", "tree", "level", "idx"])

    wanted = given.groupBy("part").applyInPandas(coordinates, "part long, tree string, level int, idx long")
    nodes = manifest.trees.nodes.unionByName(manifest.top.nodes)
    fetched = wanted.join(nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", F.lit(0).cast("bigint").alias("n"), "hash")
    # level -1: a tree's place among the trees, how many there are, and its root
    own = of_part.select("part", "tree", F.lit(-1).alias("level"), F.col("place").alias("idx"), F.col("trees").alias("n"), "hash")
    held = written(fetched.unionByName(own), folder, "fetched")
    root = manifest.root.hex() if manifest.root else None

    def proofs(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, dict[tuple[int, int], str]] = {}
        for tree, level, i, h in zip(nodes["tree"], nodes["level"], nodes["idx"], nodes["hash"], strict=True):
            known.setdefault(tree, {})[level, i] = h.hex()
        places = {t: (i, n) for t, i, n in nodes.loc[nodes["level"] < 0, ["tree", "idx", "n"]].itertuples(index=False)}
        ways, derived = {}, {}
        for tree, some in rows.groupby("tree", sort=False):
            leaves = dict(zip(some["idx"], (h.hex() for h in some["hash"]), strict=True))
            ways[tree] = Paths(leaves, known.get(tree, {}), int(some["n"].iloc[0]))
            derived[places[tree][0]] = ways[tree].root
        top = Paths(derived, known.get(TOP, {}), next(iter(places.values()))[1]) if ways else None
        out = []
        for doc, tree, i, true, changed in zip(rows["doc_id"], rows["tree"], rows["idx"], rows["hash"], rows["changed"], strict=True):
            siblings = [*ways[tree].siblings(i), *top.siblings(places[tree][0])]
            proof = sha256("".join(x for pair in siblings for x in pair).encode()).hexdigest()
            # a true leaf leads to the root that the shared interior nodes have led to
            folded = top.root if changed is None or changed == true else fold(changed.hex(), siblings)
            subroot = known[tree][-1, places[tree][0]]
            out.append((None if pd.isna(doc) else int(doc), true.hex(), subroot, root, proof, folded, folded == root))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in PROOF.split(", ")])
        return found.astype({"doc_id": "Int64"})

    return asked.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(proofs, PROOF)
