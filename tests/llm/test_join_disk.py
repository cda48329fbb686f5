"""What the n-gram join keeps on disk: no copy of its input, and no candidates that meet by chance."""

import random

import numpy as np

from ledgerlens.llm import jaccard
from ledgerlens.llm.common import written

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]


def drawn(n: int) -> list[str]:
    return [rng.choice(WORDS) for _ in range(n)]


def members(n: int, draw: np.random.Generator) -> np.ndarray:
    return np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))


def test_counts_tell_large_sets_apart_and_never_too_little():
    draw = np.random.default_rng(4)
    for n in (1, 40, 1000, 1023, 1024, 1100, 20_000):
        base = members(n, draw)
        other = members(n, draw)
        near = np.union1d(base[: len(base) - n // 20], members(n // 30 + 1, draw))
        for x, y in ((base, near), (near, base), (base, other)):
            bound = jaccard.most_shared(len(x), jaccard.residue_counts(x), len(y), jaccard.residue_counts(y))
            assert bound >= len(np.intersect1d(x, y))
        assert n == 1 or 190 * bound < 90 * (len(base) + len(other))  # two sets by chance
    skewed = np.arange(0, 64 * 700, 64, dtype=np.uint64)  # all of one residue
    assert jaccard.most_shared(700, jaccard.residue_counts(skewed), 700, jaccard.residue_counts(skewed)) == 700


def test_long_lists_connect_only_what_may_link():
    draw = np.random.default_rng(5)
    sets = []
    for size in (60, 1000, 3000):  # families around sizes at which the number of residues changes
        base = members(size, draw)
        sets += [np.union1d(base[k:], members(1 + size // 40, draw)) for k in range(5)] + [members(size, draw)]
    ids = draw.permutation(len(sets)) + 100
    found = jaccard.alike_by_counts(ids, np.array([len(x) for x in sets]), [jaccard.residue_counts(x) for x in sets], 90)
    place = {int(x): k for k, x in enumerate(ids)}
    assert sorted({place[x] // 6 for e in found for x in e}) == [0, 1, 2] and len(found) == 12
    assert all(place[a] // 6 == place[b] // 6 and place[a] % 6 < 5 and place[b] % 6 < 5 for a, b in found)


def test_chance_makes_no_groups_of_large_sets(spark, monkeypatch):
    """Long texts that share a few rare shingles were one group of candidates, all of whose members met."""
    common = [" ".join(drawn(3)) for _ in range(30)]
    texts = [" ".join([*drawn(5000), *rng.sample(common, 12)]) for _ in range(90)]
    texts += [x + " tail" for x in texts[:4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = {}

    def keeping(df, folder, name):
        return held.setdefault(name, written(df, folder, name))

    monkeypatch.setattr(jaccard, "written", keeping)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert found == {k: k - 90 if k >= 90 else k for k in range(94)}
    assert held["groups"].count() == 8


def test_rows_of_files_are_numbered_where_they_lie(spark, monkeypatch, tmp_path):
    rows = [(k % 7, " ".join(drawn(9)), k) for k in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    held = []
    monkeypatch.setattr(jaccard, "written", lambda df, folder, name: held.append(name) or written(df, folder, name))
    numbered = jaccard.numbered(docs.select("n", "doc_id", "text"))
    assert numbered.columns == ["n", "doc_id", "text", "row"] and not held
    once = {r["row"]: r["n"] for r in numbered.collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # other partitions, the same numbers
        assert {r["row"]: r["n"] for r in numbered.select("row", "n").collect()} == once and len(once) == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    twice = docs.selectExpr("doc_id", "text", "explode(array(1, 2)) AS n")  # rows that aren't a file's
    assert jaccard.numbered(twice).select("row").distinct().count() == 1000 and held == ["numbered"]
