"""Golay near-duplicates, hash trees and bit-sliced search against brute force and against SQL."""

import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import bit_slices, golay, merkle, queries

from ..conftest import SF_TEST
from ..duck import connection, same_rows

WORDS = [f"w{k}" for k in range(400)] + ["É", "ßtraße", "中文", "don't", "a1", "I", "x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int, part int, tree string"


def corpus(seed: int = 3, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([3, 40, 120]))) for _ in range(n)]
    for k in range(0, n, 4):  # near copies
        words = texts[k].split()
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [None, "", " \t\n", "one", "A b", "x " * 30_000, texts[0].upper(), texts[1], texts[1], texts[1], "\x0b\x0c", "ı İ  z"]
    langs = [None, "en", "é", "zz", "=", "-"]
    rows = [(i, t, langs[i % 7 % 6], "s" if i % 3 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s", 3), (None, texts[2], "en", "s", 3), (5, texts[5], langs[5], "s", 9), (5, "another", None, None, None)]
    return [(*r, "clash", 1, 2, "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def in_duck(sql: str, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df)
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return exact(con.sql(sql).df())


def exact(df: pd.DataFrame) -> pd.DataFrame:
    """Ids as whole numbers or None."""
    df = df.astype({c: "Int64" for c in df.columns if c.endswith("_id")}).astype(object)
    return df.where(df.notna(), None)


def pandas_rows() -> pd.DataFrame:
    df = pd.DataFrame([r[:5] for r in corpus()], columns="doc_id text lang source n_chars".split())
    return df.astype({"doc_id": "Int64", "n_chars": "Int64"})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    same_rows(queries.QUERIES[name](spark, SF_TEST).toPandas(), connection(SF_TEST).sql(queries.ORACLES[name]).df())


# Golay near-duplicates


def test_code_is_perfect_and_keys_find_all_within_four_bits():
    table = golay.codewords()
    assert (np.bincount(table) == 2048).all()
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, k % 5, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)

    def by_key(fps):
        out = [{} for _ in fps]
        for key, own, k in zip(*(x.tolist() for x in golay.keys_of(fps)), strict=True):
            out[k][key] = own or out[k].get(key, False)
        return out

    for left, right in zip(by_key(a), by_key(b), strict=True):
        assert any(left[key] or right[key] for key in left.keys() & right.keys())


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lowered) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: np.ndarray) -> np.ndarray:
    """The place of the first fingerprint of each one's component."""
    first = np.arange(len(fps))
    while True:
        after = np.array([first[np.bitwise_count(fps ^ x) <= 4].min() for x in fps])
        if (after == first).all():
            return first
        first = after


def expected_components(rows: list[tuple]) -> list[tuple]:
    fps = np.array([plain_fingerprint(r[1]) for r in rows], np.uint64)
    first = plain_components(fps)
    least = {f: min((r[0] for r, g in zip(rows, first, strict=True) if g == f and r[0] is not None), default=None) for f in set(first)}
    return sorted(((r[0], f"{int(x):016x}", least[f]) for r, x, f in zip(rows, fps, first, strict=True)), key=repr)


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bucket", [8192, 2])
def test_near_duplicates_are_those_of_brute_force(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(golay, "BUCKET", bucket)
    monkeypatch.setattr(golay, "SMALL_BUCKET", min(golay.SMALL_BUCKET, bucket))
    assert plain(golay.near_duplicates(docs)) == expected_components(corpus())


def test_links_of_buckets_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(11)
    fps = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    family = [fps[0]]
    for _ in range(300):  # a chain of families, many in one bucket
        family.append(family[rng.integers(len(family))] ^ (np.uint64(1) << np.uint64(rng.integers(64))))
    fps = np.unique(np.concatenate([fps, family]))
    key, own, which = golay.keys_of(fps)
    rows = pd.DataFrame({"key": key, "own": own, "fp": fps[which].view(np.int64)})
    first = plain_components(fps)
    for bucket in (8192, 50):
        found = golay_links(spark, rows, bucket)
        up = {int(x): int(x) for x in fps.view(np.int64)}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in found:
            assert int(np.bitwise_count(np.array([a], np.int64).view(np.uint64) ^ np.array([b], np.int64).view(np.uint64))[0]) <= 4
            up[max(root(a), root(b))] = min(root(a), root(b))
        assert len({root(x) for x in up}) == len(set(first))


def golay_links(spark, rows, bucket) -> list[tuple[int, int]]:
    was, golay.BUCKET = golay.BUCKET, bucket
    try:
        found = golay.bucket_links(spark.createDataFrame(rows).repartition(4)).distinct().collect()
    finally:
        golay.BUCKET = was
    links = [(r.a, r.b) for r in found if r.b is not None]
    crowded = [(r.a,) for r in found if r.b is None]
    assert bool(crowded) == (bucket < 8192)
    if crowded:
        points = golay.linked_by_points(spark.createDataFrame(crowded, "fp long"))
        by_point = [(r.a, r.b) for r in points.distinct().collect()]
        # two that share a point within two bits of both are within four of each other
        links += by_point
    return links


# Hash trees


def test_manifest_and_proofs_against_sql(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES_A_PARTITION", 40)
    found = merkle.prove(merkle.manifest(docs, merkle.tampered(docs))).toPandas()
    sql = queries.ORACLES["op12_merkle"]
    same_rows(exact(found), in_duck(sql, documents=pandas_rows()))
    assert found.verified.any() and not found.verified.all() and found.root.nunique() == 1


def test_some_rows_are_proved_as_all_are(spark, docs):
    made = merkle.manifest(docs)
    every = merkle.prove(made).toPandas().set_index("leaf")
    some = merkle.prove(made, made.trees.rows.where("idx % 5 = 2")).toPandas().set_index("leaf")
    assert 0 < len(some) < len(every) and some.verified.all()
    for h, row in some.iterrows():
        assert row.proof_sha256 in set(every.loc[[h]].proof_sha256)


def test_coordinates_are_the_fewest_that_suffice():
    rng = random.Random(2)
    for n in (1, 2, 8, 9, 64, 65, 700):
        levels = [[sha256(str(i).encode()).hexdigest() for i in range(n)]]
        while len(levels[-1]) > 1:
            levels.append([sha256("".join(levels[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(levels[-1]), 8)])
        for k in {1, max(1, n // 3), n}:
            known = rng.sample(range(n), k)
            wanted = merkle.missing(known, n)
            below = {(0, i) for i in known}  # what the leaves give: no coordinate may be among them
            for level in range(len(levels)):
                below |= {(level, i // 8**level) for i in known}
            assert not set(wanted) & below and len(set(wanted)) == len(wanted)
            paths = merkle.Paths({i: levels[0][i] for i in known}, {c: levels[c[0]][c[1]] for c in wanted}, n)
            assert paths.root == levels[-1][0]
            assert all(merkle.fold(levels[0][i], paths.siblings(i)) == paths.root for i in known)
            for c in wanted[:3]:
                with pytest.raises(KeyError):
                    merkle.Paths({i: levels[0][i] for i in known}, {w: levels[w[0]][w[1]] for w in wanted if w != c}, n)


# Ranked search


ITEMS = [(7, "w1 w2 W3 w4"), (8, "É 中文 don't"), (8, "É 中文 don't"), (None, "x"), (9, None), (10, ""), (11, "nowhere"), (12, " ".join(WORDS))]


@pytest.mark.parametrize("limits", [(1024, 1_000_000), (3, 0)])
def test_search_against_sql(spark, docs, monkeypatch, limits):
    """In one pass and in several; with pairs sent to all tasks and with a shuffle."""
    monkeypatch.setattr(bit_slices, "ITEMS_A_PASS", limits[0])
    monkeypatch.setattr(bit_slices, "BROADCAST_PAIRS", limits[1])
    items = spark.createDataFrame([(*r, "clash", 1) for r in ITEMS], "item_id long, text string, score string, rank int")
    found = bit_slices.search(docs, items).toPandas()
    asked = pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"})
    same_rows(exact(found), in_duck(queries.ORACLES["op13_lexical_search"], documents=pandas_rows(), benchmark=asked))
    assert not set(found.item_id.dropna()) & {9, 10, 11}


def test_bounds_are_never_below_scores(spark, docs, tmp_path):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    held = bit_slices.index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), f"file://{tmp_path}")
    blocks = held.where("slices IS NOT NULL").collect()
    totals = bit_slices.Totals(sum(b.with_terms for b in blocks), sum(b.occurrences for b in blocks))
    df = {r.term.encode(): r.df for r in held.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    wanted = [(q, {t: totals.weight(df[t]) for t in set(bit_slices.terms_of(text)) if t in df}) for q, (_, text) in enumerate(ITEMS)]
    asked, tight, count = bit_slices.Items(wanted), 0, 0
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(bit_slices.terms_of(t))
    for b in blocks:
        sizes = np.frombuffer(b.sizes, np.int64)
        bounds = asked.bounds(b.width, sizes, np.frombuffer(b.slices, np.uint8).reshape(b.width, -1), totals)
        for slot, doc in enumerate(b.doc_ids):
            terms = next(t for t in by_id[doc] if len(t) == sizes[slot])
            m = totals.damping(len(terms))
            for k, (_, weights) in enumerate(wanted):
                true = sum(w * bit_slices.saturated(terms.count(t), m) for t, w in weights.items() if t in terms)
                assert bounds[k, slot] >= true
                tight, count = tight + (bounds[k, slot] <= 1.2 * true), count + 1
    assert tight > 0.8 * count
