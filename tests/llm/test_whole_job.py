"""Rows, terms and languages that a shortcut would lose; its own random numbers leave the other tests' as they are."""

import random

from ledgerlens.llm import jaccard, language
from ledgerlens.llm.common import shared_folder, written

from .test_operators import by_id

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefgéñß") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def sentence(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = sentence(120)


def test_language_references_are_independent(spark):
    own = {lang: ["".join(rng.choice(signs) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, signs in (("a", "abcdeilnorst"), ("b", "aeghiknostuvz"))}
    rows = [(" ".join(rng.choice(words) for _ in range(200)), lang) for lang, words in own.items() for _ in range(60 if lang == "a" else 3)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    wanted = language.reference_texts(labelled)
    rare = spark.createDataFrame([("a single short text of a mistyped language", "A")], "text string, lang string")
    assert language.reference_texts(labelled.unionByName(rare)) == wanted and len(wanted["a"]) == language.REFERENCE_CHARS
    assert language.LEAST_CHARS <= len(wanted["b"]) < 2000
    assert list(language.reference_texts(rare)) == ["A"]  # nothing else to compare with
    # a short reference is told from a long one, and the end of a long text can be drawn
    new = [(k, " ".join(rng.choice(own[lang]) for _ in range(60))) for k, lang in enumerate("ab" * 20)]
    found = by_id(language.identify(spark.createDataFrame(new, "doc_id long, text string"), wanted))
    assert found.lang_pred.tolist() == list("ab" * 20)
    ends = spark.createDataFrame([("x" * 5000 + " " + str(k) + "y" * 5000, "a") for k in range(40)], "text string, lang string")
    assert "y" in language.reference_texts(ends)["a"]


def test_jaccard_of_null_and_repeated_ids(spark):
    other = sentence(130)
    near, tail = BASE + " tail", other + " tail"
    rows = [(None, BASE), (4, near), (9, other), (9, sentence(90)), (9, BASE), (None, sentence(80)), (2, tail), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()]
    links = [(None, 4), (4, 4), (9, 4), (9, 2), (2, 2), (9, 9), (None, None), (None, None), (7, 7)]
    assert sorted(map(str, found)) == sorted(map(str, links))


def test_connecting_reads_edges_a_bounded_number_of_times(spark, monkeypatch):
    """One long chain among many pairs takes rounds of its own: the pairs' edges aren't read again in each."""
    draw = random.Random(9)
    chain = draw.sample(range(10**6, 2 * 10**6), 3000)
    edges = [(2 * k, 2 * k + 1) for k in range(3000)] + list(zip(chain, chain[1:]))
    edges += [(5 * 10**6 + k, 5 * 10**6 + j) for k in range(30) for j in range(k)] + [(7, 7)]
    held = []
    monkeypatch.setattr(jaccard, "written", lambda df, folder, name: held.append(written(df, folder, name)) or held[-1])
    folder = shared_folder(spark)
    found = {r["id"]: r["root"] for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long"), folder, "x").collect()}
    truth = {x: min(e) for e in edges[:3000] for x in e} | {x: min(chain) for x in chain}
    assert found == truth | {5 * 10**6 + k: 5 * 10**6 for k in range(30)}
    assert sum(df.count() for df in held) < 8 * len(edges)
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert jaccard.connected(none, folder, "none").count() == 0
