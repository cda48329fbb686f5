"""Each registered query on a small folder of tables, on empty ones and, where it is native, by its plan."""

import zlib

import pandas as pd
import pytest

from ledgerlens.llm import language, queries

from .test_operators import TEXTS, by_id, sentence

CONTRACT = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_quality_classifier": "doc_id held_out expected_grade tail_probability kept",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_sentencepiece": "doc_id text_key place ids text",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_token_counts": "doc_id ordinal start n_tokens closed",
    "op7_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op10_pii": "doc_id text",
    "op11_golay_simhash": "doc_id fingerprint component_id",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_lexical_search": "item_id rank doc_id score",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    texts = [*TEXTS, *(sentence(80) for _ in range(60))]
    docs = [(i, t, "abc"[i % 3] if i % 5 else None, "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id at all", None, "s", 12)]
    labels = [(i, i % 4 != 0 if i % 9 else None, i % 3 == 0 if i % 7 else None) for i in range(len(texts))]
    labels = [(i, *(None if x is None else int(x) for x in rest)) for i, *rest in labels]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, texts[-1]), (1, None), (2, "not a term of any")], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"file://{base}/full/{name}.parquet")
        df.where("false").write.parquet(f"file://{base}/empty/{name}.parquet")
    return f"file://{base}/full", f"file://{base}/empty"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folders, name):
    full, empty = folders
    found = queries.QUERIES[name](spark, full)
    assert set(CONTRACT[name].split()) <= set(found.columns)
    rows = found.toPandas()
    n = len(TEXTS) + 61
    if name == "op13_lexical_search":
        assert set(rows.item_id) <= {0, 2} and rows[rows.item_id == 0]["rank"].tolist() == list(range(1, 51))
        assert queries.QUERIES[name](spark, empty).count() == 0
        return
    if name not in ("op4_sentencepiece", "op8_best_fit_packing"):
        assert len(rows) == n
    assert rows.doc_id.nunique(dropna=False) == n
    divisor, rest = {"op2_quality_classifier": (5, 3), "op3_language_id": (4, 2), "op5_toxicity": (3, 1)}.get(name, (None, None))
    if divisor:
        some = rows[rows.doc_id.notna()]
        assert (some.held_out == [zlib.crc32(str(int(i)).encode()) % divisor == rest for i in some.doc_id]).all()
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op10_pii"])
def test_native_queries_have_no_python(spark, folders, name):
    plan = queries.QUERIES[name](spark, folders[0])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))


def test_letters_and_marks():
    said = {"½ ²": "", "①②": "", "́": "", "हिन्दी": "हिन्दी", "Été 12 x": "été x", "a_b": "a b", "中文 5": "中文", "²a³": "a"}
    assert {t: language.normalised(t) for t in said} == said


def test_held_out_figures(spark):
    """Accuracy of the fitted models on what they didn't see."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (pd.read_parquet(f"{sf}/{t}.parquet").set_index("doc_id") for t in ("documents", "labels"))
    languages = by_id(queries.op3_language_id(spark, sf)).join(docs.lang)
    seen = languages[languages.held_out & languages.lang.notna() & (languages.lang_pred != language.UNDETERMINED)]
    assert (seen.lang == seen.lang_pred).mean() > 0.97
    graded = by_id(queries.op2_quality_classifier(spark, sf)).join(labels, how="inner")
    graded = graded[graded.held_out]
    assert graded[graded.quality == 1].expected_grade.mean() > graded[graded.quality == 0].expected_grade.mean() + 0.5
    toxic = by_id(queries.op5_toxicity(spark, sf)).join(labels, how="inner")
    toxic = toxic[toxic.held_out]
    assert toxic[toxic.toxic == 1].score.mean() > toxic[toxic.toxic == 0].score.mean() + 0.2
