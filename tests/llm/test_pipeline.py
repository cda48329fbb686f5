"""The pipeline's stages, one after another, against brute force on the smallest tables."""

import re
import zlib

import numpy as np

import corpus_pipeline
from ledgerlens.llm.common import shared_folder, table
from ledgerlens.llm.queries import op1_quality_rules, op3_language_id, vocabulary_path
from ledgerlens.llm.tokens import TokenCache

from ..conftest import SF_SMALL
from .test_operators import jaccard_truth


def test_stages(spark):
    folder, docs, seen = shared_folder(spark), table(spark, SF_SMALL, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs.toPandas())
        assert k == 4 or docs.columns == columns
    good, known, single, hidden, packed = seen
    kept = op1_quality_rules(spark, SF_SMALL).where("kept").toPandas()
    assert sorted(good.doc_id) == sorted(kept.doc_id)
    languages = op3_language_id(spark, SF_SMALL).where("lang_pred != 'und' AND score >= 0.02").toPandas()
    assert set(known.doc_id) == set(good.doc_id) & set(languages.doc_id)
    roots = jaccard_truth(dict(zip(known.doc_id, known.text)), 3, 90)
    assert sorted(single.doc_id) == sorted(i for i, (_, root) in roots.items() if i == root)
    before, after = single.set_index("doc_id").text, hidden.set_index("doc_id").text
    private = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    for i, text in before.items():
        found = private.findall(text)
        assert not any(x in after[i] for x in found)
        if not re.search(r"[0-9@]", text):
            assert after[i] == text
    cache = TokenCache(vocabulary_path("byte_bpe_50k.tiktoken"))
    for i, pieces in packed.sort_values("piece").groupby("doc_id"):
        ids = np.append(np.frombuffer(cache.encode(after[i]), "<u4"), np.uint32(0)).astype("<u4")
        assert pieces.length.sum() == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces.itertuples())
    assert set(packed.doc_id) == set(after.index) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_null_and_repeated_ids_keep_a_row_of_each_group(spark):
    other, third = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (5, other), (5, other), (5, third), (None, other), (8, third), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    wanted = [(None, "a b c d e f g", "x"), (5, other, "x"), (5, third, "x"), (None, None, "x")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, wanted))


def test_lengths_are_those_of_the_pseudonyms(spark):
    texts = [f"from 10.{k}.0.1 to 1.1.1.{k}" for k in range(9)] + ["plain", None]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    hidden = corpus_pipeline.hide_personal_data(spark, docs, SF_SMALL).toPandas()
    assert hidden.n_chars.tolist() == [len(t or "") for t in hidden.text] and (hidden.n_chars[:9] != docs.toPandas().n_chars[:9]).any()
