"""What the pipeline's stage of the n-gram join keeps on disk: texts stay where they lie."""

import random

import corpus_pipeline

rng = random.Random(22)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]


def test_a_stage_doesn_t_shuffle_its_texts(spark, tmp_path):
    texts = [" ".join(rng.choices(WORDS, k=30)) for _ in range(60)]
    rows = [(k, texts[k % 40 if k >= 60 else k], "en", "src", 1) for k in range(80)] + [(None, texts[50], "en", "src", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60)) and kept.columns == docs.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan
