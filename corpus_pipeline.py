"""From raw documents to packed sequences, a stage at a time.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; what it decides takes
effect on its result. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard, language, pii
from ledgerlens.llm.common import shared_folder, table, written
from ledgerlens.llm.quality_rules import quality_rules
from ledgerlens.llm.queries import language_references, packed_sequences, pii_key, trusted_ids

#: A document goes if the two best languages' phrase rates differ by less than this share.
MIN_LANGUAGE_SCORE = 0.02


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail a base rule or the likelihood ratio go."""
    return quality_rules(docs, trusted_ids(spark, sf_dir)).where("kept").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter go, and those that no language fits better than another."""
    found = language.identify(docs, language_references(spark, sf_dir))
    told = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(told).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of the rows that links connect, one with the smallest id stays; null ids come last."""
    rows, folder = jaccard.numbered(docs), shared_folder(spark)
    found = written(jaccard.row_components(rows).select("row", "root", "doc_id"), folder, "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = found.groupBy("root").agg(first.alias("s")).select("s.row")
    gone = written(found.select("row").join(kept, "row", "left_anti"), folder, "gone")
    few = gone.count() <= jaccard.BROADCAST_IDS  # then the texts stay where they lie
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: numbers, dates and addresses become pseudonyms; ``n_chars`` is counted anew, as an address's length changes."""
    hidden = pii.pseudonymise(docs, pii_key(spark))
    size = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return hidden.withColumn("n_chars", size).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 2048 tokens."""
    return packed_sequences(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack),
]

#: Cross parsing, keyed permutations and packing can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
