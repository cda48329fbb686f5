"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bit_slices, golay, jaccard, language, media, merkle, oracles, packing, pii, quality_model, sentence_pieces, tokens, toxicity
from ledgerlens.llm.common import bounded_sample, residue, shared_folder, table, written
from ledgerlens.llm.quality_rules import SIGNALS, quality_rules


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents that are labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality_rules(docs, trusted_ids(spark, sf_dir))
    return rated.select("doc_id", *SIGNALS, "base_failed", "kept", "llr")


def labelled_sample(spark: SparkSession, sf_dir: str, held_out: int, divisor: int, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` labelled documents outside the fold that is held out, with their texts.

    The drawn labels are bounded, so they are broadcast and the texts stay where they lie.
    """
    labels = table(spark, sf_dir, "labels").where(residue(F.col("doc_id"), divisor) != held_out)
    drawn = bounded_sample(labels, "doc_id", limit, seed)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings in three grades: 0 poor, 1 well written but toxic, 2 well written and not toxic.

    A fifth of the labels (crc32 of the id modulo 5 is 3) is held out. Kept is what is likely graded 1 or better.
    """
    rated = labelled_sample(spark, sf_dir, 3, 5, quality_model.SAMPLE_LIMIT, seed=2)
    value = F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic"))
    model = quality_model.train(rated.where("quality IS NOT NULL AND toxic IS NOT NULL").withColumn("grade", value), 3)
    found = quality_model.grade(table(spark, sf_dir, "documents").select("doc_id", "text"), model, wanted=1)
    held_out = (residue(F.col("doc_id"), 5) == 3).alias("held_out")
    return found.select("doc_id", held_out, "expected_grade", "tail_probability", "kept")


def language_references(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Reference texts from documents with a language, without the fold that is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.reference_texts(docs.where(residue(F.col("doc_id"), 4) != 2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language.identify(docs, language_references(spark, sf_dir))
    held_out = (residue(F.col("doc_id"), 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "phrases")


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document in blocks, and the text that is decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = sentence_pieces.read_vocabulary(vocabulary_path("piece_bpe_32k.model"))
    return sentence_pieces.encode(docs, vocabulary, with_text=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_sample(spark, sf_dir, 1, 3, toxicity.SAMPLE_LIMIT, seed=5)
    model = toxicity.train(rows.where("toxic IS NOT NULL").withColumn("y", F.col("toxic")))
    found = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.select("doc_id", (residue(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat 16-bit token files, and each document's tokens as the separator scan counts them."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark)
    held = tokens.write_token_files(docs, folder, vocabulary_path("byte_bpe_50k.tiktoken"))
    counted = tokens.count_tokens(spark, folder, held)
    # The table of what the files hold compresses to little, so its size on disk says too little to broadcast it by.
    return held.hint("merge").join(counted, ["path", "ordinal"], "left").select("doc_id", "ordinal", "start", "n_tokens", "closed")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark)
    index = media.with_metadata(media.store(docs, folder), folder)
    return media.with_payload(index, folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bits",
    )


def packed_sequences(docs: DataFrame) -> DataFrame:
    """The packing of the registered query and of the pipeline: ids of the JSON vocabulary, special tokens included."""
    specials = tokens.special_tokens(vocabulary_path("byte_bpe_50k.json"))
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.tiktoken"), specials=specials)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_key(spark: SparkSession) -> str:
    """The secret of the permutations: the session's ``spark.ledgerlens.pii.key``.

    Where it is unset, a random one is drawn for the session: values are then linked within it and not beyond.
    """
    name = "spark.ledgerlens.pii.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark)).select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.prove(merkle.manifest(docs, merkle.tampered(docs)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return bit_slices.search(docs.select("doc_id", "text"), items.select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_media_columns": op7_media_columns,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_pii": op10_pii,
    "op11_golay_simhash": op11_golay_simhash,
    "op12_merkle": op12_merkle,
    "op13_lexical_search": op13_lexical_search,
}

#: Models, packings and xxhash64 have no equal in DuckDB; those queries are tested against brute force.
ORACLES: dict[str, str] = {"op12_merkle": oracles.MERKLE, "op13_lexical_search": oracles.SEARCH}
