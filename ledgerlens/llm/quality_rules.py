"""Quality rules: base counts of a text and the log-likelihood ratio of its hashed n-grams.

The words and the pairs of neighbouring words of a text are hashed into a fixed number of buckets.
Two multinomials over the buckets are estimated, one from documents that are trusted and one from
the whole corpus, and a text scores the mean over its n-grams of ``log(p_trusted / p_corpus)``.
Bucket weights are whole millionths of a nat, so a score doesn't depend on the order of summation
and thresholding is deterministic.

Everything is a DataFrame expression, and all documents count: every trusted one on one side, every one on the
other. The corpus is counted where it lies (a partial aggregation leaves one row a bucket and task), the weights are
one array of ``buckets`` numbers, and scoring is a projection. No text moves while a million trusted ids or fewer are
broadcast; beyond that, only the texts that a filter over the ids lets pass are shuffled, which are the trusted ones and
few others.

Defined results: null and empty texts have no words, all counts 0 and fail the base rules. A corpus
without trusted documents gives every bucket the weight 0, so every score is 0. An empty table gives an empty one. Repeated rows count
as often as they occur and get equal verdicts. Other columns pass through; a column named as one of
the results gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, shared_folder, words_of, written

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Pseudo-count of every bucket, in trusted n-grams: a bucket of which fewer are there, or would be, says little either way.
SMOOTHING = 8.0
#: Texts under this many words fail.
MIN_WORDS = 50
#: Texts with more than this percentage of their words in repeated windows of three fail.
MAX_REPEAT_PERCENT = 50
#: A text fails if its mean n-gram is less than 0.9 times as likely in trusted text as in the corpus (ln 0.9).
MIN_LLR = -0.105361
#: Up to so many trusted ids are broadcast, some 32 MB of them.
BROADCAST_IDS = 1_000_000
#: Numbers of 64 bits in the filter for more ids, at most: 8 MB.
FILTER_WORDS = 1 << 20

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(words: Column) -> Column:
    """A hash for each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _and_next(hashes: Column, following: Column) -> Column:
    """A hash for each place of both: of what stands there in the one and in the other."""
    return F.zip_with(hashes, following, lambda x, y: F.xxhash64(x, y))


def _pairs(hashes: Column) -> Column:
    """A hash for each word but the last, with the next one, of the words' hashes."""
    rest = F.greatest(F.size(hashes) - 1, F.lit(0))
    return _and_next(F.slice(hashes, 1, rest), F.slice(hashes, 2, rest))


def _windows(hashes: Column, pairs: Column) -> Column:
    """A hash for each run of three words, of the words' hashes and those of their pairs."""
    rest = F.greatest(F.size(hashes) - 2, F.lit(0))
    return _and_next(F.slice(pairs, 1, rest), F.slice(hashes, 3, rest))


def _in_order(windows: Column) -> Column:
    """(hash, place) of each window by hash, where two windows are equal; else null."""
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(pairs))


def _repeat_words(ordered: Column) -> Column:
    """Words in windows that occur twice or more in the text, the first included."""
    n = F.size(ordered)
    equal = F.zip_with(F.slice(ordered, 1, n - 1), F.slice(ordered, 2, n), lambda x, y: x["h"] == y["h"])

    def starts(equal: Column) -> Column:
        later = F.concat(F.array(F.lit(False)), equal)  # equal to the one before
        former = F.concat(equal, F.array(F.lit(False)))  # equal to the one after
        repeated = F.zip_with(ordered, F.zip_with(later, former, lambda x, y: x | y), lambda w, r: F.when(r, w["i"]))
        return F.array_compact(repeated)

    words = F.flatten(F.transform(let(equal, starts), lambda p: F.array(p, p + 1, p + 2)))
    return F.when(ordered.isNull(), 0).otherwise(F.size(F.array_distinct(words))).cast("long")


def _bucket(gram: Column, buckets: int) -> Column:
    """The bucket of an n-gram's hash."""
    return gram.bitwiseAND(F.lit(buckets - 1).cast("long"))


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _word_and_mask(key: Column, words: int) -> tuple[Column, Column]:
    """The place among ``words`` numbers, a power of two, and the three bits in it that stand for a key."""
    h = F.xxhash64(key.cast("string"))
    bits = (F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int") for at in (46, 52, 58))
    first, second, third = (F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in bits)
    return h.bitwiseAND(F.lit(words - 1)).cast("int"), first.bitwiseOR(second).bitwiseOR(third)


def _may_be_among(ids: DataFrame, n_ids: int) -> Column:
    """Whether a row's ``doc_id`` may be one of ``ids``: true for all that are, false for nearly all others.

    Sixteen bits an id, up to a filter of ``FILTER_WORDS`` numbers; more ids than that fill it up and let more others pass.
    """
    words = min(FILTER_WORDS, 1 << max(0, n_ids // 4).bit_length())
    place, mask = _word_and_mask(F.col("doc_id"), words)
    set_bits = ids.select(place.alias("place"), mask.alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("mask"))
    full = ids.sparkSession.range(words).select(F.col("id").cast("int").alias("place")).join(set_bits, "place", "left")
    rows = F.array_sort(F.collect_list(F.struct("place", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    bits = full.agg(F.transform(rows, lambda x: x["mask"]).alias("bits")).scalar()
    return F.coalesce(F.get(bits, place).bitwiseAND(mask) == mask, F.lit(False))


def _flagged(docs: DataFrame, ids: DataFrame, n_ids: int, broadcast_ids: int) -> DataFrame:
    """``docs`` with ``_trusted``: 1 for those whose id is among ``ids``, else 0.

    Up to ``broadcast_ids`` ids are sent to every task. Of more, a filter of bounded size tells the documents that may
    be trusted, and only these are shuffled to meet their ids; all other texts stay where they lie.
    """
    flags = ids.withColumn("_trusted", F.lit(1))
    flag = F.coalesce("_trusted", F.lit(0)).alias("_trusted")
    if n_ids <= broadcast_ids:
        return docs.join(F.broadcast(flags), "doc_id", "left").select(*docs.columns, flag)
    likely = _may_be_among(ids, n_ids)
    met = docs.where(likely).join(flags.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, flag)
    return met.unionByName(docs.where(~likely).withColumn("_trusted", F.lit(0)))


def _bucket_weights(flagged: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """``(place, weight)``, ``weight`` in millionths of a nat: the buckets for other documents, then for trusted ones.

    An n-gram isn't evidence for itself: the occurrence that is weighed is taken out of the corpus, and for a
    trusted document out of the trusted text too. A bucket's trusted n-grams are held against those that it would
    have if trusted text were like the corpus, both with one pseudo-count. So a weight depends on how much trusted
    text there is to tell, not on the size of the corpus, and an n-gram that occurs nowhere else weighs nothing.
    """
    counts = (
        flagged.select("_trusted", _hashes(words_of(F.col("text"))).alias("_hashes"))
        # Generated code pairs the words up and hashes the pairs; a function over an array would be interpreted.
        .select("_trusted", F.inline(F.arrays_zip(F.col("_hashes").alias("a"), F.slice("_hashes", 2, F.greatest(F.size("_hashes"), F.lit(1))).alias("b"))).alias("a", "b"))
        .select("_trusted", F.explode(F.array("a", F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))).alias("gram"))
        .where("gram IS NOT NULL")
        .groupBy(_bucket(F.col("gram"), buckets).alias("bucket"))
        .agg(F.sum("_trusted").alias("t"), F.count("*").alias("r"))
    )
    spark = flagged.sparkSession
    counts = written(counts, shared_folder(spark), "ngram_counts")  # a row a bucket; the corpus is counted once
    nt, nr = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    share = nt / max(1, nr) or 1.0
    full = spark.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    full = full.select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))

    def weight(own: int):
        t, r = (F.greatest(F.col(c) - k, F.lit(0)) for c, k in (("t", own), ("r", 1)))
        ratio = F.log((t + smoothing) / (r * share + smoothing))
        return F.when(F.lit(nt == 0), 0).otherwise(F.round(ratio * 1e6)).cast("long")

    return full.select(F.col("bucket").alias("place"), weight(0).alias("weight")).unionByName(
        full.select((F.col("bucket") + buckets).alias("place"), weight(1).alias("weight"))
    )


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    min_llr: float = MIN_LLR,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``llr`` and ``kept``."""
    ids = trusted_ids.where("doc_id IS NOT NULL").select("doc_id").distinct()
    ids = written(ids, shared_folder(docs.sparkSession), "trusted_ids")  # made once, read for the counts and for the scores
    n_ids = ids.count()
    weights = _bucket_weights(_flagged(docs.select("doc_id", "text"), ids, n_ids, broadcast_ids), buckets, smoothing)
    array = weights.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "weight"))), lambda x: x["weight"]).alias("w")
    ).scalar()
    results = [*SIGNALS, "base_failed", "llr", "kept"]
    rest = [c for c in docs.columns if c not in results]
    counted = (
        _flagged(docs.select(*rest), ids, n_ids, broadcast_ids)
        .withColumn("_words", words_of(F.col("text")))
        .withColumn("_hashes", _hashes(F.col("_words")))
        .withColumn("_pairs", _pairs(F.col("_hashes")))
        .withColumn("_ordered", let(_windows(F.col("_hashes"), F.col("_pairs")), _in_order))
        .withColumn("_grams", F.concat("_hashes", "_pairs"))
        .select(
            *rest,
            F.size("_words").cast("long").alias("n_words"),
            F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _dup_lines(F.coalesce("text", F.lit(""))).alias("n_dup_lines"),
            _repeat_words(F.col("_ordered")).alias("n_repeat_words"),
            F.size("_grams").alias("_n"),
            "_grams",
            (F.col("_trusted") * buckets).alias("_offset"),
        )
        # The weights are named once, in the projection right below, so that they are never copied into rows.
        .select("*", array.alias("_weights"))
        .select(
            *rest,
            *SIGNALS,
            "_n",
            F.aggregate(
                "_grams",
                F.lit(0).cast("long"),
                lambda acc, g: acc + F.get(F.col("_weights"), _bucket(g, buckets).cast("int") + F.col("_offset")),
            ).alias("_sum"),
            # Not deterministic, so that a filter on the results stays above the projections: pushed below, it
            # would repeat each of them for every element that the next one looks at.
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("_n") == 0, 0.0).otherwise(F.round(F.col("_sum") / F.greatest("_n", F.lit(1)) / 1e6, 6))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("llr", llr)
        .select(*rest, *SIGNALS, "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= min_llr) & (F.col("_row") >= 0)).alias("kept"))
    )
