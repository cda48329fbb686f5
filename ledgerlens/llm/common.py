"""What the operators of this subpackage share: tables, scratch tables, samples, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    Where that setting is absent, a local session gets a temporary folder; on a cluster executors wouldn't see one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerlens-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table in a shared folder: its lineage is cut and lost executors cost nothing."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def fetched(df: DataFrame) -> pd.DataFrame:
    """A small bounded table on the driver, by way of Arrow whatever the session's setting."""
    return df.toArrow().to_pandas()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def residue(key: Column, divisor: int) -> Column:
    """crc32 of a key's decimal text, modulo ``divisor``: how folds are dealt."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def bounded_sample(df: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows: those whose keyed hash is smallest, whatever the partitioning.

    A count first sets a hash cut-off that leaves about twice the limit, so the exact cut that
    follows sorts a bounded number of rows however large the input is. Rows with a null key go.
    """
    hashed = df.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    total = hashed.count()
    if total > 2 * limit:
        cut = 2.0 * limit / total + 4.0 / limit
        hashed = hashed.where(F.pmod(F.col("_h"), F.lit(1 << 20)) < int(cut * (1 << 20)))
    return hashed.orderBy("_h", key).limit(limit).drop("_h")
