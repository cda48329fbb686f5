"""The events file replayed as a stream; each query returns what its sink holds at the end."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.eligibility import eligible_as_of
from ledgerlens.operators.ordering import positions
from ledgerlens.plans.views import view, view_of
from ledgerlens.schemas import EVENT
from ledgerlens.session import shared_folder
from ledgerlens.sources.rules import read_versions, standard_rules, versions_file
from ledgerlens.streaming import streams

#: The file covers a month; nothing in it is late.
DELAY = "40 days"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.file_stream(spark, f"{sf_dir}/event[s].parquet", EVENT)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def replay(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there; the rows of all micro-batches with ``batch_id``.

    A micro-batch overwrites its own folder, so one that is run again counts once.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "replay")

    def sink(rows: DataFrame, batch_id: int) -> None:
        rows = each(rows, batch_id) if each else rows
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        writer = df.writeStream.outputMode(mode).foreachBatch(sink).trigger(availableNow=True)
        writer.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.parquet(f"{folder}/rows")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key of an update stream."""
    last = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "batch_id")


def traffic_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = streams.traffic_metrics(_events(spark, sf_dir), F.col("value") < 400, DELAY)
    return latest(replay(counted, "update"), "window_us")


def debit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = view_of(spark, "v_debit_requests", {"events": _events(spark, sf_dir)})
    return replay(streams.debit_ledger_stream(requests)).drop("batch_id")


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view_of(spark, "v_breaker_calls", {"events": _events(spark, sf_dir)})
    return replay(streams.breaker_stream(calls, 3, timedelta(hours=2))).drop("batch_id")


def rate_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view_of(spark, "v_breaker_calls", {"events": _events(spark, sf_dir)})
    told = replay(streams.rate_breaker_stream(calls, "1 day", timedelta(hours=2))).drop("batch_id")
    return told.withColumn("seq", F.coalesce("seq", F.lit(-1)))


def sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view_of(spark, "v_latency", {"events": _events(spark, sf_dir)})
    counted = replay(streams.sla_monitor(samples, 200, DELAY, "1 day"), "update")
    return latest(counted, "window_us", "endpoint").select("window_us", "endpoint", "n", "breaches", "p99", "breached")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = view_of(spark, "v_debit_requests", {"events": _events(spark, sf_dir)})
    return replay(streams.dedup_stream(requests, DELAY).select("request_id")).select("request_id")


def _asked(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Events as requests ``(seq, ts, profile ...)`` of the customers in turn."""
    profiles = view(spark, sf_dir, "v_profiles")
    size, slots = profiles.count(), positions(profiles, "customer_key")

    def of(events: DataFrame) -> DataFrame:
        asked = events.select(F.col("event_id").alias("seq"), "ts", F.pmod("event_id", F.lit(max(1, size))).alias("position"))
        return asked.join(slots, "position")

    return of


def rules_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch reads the versions from their CSV file again, and each request meets the rules of its own time."""
    path, asked = versions_file(spark), _asked(spark, sf_dir)
    cache = streams.RuleCache(lambda: read_versions(spark, path), max_age=0)

    def scored(events: DataFrame, _batch_id: int) -> DataFrame:
        return eligible_as_of(asked(events), cache.get()).select("seq", "rule_id")

    return replay(_events(spark, sf_dir), each=scored).drop("batch_id")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, cache = _asked(spark, sf_dir), streams.RuleCache(lambda: standard_rules(spark))

    def scored(events: DataFrame, _batch_id: int) -> DataFrame:
        mine = asked(events).withColumn("customer_key", F.col("seq"))
        return streams.eligible_products(mine, cache.get()).select(F.col("customer_key").alias("seq"), "rule_id")

    return replay(_events(spark, sf_dir), each=scored).drop("batch_id")
