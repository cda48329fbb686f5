"""The streaming source, versions of rules and the delivery of statements: restarts, retries, replays."""

import tempfile
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.operators import eligibility, statements
from ledgerlens.sources import payments, rules
from ledgerlens.streaming.streams import RuleCache

NAMES = "rule_id string, product string, min_credit int, min_income double, max_dti double, min_tenure int, valid_from timestamp, retired boolean"


def test_source_goes_on_from_its_checkpoint(spark):
    payments.register(spark)
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")

    def run(rows: int) -> list[int]:
        source = spark.readStream.format(payments.NAME).option("since", "2024-01-01").option("rowsPerSecond", 50).option("seed", 3)
        source = source.option("rows", rows).option("rowsPerPartition", 400).option("maxRowsPerBatch", 1000).load()
        sizes = []

        def sink(df, batch_id):
            df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
            sizes.append(df.rdd.getNumPartitions())

        writer = source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
        query = writer.trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sizes

    assert run(2500) == [7] and run(4300) == [5]  # 400 rows a task; a new process takes what has come due
    found = spark.read.parquet(f"{folder}/out").drop("batch").orderBy("txn_id").toPandas()
    assert found.txn_id.tolist() == list(range(4300))
    began = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    expected = payments.request_rows(0, 4300, 3, began, 50.0).to_pandas()
    assert (found.amount == expected.amount).all() and (found.merchant_id == expected.merchant_id).all()
    assert (found.ts == expected.ts.dt.tz_localize(None)).all() and found.customer_id.between(0, 99_999).all()
    assert 45_000 < found.amount.mean() < 55_000 and found.merchant_id.nunique() > 2500
    # a span that is read again gives the same rows
    again = payments.request_rows(1000, 1100, 3, began, 50.0).to_pandas()
    assert again.equals(expected.iloc[1000:1100].reset_index(drop=True))


def test_admission_limit():
    reader = payments._Reader({"since": "2024-01-01", "rowspersecond": "50", "rows": "2500", "maxrowsperbatch": "1000", "rowsperpartition": "400"})
    reader.at = 0
    assert [reader.latestOffset()["row"] for _ in range(4)] == [1000, 2000, 2500, 2500]
    assert [(p.first, p.last) for p in reader.partitions({"row": 2000}, {"row": 2500})] == [(2000, 2400), (2400, 2500)]
    assert reader.partitions({"row": 2500}, {"row": 2500}) == []


def requests(spark):
    rows = [(k, datetime(2024, 1, day, hour), 700, 400_000.0, 0.0, 30) for k, (day, hour) in enumerate([(1, 0), (8, 23), (9, 0), (15, 12), (20, 1), (25, 0)])]
    return spark.createDataFrame(rows, "seq long, ts timestamp, credit_score int, annual_income double, outstanding_debt double, tenure_months int")


def test_replays_meet_the_rules_of_their_time(spark):
    path = rules.versions_file(spark)
    cache = RuleCache(lambda: rules.read_versions(spark, path), max_age=0)
    found = {(r.seq, r.rule_id) for r in eligibility.eligible_as_of(requests(spark), cache.get()).collect()}
    # R04 is retired on the 15th and comes back on the 22nd; the others' bounds here change nothing for this profile
    assert {seq for seq, rule in found if rule == "R04"} == {0, 1, 2, 5}
    assert {seq for seq, rule in found if rule == "R01"} == {0, 1, 2, 3, 4, 5}
    # a version for later times leaves earlier requests as they were
    more = spark.createDataFrame([("R01", "PERSONAL_LOAN", 900, 0.0, 1.0, 0, "2024-01-24 00:00:00", False)], NAMES.replace("timestamp", "string"))
    more.coalesce(1).write.mode("append").option("header", True).csv(path)
    after = {(r.seq, r.rule_id) for r in eligibility.eligible_as_of(requests(spark), cache.get()).collect()}
    assert after == found - {(5, "R01")}


def test_two_versions_from_one_moment_raise(spark):
    rows = [("R", "P", 1, 1.0, 1.0, 1, datetime(2024, 1, 1), False)] * 2
    with pytest.raises(ValueError, match="more than one version"):
        eligibility.eligible_as_of(requests(spark), spark.createDataFrame(rows, NAMES))


def texts(spark, n=40, months=("2024-01", "2024-02")):
    return spark.createDataFrame([(f"a{k}", m, f"text {k} {m}") for k in range(n) for m in months], "account_id string, period string, text string")


def held(spark, path):
    return sorted(map(tuple, statements.delivered(spark, path).collect()))


def test_each_statement_is_delivered_once(spark, monkeypatch):
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/s"
    every = sorted(map(tuple, texts(spark).collect()))
    assert held(spark, path) == []

    @F.udf("string")
    def breaks(account, text):
        if account == "a7":
            raise RuntimeError("killed")
        return text

    # a run that dies between its files: some may be there, none counts
    with pytest.raises(PySparkException):
        statements.deliver(texts(spark).repartition(8).withColumn("text", breaks("account_id", "text")), path, 0)
    assert held(spark, path) == []
    # a run that dies after its files and before the manifest
    with monkeypatch.context() as patched:
        patched.setattr(statements, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            statements.deliver(texts(spark), path, 0)
    assert held(spark, path) == []
    assert statements.deliver(texts(spark), path, 0) and held(spark, path) == every
    assert not statements.deliver(texts(spark), path, 0) and held(spark, path) == every
    # another batch with old and new statements delivers the new ones
    assert statements.deliver(texts(spark, 42), path, 1)
    assert held(spark, path) == sorted(map(tuple, texts(spark, 42).collect()))
    assert spark.read.parquet(f"{path}/staged").where("batch_id = 1").count() == 4
    # two runs of a batch at a time are both in the manifest; readers take one
    statements._commit(spark, path, 1, "other", 4)
    texts(spark, 42).write.parquet(f"{path}/staged/batch_id=1/run=other")
    assert held(spark, path) == sorted(map(tuple, texts(spark, 42).collect()))
