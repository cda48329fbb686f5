"""Eligibility rules from a CSV file with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schemas import RULE, RULE_VERSION
from ledgerlens.session import shared_folder

#: Rule id, product, least credit score, least income, largest debt-to-income ratio, least tenure.
RULE_ROWS = (
    ("R01", "PERSONAL_LOAN", 650, 300000, 0.50, 6),
    ("R02", "CREDIT_CARD_PREMIUM", 720, 600000, 0.40, 12),
    ("R03", "CREDIT_CARD_BASIC", 580, 200000, 0.60, 3),
    ("R04", "MUTUAL_FUND_SIP", 600, 400000, 0.45, 12),
    ("R05", "FIXED_DEPOSIT", 0, 50000, 1.00, 0),
    ("R06", "HOME_LOAN", 700, 500000, 0.45, 24),
    ("R07", "CAR_LOAN", 650, 350000, 0.50, 6),
    ("R08", "WEALTH_MANAGEMENT", 750, 2000000, 0.30, 24),
)


#: Changes of rules for the replayed month: the day, the new rule (None: it is retired).
RULE_CHANGES = (
    ("2024-01-09", "R01", ("PERSONAL_LOAN", 690, 350000, 0.45, 6)),
    ("2024-01-12", "R06", ("HOME_LOAN", 740, 500000, 0.40, 24)),
    ("2024-01-15", "R04", None),
    ("2024-01-20", "R01", ("PERSONAL_LOAN", 640, 280000, 0.55, 3)),
    ("2024-01-22", "R04", ("MUTUAL_FUND_SIP", 620, 400000, 0.45, 12)),
)


def version_rows() -> list[tuple]:
    """(rule, from when, retired) of the eight rules and their changes; a retired version keeps no bounds."""
    rows = [(*r, "1970-01-01", False) for r in RULE_ROWS]
    return rows + [(rule, *(bounds or (None,) * 5), day, bounds is None) for day, rule, bounds in RULE_CHANGES]


def read_rules(spark: SparkSession, path: str, schema: str = RULE) -> DataFrame:
    """Rules with declared types; a line that doesn't parse raises instead of giving an empty list."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def rules_file(spark: SparkSession) -> DataFrame:
    """The eight rules by way of a CSV file in the session's shared folder."""
    path = f"{shared_folder(spark)}/rules"
    standard_rules(spark).coalesce(1).write.option("header", True).csv(path)
    return read_rules(spark, path)


def standard_rules(spark: SparkSession) -> DataFrame:
    """The eight rules above."""
    return spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in RULE_ROWS], RULE)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Versions of rules: each rule's bounds from a moment on, or that it is retired from then on."""
    return read_rules(spark, path, RULE_VERSION)


def versions_file(spark: SparkSession) -> str:
    """The versions above as a CSV file in the session's shared folder; its path."""
    path = f"{shared_folder(spark)}/rule-versions"
    rows = [(*r[:3], None if r[3] is None else float(r[3]), *r[4:]) for r in version_rows()]
    names = "rule_id string, product string, min_credit int, min_income double, max_dti double, min_tenure int, valid_from string, retired boolean"
    spark.createDataFrame(rows, names).coalesce(1).write.option("header", True).csv(path)
    return path
