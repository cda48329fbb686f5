"""Product rules joined to customer profiles, and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, text
from ledgerlens.operators.ordering import positions

#: Which products of the rules set each flag.
FLAGS = {
    "loan": ("PERSONAL_LOAN",),
    "card": ("CREDIT_CARD_PREMIUM", "CREDIT_CARD_BASIC"),
    "fund": ("MUTUAL_FUND_SIP",),
    "deposit": ("FIXED_DEPOSIT",),
}
#: What each recommendation says after its product.
LOAN, CARD = "PERSONAL_LOAN: Pre-approved up to ₹", ": Instant approval"
FUND, DEPOSIT = "MUTUAL_FUND_SIP: Starting ₹500/month", "FIXED_DEPOSIT: 7.1% p.a. for 1 year"
WEALTH = "WEALTH_MANAGEMENT: Dedicated RM assigned"
#: Rule tables up to this many rows are broadcast.
RULE_LIMIT = 10_000


def scored(profiles: DataFrame) -> DataFrame:
    """Debt-to-income ratio, risk and propensity."""
    ratio = scoring.dti(F.col("outstanding_debt"), F.col("annual_income"))
    return profiles.withColumn("dti", ratio).withColumns(
        {
            "risk": scoring.risk_score(F.col("dti"), F.col("credit_score"), F.col("tenure_months")),
            "propensity": scoring.propensity_score(F.col("current_balance"), F.col("tenure_months"), F.col("segment")),
        }
    )


def _checked(rules: DataFrame) -> DataFrame:
    """A rule table is small by nature; its size is checked before it is sent to every task."""
    if len(rules.head(RULE_LIMIT + 1)) > RULE_LIMIT:
        raise ValueError(f"more than {RULE_LIMIT} rules")
    return rules


def eligible_products(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """``(customer_key, rule_id, product)`` for every rule whose four bounds a profile meets, bounds included."""
    rules = _checked(rules)
    p = profiles.withColumn("_dti", scoring.dti(F.col("outstanding_debt"), F.col("annual_income")))
    meets = (
        (p["credit_score"] >= rules["min_credit"])
        & (p["annual_income"] >= rules["min_income"])
        & (p["_dti"] <= rules["max_dti"])
        & (p["tenure_months"] >= rules["min_tenure"])
    )
    return p.join(F.broadcast(rules), meets).select("customer_key", "rule_id", "product")


def rules_over_time(versions: DataFrame) -> DataFrame:
    """Versions with ``valid_to``, when the rule's next version begins; retired ones end the one before and go."""
    repeated = versions.groupBy("rule_id", "valid_from").count().where("count > 1").head()
    if repeated:
        raise ValueError(f"rule {repeated['rule_id']} has more than one version from {repeated['valid_from']} on")
    following = F.lead("valid_from").over(Window.partitionBy("rule_id").orderBy("valid_from"))
    return versions.withColumn("valid_to", following).where(~F.coalesce("retired", F.lit(False)))


def eligible_as_of(requests: DataFrame, versions: DataFrame, key: str = "seq") -> DataFrame:
    """``(key, rule_id, product)`` for every rule that a request's profile met as the rule was at the request's ``ts``.

    So a replayed request gives the same rows whatever versions have been added since for later times.
    """
    rules = rules_over_time(_checked(versions))
    p = requests.withColumn("_dti", scoring.dti(F.col("outstanding_debt"), F.col("annual_income")))
    then = (p["ts"] >= rules["valid_from"]) & (rules["valid_to"].isNull() | (p["ts"] < rules["valid_to"]))
    meets = (
        (p["credit_score"] >= rules["min_credit"])
        & (p["annual_income"] >= rules["min_income"])
        & (p["_dti"] <= rules["max_dti"])
        & (p["tenure_months"] >= rules["min_tenure"])
    )
    return p.join(F.broadcast(rules), then & meets).select(key, "rule_id", "product")


def flagged(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """``profiles`` with one boolean a flag: a projection over the rules as one array, so no profile is moved."""
    bounds = F.collect_list(F.struct("product", "min_credit", "min_income", "max_dti", "min_tenure"))
    dti = scoring.dti(F.col("outstanding_debt"), F.col("annual_income"))
    met = F.filter(
        "_rules",
        lambda r: (F.col("credit_score") >= r["min_credit"])
        & (F.col("annual_income") >= r["min_income"])
        & (dti <= r["max_dti"])
        & (F.col("tenure_months") >= r["min_tenure"]),
    )
    held = profiles.withColumn("_rules", _checked(rules).agg(bounds).scalar())
    held = held.withColumn("_products", F.transform(met, lambda r: r["product"])).drop("_rules")
    flags = {name: F.arrays_overlap("_products", F.array(*map(F.lit, products))) for name, products in FLAGS.items()}
    return held.withColumns(flags).drop("_products")


def eligibility_flags(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """One boolean a flag for every profile; profiles without a rule have none set."""
    return flagged(profiles, rules).select("customer_key", *FLAGS)


def recommendation_list() -> Column:
    """The recommendations of a scored and flagged profile, in order."""
    loan = F.concat(F.lit(LOAN), text.grouped(0.3 * F.col("annual_income")))
    card = F.when(F.col("credit_score") >= 720, "CREDIT_CARD_PREMIUM" + CARD).otherwise("CREDIT_CARD_BASIC" + CARD)
    return F.array_compact(
        F.array(
            F.when(F.col("loan") & (F.col("risk") < 0.6), loan),
            F.when(F.col("card"), card),
            F.when(F.col("fund") & (F.col("propensity") > 0.5), FUND),
            F.when(F.col("deposit"), DEPOSIT),
            F.when(F.col("segment").isin("WEALTH", "PREMIER"), WEALTH),
        )
    )


def recommendations(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """Scores and recommendations of every profile."""
    return flagged(scored(profiles), rules).select("customer_key", "risk", "propensity", recommendation_list().alias("products"))


def assign_round_robin(requests: DataFrame, dimension: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Requests joined to dimension rows in turn: request n goes to row n modulo the dimension's size."""
    size = dimension.count()
    dense = positions(dimension.select(key), key).withColumnRenamed("position", "_slot")
    return requests.withColumn("_slot", F.pmod(F.col(seq), F.lit(max(1, size)))).join(dense, "_slot").drop("_slot")
