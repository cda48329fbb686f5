"""Balances and debits: running sums, retries that count once, and overdrafts that are refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.folds import sorted_fold
from ledgerlens.operators.ranges import ROWS_A_RANGE, in_ranges, written
from ledgerlens.session import shared_folder

APPLIED, DUPLICATE, INSUFFICIENT, UNKNOWN = "APPLIED", "DUPLICATE", "INSUFFICIENT", "UNKNOWN_ACCOUNT"
LEDGER = "seq long, status string, balance_cents long"


def running_balance(df: DataFrame, opening_cents: int, credit: Column, order: list[str]) -> DataFrame:
    """``balance_cents`` after each row: credits add, everything else subtracts, nothing is checked."""
    signed = F.when(credit, F.col("amount_cents")).otherwise(-F.col("amount_cents"))
    past = Window.partitionBy("account_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("balance_cents", opening_cents + F.sum(signed).over(past))


def idempotent_debits(df: DataFrame, opening_cents: int, order: list[str]) -> DataFrame:
    """The first row of each request id moves the balance; later ones repeat its result. Funds aren't checked.

    A request id belongs to one account, so account and id together are its key.
    """
    same = Window.partitionBy("account_id", "request_id").orderBy(*order)
    past = Window.partitionBy("account_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = df.withColumn("_nth", F.row_number().over(same))
    moved = F.sum(F.when(F.col("_nth") == 1, F.col("amount_cents")).otherwise(0)).over(past)
    balanced = first.withColumn("balance_cents", opening_cents - moved)
    result = F.concat(F.lit("Debited, Balance: "), F.first_value("balance_cents").over(same).cast("string"))
    said = F.when(F.col("_nth") == 1, result).otherwise(
        F.concat(F.lit("Duplicate request ignored. Previous result: "), result)
    )
    return balanced.withColumns({"result": said, "duplicate": F.col("_nth") > 1}).drop("_nth")


def misplaced_requests(requests: DataFrame) -> DataFrame:
    """Request ids that more than one account uses: they break the ledger's precondition."""
    accounts = requests.groupBy("request_id").agg(F.count_distinct("account_id").alias("accounts"))
    return accounts.where(F.col("accounts") > 1)


def apply_debit(balance: int | None, done: bool, amount: int | None) -> tuple[str, int | None]:
    """(status, balance) of one debit; an amount that equals the balance is allowed, a null one changes nothing."""
    if balance is None or amount is None:
        return UNKNOWN, balance
    if done:
        return DUPLICATE, balance
    return (INSUFFICIENT, balance) if balance < amount else (APPLIED, balance - amount)


def _ids(name: str) -> list:
    return [F.col("account_id").alias(f"{name}_account"), F.col("request_id").alias(f"{name}_request")]


def _same(df: DataFrame, other: DataFrame, name: str):
    return df["account_id"].eqNullSafe(other[f"{name}_account"]) & df["request_id"].eqNullSafe(other[f"{name}_request"])


def _applied(open_rows: DataFrame, balances: DataFrame, folder: str, rows_a_range: int) -> DataFrame:
    """``(account_id, request_id, at)`` of the debits that are applied, of ``(account_id, request_id, amount_cents, at, _part)``.

    A balance never rises. So as long as the first debits of all ids up to a range come to no more than the balance, all of
    them are applied, whatever their order; the range in which they come to more is gone through row by row, one such
    range an account, or all that the account has left where that is no more than a range. What is left after it are later
    debits that the balance still covers and whose id isn't applied yet: usually few. They are put into ranges anew, until
    none is left.
    """
    spark, found, step = open_rows.sparkSession, [], 0
    while True:
        round_folder = f"{folder}/round-{step}"
        ranged = in_ranges(open_rows, "account_id", ["at"], round_folder, rows_a_range).drop("_at") if step else open_rows
        firsts = ranged.groupBy("account_id", "request_id").agg(F.min(F.struct("at", F.col("_part").alias("part"), "amount_cents")).alias("f"))
        firsts = written(firsts.select("account_id", "request_id", "f.at", F.col("f.part").alias("_part"), "f.amount_cents"), round_folder, "firsts")
        sums = firsts.groupBy("account_id", "_part").agg(F.sum("amount_cents").alias("s"))
        up_to = Window.partitionBy("account_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # a row a range
        reached = sums.withColumn("cum", F.sum("s").over(up_to)).join(balances, "account_id")
        over = reached.where("cum > balance").groupBy("account_id").agg(F.min(F.struct(F.col("_part").alias("part"), (F.col("balance") - F.col("cum") + F.col("s")).alias("b"))).alias("o"))
        over = written(over.select("account_id", F.col("o.part").alias("contested"), F.col("o.b").alias("balance")), round_folder, "contested")
        bulk = firsts.join(over, "account_id", "left").where("contested IS NULL OR _part < contested").select("account_id", "request_id", "at")
        bulk = written(bulk, round_folder, "bulk")
        found.append(bulk)
        if over.isEmpty():
            break
        before = bulk.select(*_ids("b"))
        later = ranged.join(over, "account_id").where("_part >= contested")
        later = written(later.join(before, _same(later, before, "b"), "left_anti"), round_folder, "later")
        sizes = later.groupBy("account_id").agg(F.count("*").alias("rest"))
        later = later.join(sizes, "account_id").withColumn("now", (F.col("_part") == F.col("contested")) | (F.col("rest") <= rows_a_range))
        kinds = dict(open_rows.dtypes)
        schema = f"account_id string, at long, request_id {kinds['request_id']}, status string, balance long"

        def begin(row) -> dict:
            return {"balance": row.balance, "done": set()}

        def debit(state: dict, row) -> tuple:
            status, state["balance"] = apply_debit(state["balance"], row.request_id in state["done"], row.amount_cents)
            if status == APPLIED:
                state["done"].add(row.request_id)
            return row.account_id, row.at, row.request_id, status, state["balance"]

        replayed = later.where("now").select("account_id", "at", "request_id", "amount_cents", "balance")
        replayed = written(sorted_fold(replayed, "account_id", ["at"], begin, debit, schema), round_folder, "replayed")
        applied = replayed.where(F.col("status") == APPLIED).select("account_id", "request_id", "at")
        found.append(applied)
        balances = replayed.groupBy("account_id").agg(F.min("balance").alias("balance"))  # it never rises
        done = applied.select(*_ids("d"))
        left = later.where("NOT now").drop("balance").join(balances, "account_id").where("amount_cents <= balance")
        left = left.join(done, _same(left, done, "d"), "left_anti")
        open_rows = written(left.select("account_id", "request_id", "amount_cents", "at"), round_folder, "left")
        step += 1
        if open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "account_id string, request_id string, at long")


def debit_ledger(requests: DataFrame, opening: DataFrame | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``(seq, status, balance_cents)`` for debits ``(account_id, request_id, amount_cents, ts, seq)``.

    A refused debit isn't remembered, so its id may succeed later. Opening balances are a column
    ``opening_cents`` of the requests (an account's first row counts), or a table ``(account_id, opening_cents)``.

    An account with no more rows than a range is folded in one pass, and so are accounts with an amount below 0, whose
    balance may rise. For all other accounts at once, what is applied is found range by range, and an account may go over
    any number of ranges; results and balances follow from it.
    """
    if opening is not None:
        requests = requests.drop("opening_cents").join(opening, "account_id", "left")
    folder = shared_folder(requests.sparkSession, "ledger")
    opened = F.when(~F.isnan("opening_cents"), F.col("opening_cents")).cast("long")
    wanted = requests.select("seq", "ts", F.col("account_id").cast("string"), "request_id", "amount_cents", opened.alias("opened"))
    sizes = wanted.groupBy("account_id").agg(F.count("*").alias("n"), F.coalesce(F.min("amount_cents") < 0, F.lit(False)).alias("rises"))
    large = sizes.where((F.col("n") > rows_a_range) & ~F.col("rises")).select(F.col("account_id").alias("_account"))
    large = written(large, folder, "large")  # fewer accounts than there are ranges
    is_large = wanted["account_id"].eqNullSafe(large["_account"])

    def start(row) -> dict:
        return {"balance": row.opened, "done": set()}

    def step(state: dict, row) -> tuple:
        status, state["balance"] = apply_debit(state["balance"], row.request_id in state["done"], row.amount_cents)
        if status == APPLIED:
            state["done"].add(row.request_id)
        return row.seq, status, state["balance"]

    folded = sorted_fold(wanted.join(large, is_large, "left_anti"), "account_id", ["ts", "seq"], start, step, LEDGER)
    if large.isEmpty():
        return folded
    ranged = in_ranges(wanted.join(large, is_large, "left_semi"), "account_id", ["ts", "seq"], f"{folder}/all", rows_a_range)
    # from here on no account is null
    named = ranged.withColumnRenamed("_at", "at").withColumn("account_id", F.coalesce(F.concat(F.lit("="), "account_id"), F.lit("-")))
    accounts = named.groupBy("account_id").agg(F.min_by("opened", "at").alias("opened"))
    steady = written(named.drop("opened").join(accounts, "account_id"), folder, "steady")
    balances = steady.where("opened IS NOT NULL").groupBy("account_id").agg(F.max("opened").alias("balance"))
    open_rows = steady.where("opened IS NOT NULL AND amount_cents <= opened").select("account_id", "request_id", "amount_cents", "at", "_part")
    applied = _applied(open_rows, balances, folder, rows_a_range).select(*_ids("a"), F.col("at").alias("applied_at"))
    told = steady.join(applied, _same(steady, applied, "a"), "left").withColumn(
        "status",
        F.when(F.col("opened").isNull() | F.col("amount_cents").isNull(), UNKNOWN)
        .when(F.col("applied_at") == F.col("at"), APPLIED)
        .when(F.col("applied_at") < F.col("at"), DUPLICATE)
        .otherwise(INSUFFICIENT),
    )
    told = written(told.withColumn("moved", F.when(F.col("status") == APPLIED, F.col("amount_cents")).otherwise(0)), folder, "told")
    # running sums in two steps: within a range, and over the ranges of the account before it
    front = Window.partitionBy("account_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spent = told.groupBy("account_id", "_part").agg(F.sum("moved").alias("s"))
    spent = spent.select("account_id", "_part", F.coalesce(F.sum("s").over(front), F.lit(0)).alias("before"))
    within = Window.partitionBy("account_id", "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    balanced = told.withColumn("within", F.sum("moved").over(within)).join(spent, ["account_id", "_part"])
    return balanced.select("seq", "status", (F.col("opened") - F.col("before") - F.col("within")).alias("balance_cents")).unionByName(folded)
