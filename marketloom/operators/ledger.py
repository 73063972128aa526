"""Transactions of many accounts: validation, cash, first-in-first-out matching, valuation, returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("buy", "sell", "deposit", "withdrawal", "fee", "distribution")
TYPES = ("Stock", "Mutual fund")


def transaction_id(tx: DataFrame) -> DataFrame:
    """A content id per row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("action", "symbol", "date", "quantity", "price", "amount", "notes")]
    # a sign in a text can't be taken for the one between the parts
    parts = [F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for p in parts]
    return tx.withColumn("transaction_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def append_transactions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose id is neither repeated in the batch nor known, keyed by account."""
    first = Window.partitionBy("account_id", "transaction_id").orderBy("event_id")
    batch = transaction_id(new).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return batch.join(transaction_id(existing).select("account_id", "transaction_id").distinct(), ["account_id", "transaction_id"], "left_anti")


def validate_transactions(tx: DataFrame, as_of: str) -> DataFrame:
    """(account_id, event_id, reason) of rows that can't be booked."""
    trade = F.col("action").isin("buy", "sell")
    kinds = F.size(F.collect_set(F.when(trade, F.col("instrument_type"))).over(Window.partitionBy("account_id", "symbol")))
    reason = (F.when(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS), "unknown action").when(F.col("date").isNull() | (F.col("date") > F.to_date(F.lit(as_of))), "bad date")
              .when(trade & F.coalesce(F.trim("symbol") == "", F.lit(True)), "no symbol").when(trade & ~F.coalesce(F.col("instrument_type").isin(*TYPES), F.lit(False)), "unknown instrument type")
              .when(trade & ~F.coalesce((F.col("quantity") > 0) & (F.col("price") > 0), F.lit(False)), "quantity and price must be positive")
              .when(trade & (F.col("instrument_type") == "Stock") & (F.col("quantity") != F.floor("quantity")), "stocks trade in whole shares")
              .when(trade & (F.col("kinds") > 1), "several instrument types").when(~trade & ~F.coalesce(F.col("amount") > 0, F.lit(False)), "amount must be positive"))
    return tx.withColumn("kinds", kinds).select("account_id", "event_id", reason.alias("reason")).where("reason is not null")


def cash_flow() -> object:
    traded = F.col("quantity") * F.col("price")
    return F.when(F.col("action") == "buy", -traded).when(F.col("action") == "sell", traded).when(F.col("action").isin("deposit", "distribution"), F.col("amount")).otherwise(-F.col("amount"))


def cash_path(tx: DataFrame) -> DataFrame:
    """Running cash of each account; accounts without any deposit are not held to it."""
    order = Window.partitionBy("account_id").orderBy("date", "action", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    funded = F.max(F.when(F.col("action") == "deposit", 1).otherwise(0)).over(Window.partitionBy("account_id")) == 1
    path = tx.select("account_id", "event_id", "date", "action", F.sum(cash_flow()).over(order).alias("cash"), funded.alias("funded"))
    return path.withColumn("violation", F.col("funded") & (F.col("cash") < -1e-6))


def balances(tx: DataFrame) -> DataFrame:
    """(account_id, cash, funded, until): what a later batch needs to know of all before it."""
    return tx.groupBy("account_id").agg(F.sum(cash_flow()).alias("cash"), (F.max(F.when(F.col("action") == "deposit", 1).otherwise(0)) == 1).alias("funded"), F.max("date").alias("until"))


def cash_path_of_batch(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """`cash_path` of the rows of a batch from the balances before it; the history is not read again.

    A row that is dated on or before the last day of its account's history would have to be booked among rows that are
    gone: it is `late`, without cash, and so are the later rows of its account.
    """
    order = Window.partitionBy("account_id").orderBy("date", "action", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    opened = batch.join(snapshot.select("account_id", F.col("cash").alias("opening"), F.col("funded").alias("was"), "until"), "account_id", "left")
    funded = F.coalesce("was", F.lit(False)) | (F.max(F.when(F.col("action") == "deposit", 1).otherwise(0)).over(Window.partitionBy("account_id")) == 1)
    late = F.max(F.coalesce(F.col("date") <= F.col("until"), F.lit(False))).over(order)
    rows = opened.select("account_id", "event_id", "date", "action", (F.coalesce("opening", F.lit(0.0)) + F.sum(cash_flow()).over(order)).alias("cash"), funded.alias("funded"), late.alias("late"))
    rows = rows.withColumn("cash", F.when(~F.col("late"), F.col("cash")))
    return rows.withColumn("violation", F.col("funded") & (F.col("cash") < -1e-6))


def add_balances(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The balances after a batch."""
    both = snapshot.unionByName(balances(batch))
    return both.groupBy("account_id").agg(F.sum("cash").alias("cash"), F.max("funded").alias("funded"), F.max("until").alias("until"))


def fifo_match(tx: DataFrame) -> DataFrame:
    """(account_id, symbol, buy_id, sell_id, buy_date, sell_date, quantity, cost, proceeds, gain, holding_days).

    Buys and sells are intervals of running quantity. Between two neighbouring ends one buy and one sell are open: the
    first whose end is not passed yet. Groups that sell more than they hold are left out; `oversells` names them.
    """
    trades = tx.where(F.col("action").isin("buy", "sell")).join(oversells(tx).select("account_id", "symbol").distinct(), ["account_id", "symbol"], "left_anti")
    order = Window.partitionBy("account_id", "symbol", "action").orderBy("date", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = trades.select("account_id", "symbol", "event_id", "action", "date", "price", F.sum("quantity").over(order).alias("to"))
    # of equal ends the one of a buy first: what is between them is empty
    line = Window.partitionBy("account_id", "symbol").orderBy("to", "action", "event_id")
    ahead = line.rowsBetween(0, Window.unboundedFollowing)
    row = F.struct(F.col("event_id").alias("id"), "date", "price")
    pieces = ends.select("account_id", "symbol", (F.col("to") - F.coalesce(F.lag("to").over(line), F.lit(0.0))).alias("q"),
                         F.first(F.when(F.col("action") == "buy", row), True).over(ahead).alias("b"), F.first(F.when(F.col("action") == "sell", row), True).over(ahead).alias("s"))
    pieces = pieces.where("q > 1e-12 and b is not null and s is not null")
    q, bp, sp = F.col("q"), F.col("b.price"), F.col("s.price")
    return pieces.select("account_id", "symbol", F.col("b.id").alias("buy_id"), F.col("s.id").alias("sell_id"), F.col("b.date").alias("buy_date"), F.col("s.date").alias("sell_date"), q.alias("quantity"),
                         (q * bp).alias("cost"), (q * sp).alias("proceeds"), (q * (sp - bp)).alias("gain"), F.date_diff(F.col("s.date"), F.col("b.date")).alias("holding_days"))


def oversells(tx: DataFrame) -> DataFrame:
    """Sells of more than was open at that point."""
    order = Window.partitionBy("account_id", "symbol").orderBy("date", "action", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("action") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = tx.where(F.col("action").isin("buy", "sell")).withColumn("open", F.sum(sign).over(order))
    return rows.where("action = 'sell' and open < -1e-9").select("account_id", "symbol", "event_id", "date", F.round(-F.col("open"), 6).alias("short_by"))


def open_lots(tx: DataFrame, matches: DataFrame) -> DataFrame:
    """What is left of each buy; groups that sell more than they hold are left out."""
    tx = tx.join(oversells(tx).select("account_id", "symbol").distinct(), ["account_id", "symbol"], "left_anti")
    used = matches.groupBy(F.col("buy_id").alias("event_id")).agg(F.sum("quantity").alias("used"))
    left = tx.where("action = 'buy'").join(used, "event_id", "left").withColumn("quantity", F.col("quantity") - F.coalesce("used", F.lit(0.0)))
    return left.where("quantity > 1e-12").select("account_id", "symbol", "instrument_type", "event_id", F.col("date").alias("purchase_date"), "quantity", F.col("price").alias("purchase_price"))


def realized_gains(matches: DataFrame) -> DataFrame:
    return matches.groupBy("account_id", "symbol").agg(F.sum("gain").alias("gain"), F.sum("quantity").alias("quantity"), F.count("*").alias("matches"))


def value_positions(lots: DataFrame, latest: DataFrame, as_of: str) -> DataFrame:
    """Per account and symbol: quantity, cost, value, gain, return, first and last purchase, average price; priced says whether a quote was there.

    What cost nothing has an infinite return, and none (not a number) where it is worth nothing too.
    """
    rows = lots.join(latest.select("symbol", F.col("price").alias("quote")), "symbol", "left").withColumn("quote", F.when(F.col("quote") > 0, F.col("quote")))
    g = rows.groupBy("account_id", "symbol").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("purchase_price")).alias("cost"), F.sum(F.col("quantity") * F.col("quote")).alias("value"),
        F.min("purchase_date").alias("first_purchase"), F.max("purchase_date").alias("last_purchase"), F.count("*").alias("lots"), F.max(F.date_diff(F.to_date(F.lit(as_of)), "purchase_date")).alias("longest_days"))
    free = F.when(F.col("value") > 0, float("inf")).when(F.col("value") < 0, float("-inf")).when(F.col("value") == 0, float("nan"))
    gained = F.when(F.col("cost") == 0, free).otherwise(F.col("value") / F.nullif(F.col("cost"), F.lit(0.0)) - 1)
    return g.select("*", (F.col("cost") / F.col("quantity")).alias("average_price"), (F.col("value") - F.col("cost")).alias("gain"), gained.alias("return"), F.col("value").isNotNull().alias("priced"))


def xirr(flows: DataFrame) -> DataFrame:
    """(account_id, rate, note) from dated flows: the first sign change of the net present value on a grid, then bisection.

    Flows are summed by day before they are shuffled to their account, so an account is as many numbers as it has days.
    Null amounts take no part.
    """
    import numpy as np
    import pandas as pd

    # The grid of rates
    grid = np.concatenate([np.linspace(-0.99, 1, 4000), np.linspace(1, 10, 1801)[1:]])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        account = g["account_id"].iloc[0]
        row = lambda rate, note: pd.DataFrame([(account, rate, note)], columns=["account_id", "rate", "note"])
        if not g["up"].any() or not g["down"].any():
            return row(None, "flows have one sign")
        x, days = g["amount"].to_numpy(float), pd.to_datetime(g["date"])
        years = (days - days.min()).dt.days.to_numpy() / 365.0

        def npv(rates) -> np.ndarray:
            return np.power(1 + np.asarray(rates, float)[:, None], -years) @ x

        step = max(1, 4_000_000 // len(x))  # cells of a product at a time
        values = np.concatenate([npv(grid[i : i + step]) for i in range(0, len(grid), step)])
        turns = np.flatnonzero(np.sign(values[:-1]) * np.sign(values[1:]) < 0)
        zero = np.flatnonzero(values == 0)
        if len(zero) and (not len(turns) or zero[0] <= turns[0]):
            return row(float(grid[zero[0]]), None)
        if not len(turns):
            return row(None, "no root in range")
        lo, hi = grid[turns[0]], grid[turns[0] + 1]
        for _ in range(80):
            mid = (lo + hi) / 2
            at = np.sign(npv([lo, mid]))
            lo, hi = (mid, hi) if at[0] == at[1] else (lo, mid)
        return row(float((lo + hi) / 2), "several roots" if len(turns) > 1 else None)

    daily = flows.groupBy("account_id", "date").agg(F.sum("amount").alias("amount"), F.max(F.coalesce(F.col("amount") > 0, F.lit(False))).alias("up"), F.max(F.coalesce(F.col("amount") < 0, F.lit(False))).alias("down"))
    return daily.withColumn("amount", F.coalesce("amount", F.lit(0.0))).groupBy("account_id").applyInPandas(solve, "account_id long, rate double, note string")


def modified_dietz(flows: DataFrame, spans: DataFrame) -> DataFrame:
    """(account_id, dietz): flows (account_id, date, amount), spans (account_id, start, end, start_value, end_value)."""
    days = F.greatest(F.date_diff("end", "start"), F.lit(1))
    rows = spans.join(flows, "account_id", "left").withColumn("days", days)
    g = rows.groupBy("account_id", "start_value", "end_value").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("f"), F.coalesce(F.sum(F.col("amount") * F.date_diff("end", "date") / F.col("days")), F.lit(0.0)).alias("w"))
    base = F.nullif(F.col("start_value") + F.col("w"), F.lit(0.0))
    return g.select("account_id", ((F.col("end_value") - F.col("start_value") - F.col("f")) / base).alias("dietz"))


def reconcile_lots(lots: DataFrame, stated: DataFrame) -> DataFrame:
    """Symbols whose lots don't add up to the stated quantity."""
    held = lots.groupBy("account_id", "symbol").agg(F.sum("quantity").alias("lots"))
    both = held.join(stated.select("account_id", "symbol", F.col("quantity").alias("stated")), ["account_id", "symbol"], "full")
    return both.select("account_id", "symbol", F.coalesce("lots", F.lit(0.0)).alias("lots"), F.coalesce("stated", F.lit(0.0)).alias("stated")).where("abs(lots - stated) > 1e-9")
