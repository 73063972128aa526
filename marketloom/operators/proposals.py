"""Portfolio proposals: limit checks, trades towards target weights, later marks of saved proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: smallest tradable step of each instrument type
STEPS = {"Stock": 1.0, "Mutual fund": 1e-6}


def limit_checks(weights: DataFrame, covariance: DataFrame, current: DataFrame, sectors: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(run_id, check, value, limit, passed) from weights (run_id, symbol, weight) with CASH rows.

    limits: max_weight, min_cash, max_volatility, max_turnover, max_sector; covariance: (i, j, cov) with i <= j.
    """
    risky = weights.where("symbol <> 'CASH'")
    total = weights.groupBy("run_id").agg(F.sum("weight").alias("value"))
    least = risky.groupBy("run_id").agg(F.min("weight").alias("value"))
    most = risky.groupBy("run_id").agg(F.max("weight").alias("value"))
    cash = weights.groupBy("run_id").agg(F.sum(F.when(F.col("symbol") == "CASH", F.col("weight")).otherwise(0.0)).alias("value"))
    a = risky.select("run_id", F.col("symbol").alias("i"), F.col("weight").alias("wi"))
    b = risky.select("run_id", F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    form = covariance.join(a, "i").join(b, ["run_id", "j"]).groupBy("run_id").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)).alias("v"))
    volatility = form.select("run_id", F.sqrt(F.greatest("v", F.lit(0.0))).alias("value"))
    moved = weights.select("run_id", "symbol", F.col("weight").alias("w")).join(current.select("run_id", "symbol", F.col("weight").alias("o")), ["run_id", "symbol"], "full")
    turned = moved.groupBy("run_id").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("o", F.lit(0.0)))) / 2).alias("value"))
    sector = risky.join(sectors, "symbol").groupBy("run_id", "sector").agg(F.sum("weight").alias("s")).groupBy("run_id").agg(F.max("s").alias("value"))

    def row(df: DataFrame, check: str, limit: float, passed) -> DataFrame:
        return df.select("run_id", F.lit(check).alias("check"), "value", F.lit(float(limit)).alias("limit"), passed.alias("passed"))

    v = F.col("value")
    parts = [
        row(total, "weight sum", 1.0, F.abs(v - 1) <= 1e-6), row(least, "long only", 0.0, v >= -1e-8), row(most, "largest position", limits["max_weight"], v <= limits["max_weight"] + 1e-6),
        row(cash, "cash reserve", limits["min_cash"], v >= limits["min_cash"] - 1e-6), row(volatility, "volatility", limits["max_volatility"], v <= limits["max_volatility"] + 1e-6),
        row(turned, "one-way turnover", limits["max_turnover"], v <= limits["max_turnover"] + 1e-6), row(sector, "sector exposure", limits["max_sector"], v <= limits["max_sector"] + 1e-6),
    ]
    return reduce(DataFrame.unionByName, parts)


def proposal_trades(holdings: DataFrame, cash: DataFrame, targets: DataFrame, latest: DataFrame, cost_bps: float) -> DataFrame:
    """Trades that take each account to its target weights in tradable steps.

    holdings: (account_id, symbol, quantity); cash: (account_id, cash); targets: (account_id, symbol, weight);
    latest: (symbol, price, instrument_type). Every row also says what cash is left and whether it funds the trades. An account
    that holds something without a price above 0 has no known capital: its rows carry an error and no trades. A
    target without a price is an error row of its own.
    """
    fee = cost_bps / 10_000
    both = holdings.select("account_id", "symbol", "quantity").join(targets.select("account_id", "symbol", "weight"), ["account_id", "symbol"], "full")
    whole = both.join(latest, "symbol", "left").select("account_id", "symbol", "instrument_type", F.when(F.col("price") > 0, F.col("price")).alias("price"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    unpriced = F.max(F.col("price").isNull() & (F.col("quantity") != 0)).over(Window.partitionBy("account_id"))
    error = F.when(F.col("price").isNull(), F.when(F.col("quantity") != 0, "held without a price").otherwise("target without a price")).when(unpriced, "the account holds something without a price")
    whole = whole.withColumn("error", error)
    rows, failed = whole.where("error is null").drop("error"), whole.where("error is not null")
    held = rows.groupBy("account_id").agg(F.sum(F.col("quantity") * F.col("price")).alias("held"))
    capital = held.join(cash, "account_id", "full").select("account_id", F.coalesce("cash", F.lit(0.0)).alias("cash"), (F.coalesce("held", F.lit(0.0)) + F.coalesce("cash", F.lit(0.0))).alias("capital"))
    step = F.coalesce(*[F.when(F.col("instrument_type") == k, F.lit(s)) for k, s in STEPS.items()], F.lit(1.0))
    t = rows.join(capital, "account_id").withColumn("target_quantity", F.floor(F.col("weight") * F.col("capital") * (1 - fee) / F.col("price") / step + 1e-9) * step)
    t = t.withColumn("delta", F.col("target_quantity") - F.col("quantity")).withColumn("notional", F.abs("delta") * F.col("price")).withColumn("fee", F.col("notional") * fee)
    left = t.groupBy("account_id").agg((F.first("cash") - F.sum(F.col("delta") * F.col("price")) - F.sum("fee")).alias("remaining_cash"))
    side = F.when(F.col("delta") > 0, "Buy").when(F.col("delta") < 0, "Sell").otherwise("Hold")
    trades = t.join(left, "account_id").select("account_id", "symbol", side.alias("side"), "quantity", "target_quantity", "delta", "notional", "fee", "remaining_cash",
                                               (F.col("target_quantity") * F.col("price") / F.nullif(F.col("capital"), F.lit(0.0))).alias("rounded_weight"), (F.col("remaining_cash") >= -1e-7).alias("funded"), F.lit(None).cast("string").alias("error"))
    return trades.unionByName(failed.select("account_id", "symbol", "quantity", F.lit(False).alias("funded"), "error"), allowMissingColumns=True)


def mark_proposals(proposals: DataFrame, latest: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """(proposal_id, status, value): saved target quantities at the latest prices, where they can still be compared.

    proposals: (proposal_id, symbol, quantity, reference_date, reference_price, cash); history: (symbol, date, close).
    """
    rows = proposals.join(latest.select("symbol", "price"), "symbol", "left")
    rows = rows.join(history.select("symbol", F.col("date").alias("reference_date"), F.col("close").alias("then")), ["symbol", "reference_date"], "left")
    g = rows.groupBy("proposal_id").agg(
        F.bool_and(F.col("price").isNotNull()).alias("known"), F.bool_or(F.col("reference_date") > F.to_date(F.lit(as_of))).alias("ahead"),
        F.bool_and(F.coalesce(F.abs(F.col("then") - F.col("reference_price")) <= 1e-8, F.lit(False))).alias("same"), (F.sum(F.col("quantity") * F.col("price")) + F.first("cash")).alias("value"))
    status = F.when(~F.col("known"), "symbol missing").when(F.col("ahead"), "date in the future").when(~F.col("same"), "prices were revised").otherwise("comparable")
    return g.select("proposal_id", status.alias("status"), F.when(status == "comparable", F.col("value")).alias("value"))
