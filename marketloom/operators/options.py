"""European option analytics over tables of contracts and legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A published rational approximation of the normal integral (absolute error below 7.5e-8).
_P, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_ROOT_2PI = 2.5066282746310002


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / _ROOT_2PI


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + _P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = t * (F.lit(b) + poly)
    tail = density(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def price_contracts(contracts: DataFrame) -> DataFrame:
    """Adds price, delta, gamma, theta (a day), vega (a point) to (option_type, spot, strike, days, vol, rate, dividend).

    All five are null where spot or strike is not positive, or days or volatility are negative.
    """
    s, k, v, r, q = (F.col(c).cast("double") for c in ("spot", "strike", "vol", "rate", "dividend"))
    t = F.col("days") / 365.0
    root = F.nullif(v * F.sqrt(t), F.lit(0.0))
    d1 = (F.log(s / F.when(k > 0, k)) + (r - q + v * v / 2) * t) / root
    known = (s > 0) & (k > 0) & (t >= 0) & (v >= 0)
    c = contracts.withColumn("_d1", d1).withColumn("_d2", d1 - root)
    sign = F.when(F.col("option_type") == "call", 1.0).otherwise(-1.0)
    n1, n2 = normal_cdf(sign * F.col("_d1")), normal_cdf(sign * F.col("_d2"))
    dq, dr = F.exp(-q * t), F.exp(-r * t)
    dead = (t <= 0) | (v <= 0)
    intrinsic = F.greatest(sign * (s - k), F.lit(0.0))
    edge = sign * F.when(sign * (s - k) > 0, 1.0).when(s == k, 0.5).otherwise(0.0)
    theta = (-s * dq * density(F.col("_d1")) * v / (2 * F.nullif(F.sqrt(t), F.lit(0.0))) - sign * r * k * dr * n2 + sign * q * s * dq * n1) / 365
    greeks = {
        "price": F.when(dead, intrinsic).otherwise(sign * (s * dq * n1 - k * dr * n2)), "delta": F.when(dead, edge).otherwise(sign * dq * n1),
        "gamma": F.when(dead, 0.0).otherwise(dq * density(F.col("_d1")) / F.nullif(s * root, F.lit(0.0))), "theta": F.when(dead, 0.0).otherwise(theta),
        "vega": F.when(dead, 0.0).otherwise(s * dq * density(F.col("_d1")) * F.sqrt(t) / 100)}
    return c.select(*contracts.columns, *[F.when(known, greeks[g]).alias(g) for g in GREEKS])


GREEKS = ("price", "delta", "gamma", "theta", "vega")


def position_greeks(legs: DataFrame) -> DataFrame:
    """Signed sums over the priced legs of each strategy; net premium is what opening it brings in."""
    size = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * F.col("quantity") * F.col("lot_size")
    return legs.groupBy("strategy_id").agg(*[F.sum(size * F.col(g)).alias("value" if g == "price" else g) for g in GREEKS], (-F.sum(size * F.col("price"))).alias("net_premium"))


#: Legs of each template as (side, type, steps from the money, quantity).
TEMPLATES = {
    "straddle": (("buy", "call", 0, 1), ("buy", "put", 0, 1)),
    "strangle": (("buy", "put", -1, 1), ("buy", "call", 1, 1)),
    "iron_condor": (("buy", "put", -2, 1), ("sell", "put", -1, 1), ("sell", "call", 1, 1), ("buy", "call", 2, 1)),
    "call_butterfly": (("buy", "call", -1, 1), ("sell", "call", 0, 2), ("buy", "call", 1, 1)),
    "double_butterfly": (("buy", "call", -2, 1), ("sell", "call", -1, 2), ("buy", "call", 0, 2), ("sell", "call", 1, 2), ("buy", "call", 2, 1)),
}


def template_legs(underlyings: DataFrame) -> DataFrame:
    """(strategy_id, leg_id, symbol, template, side, option_type, strike, quantity) around the money; (symbol, spot, spacing)."""
    rows = [(t, i, *leg) for t, legs in TEMPLATES.items() for i, leg in enumerate(legs)]
    table = underlyings.sparkSession.createDataFrame(rows, "template string, leg_id int, side string, option_type string, steps int, quantity int")
    middle = F.bround(F.col("spot") / F.col("spacing")) * F.col("spacing")
    return underlyings.crossJoin(F.broadcast(table)).select(F.concat_ws("-", "symbol", "template").alias("strategy_id"), "leg_id", "symbol", "template", "side", "option_type", (middle + F.col("steps") * F.col("spacing")).alias("strike"), "quantity", "spot")


def validate_legs(legs: DataFrame) -> DataFrame:
    reason = (F.when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "unknown side").when(~F.coalesce(F.col("option_type").isin("call", "put"), F.lit(False)), "unknown type")
              .when(~F.coalesce(F.col("strike") > 0, F.lit(False)), "strike must be positive").when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity must be positive"))
    return legs.select("strategy_id", "leg_id", reason.alias("reason")).where("reason is not null")


def valid_strategies(legs: DataFrame) -> DataFrame:
    """The legs of strategies in which `validate_legs` names none."""
    bad = validate_legs(legs).select("strategy_id").distinct()
    return legs.join(bad, "strategy_id", "left_anti")


def expiry_payoff(legs: DataFrame, points: int = 1001) -> DataFrame:
    """(strategy_id, terminal, pnl) on a grid to 1.5 times the largest of spot and strikes, with these among it; legs are priced."""
    size = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * F.col("quantity") * F.col("lot_size")
    rows = legs.withColumn("size", size)
    own = rows.groupBy("strategy_id").agg(F.max(F.greatest("spot", "strike")).alias("top"), F.sum(F.col("size") * F.col("price")).alias("entry"), F.first("spot").alias("spot"), F.collect_set("strike").alias("strikes"),
                                          F.sort_array(F.collect_list(F.struct("leg_id", "option_type", "strike", "size"))).alias("legs"))
    grid = F.concat(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.col("top") * 1.5 / (points - 1)), "strikes", F.array("spot"))
    each = own.select("strategy_id", "entry", "legs", F.explode(F.array_distinct(grid)).alias("terminal"))
    value = F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["size"] * F.greatest(F.when(x["option_type"] == "call", F.col("terminal") - x["strike"]).otherwise(x["strike"] - F.col("terminal")), F.lit(0.0)))
    return each.select("strategy_id", "terminal", (value - F.col("entry")).alias("pnl"))


def payoff_summary(payoff: DataFrame, legs: DataFrame) -> DataFrame:
    """Extremes of the payoff, null where the upper tail is open, and the break-even points."""
    w = Window.partitionBy("strategy_id").orderBy("terminal")
    rows = payoff.withColumn("next_t", F.lead("terminal").over(w)).withColumn("next_p", F.lead("pnl").over(w))
    at = F.when(F.abs("pnl") <= 1e-8, F.col("terminal")).when(F.col("pnl") * F.col("next_p") < 0, F.col("terminal") - F.col("pnl") * (F.col("next_t") - F.col("terminal")) / (F.col("next_p") - F.col("pnl")))
    g = rows.withColumn("at", F.round(at, 4)).groupBy("strategy_id").agg(F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.array_join(F.transform(F.sort_array(F.collect_set("at")), lambda x: x.cast("decimal(18,4)").cast("string")), ",").alias("breakevens"))
    slope = F.sum(F.when(F.col("option_type") == "call", F.when(F.col("side") == "buy", 1).otherwise(-1) * F.col("quantity")).otherwise(0))
    tail = legs.groupBy("strategy_id").agg(slope.alias("slope"))
    out = g.join(tail, "strategy_id").join(payoff_odds(payoff, legs), "strategy_id", "left")
    return out.select("strategy_id", F.when(F.col("slope") <= 0, F.col("best")).alias("max_profit"), F.when(F.col("slope") >= 0, F.col("worst")).alias("max_loss"), "breakevens", "profit_probability", "expected_pnl")


def payoff_odds(payoff: DataFrame, legs: DataFrame) -> DataFrame:
    """(strategy_id, profit_probability, expected_pnl): each grid point weighs the lognormal mass between its midpoints."""
    s, v, t = F.col("spot"), F.col("vol"), F.col("days") / 365.0
    own = legs.groupBy("strategy_id").agg(*[F.first(c).alias(c) for c in ("spot", "vol", "days", "rate", "dividend")])
    own = own.select("strategy_id", (F.log(s) + (F.col("rate") - F.col("dividend") - v * v / 2) * t).alias("mu"), F.nullif(v * F.sqrt(t), F.lit(0.0)).alias("sd"))
    w = Window.partitionBy("strategy_id").orderBy("terminal")
    upper = (F.col("terminal") + F.lead("terminal").over(w)) / 2
    below = F.when(F.col("upper").isNull(), 1.0).when(F.col("upper") <= 0, 0.0).otherwise(normal_cdf((F.log(F.when(F.col("upper") > 0, F.col("upper"))) - F.col("mu")) / F.col("sd")))
    rows = payoff.withColumn("upper", upper).join(own, "strategy_id").withColumn("below", below)
    rows = rows.withColumn("mass", F.col("below") - F.coalesce(F.lag("below").over(w), F.lit(0.0)))
    return rows.groupBy("strategy_id").agg(F.sum(F.when(F.col("pnl") > 0, F.col("mass")).otherwise(0.0)).alias("profit_probability"), F.sum(F.col("mass") * F.col("pnl")).alias("expected_pnl"))


def scenario_matrix(legs: DataFrame, spot_moves: tuple[float, ...] = (-0.10, -0.05, 0.0, 0.05, 0.10), vol_moves: tuple[float, ...] = (-0.05, 0.0, 0.05), days_share: float = 0.5) -> DataFrame:
    """(strategy_id, spot_move, vol_move, pnl) when spot and volatility have moved and some of the days are gone."""
    spark = legs.sparkSession
    shocks = spark.createDataFrame([(a, b) for a in spot_moves for b in vol_moves], "spot_move double, vol_move double")
    size = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * F.col("quantity") * F.col("lot_size")
    moved = legs.withColumnRenamed("price", "entry").drop(*GREEKS[1:]).crossJoin(F.broadcast(shocks))
    moved = moved.withColumn("spot", F.col("spot") * (1 + F.col("spot_move"))).withColumn("vol", F.greatest(F.col("vol") + F.col("vol_move"), F.lit(1e-4))).withColumn("days", F.col("days") * days_share)
    return price_contracts(moved).groupBy("strategy_id", "spot_move", "vol_move").agg(F.sum(size * (F.col("price") - F.col("entry"))).alias("pnl"))
