"""From target weights to equity, costs, metrics and attribution. Long tables; several runs go in one job by run_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252.0


def interval_values(targets: DataFrame, panel: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(run_id, pos, day_pos, symbol, value): each target grown from its rebalance to every day of its interval."""
    spans = targets.join(F.broadcast(rebalances.select("pos", "next_pos")), "pos")
    start = panel.select("symbol", "pos", F.col("close").alias("p0"))
    # each day belongs to one rebalance, so days meet targets by symbol and rebalance, not by symbol alone
    own = rebalances.select("pos", F.explode(F.sequence(F.col("pos") + 1, F.col("next_pos"))).alias("day_pos"))
    days = panel.select("symbol", F.col("pos").alias("day_pos"), F.col("close").alias("p")).join(F.broadcast(own), "day_pos")
    risky = spans.where("symbol <> 'CASH'").join(start, ["symbol", "pos"]).join(days, ["symbol", "pos"])
    risky = risky.select("run_id", "pos", "day_pos", "symbol", (F.col("weight") * F.col("p") / F.col("p0")).alias("value"))
    cash = spans.where("symbol = 'CASH'").select("run_id", "pos", F.explode(F.sequence(F.col("pos") + 1, "next_pos")).alias("day_pos"), "symbol", F.col("weight").alias("value"))
    return risky.unionByName(cash)


def liquidate_at_cutoff(values: DataFrame, eligible: DataFrame, cost_bps: float) -> DataFrame:
    """Interval values with names sold at their last real row: from there on their value less the fee is cash.

    eligible: (symbol, cutoff_pos), null where a symbol never ends. Adds the fee paid by each day as `fees`, 0 where none.
    """
    fee = cost_bps / 10_000
    ends = values.join(eligible.where("cutoff_pos is not null").select("symbol", "cutoff_pos"), "symbol", "left")
    at = F.greatest(F.col("cutoff_pos"), F.col("pos") + 1)
    sold = F.coalesce(F.col("day_pos") >= at, F.lit(False))
    own = Window.partitionBy("run_id", "pos", "symbol")
    proceeds = F.max(F.when(F.col("day_pos") == at, F.col("value"))).over(own)
    rows = ends.withColumn("proceeds", proceeds).withColumn("sold", sold)
    cash = rows.where("sold").select("run_id", "pos", "day_pos", F.lit("CASH").alias("symbol"), (F.col("proceeds") * (1 - fee)).alias("value"), (F.col("proceeds") * fee).alias("fees"))
    kept = rows.where("not sold").select("run_id", "pos", "day_pos", "symbol", "value", F.lit(0.0).alias("fees"))
    return kept.unionByName(cash).groupBy("run_id", "pos", "day_pos", "symbol").agg(F.sum("value").alias("value"), F.sum("fees").alias("fees"))


def interval_growth(values: DataFrame) -> DataFrame:
    return values.groupBy("run_id", "pos", "day_pos").agg(F.sum("value").alias("growth"))


def drifted_holdings(values: DataFrame) -> DataFrame:
    """Weights as they have drifted by each day."""
    total = F.sum("value").over(Window.partitionBy("run_id", "pos", "day_pos"))
    return values.select("run_id", "pos", "day_pos", "symbol", (F.col("value") / total).alias("weight"))


def changes(targets: DataFrame, held: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(run_id, pos, symbol, weight, old): target weights beside what is held when they are set."""
    last = held.join(F.broadcast(rebalances.select("pos", "next_pos")), "pos").where("day_pos = next_pos").select("run_id", F.col("next_pos").alias("pos"), "symbol", F.col("weight").alias("old"))
    first = targets.groupBy("run_id").agg(F.min("pos").alias("pos")).select("run_id", "pos", F.lit("CASH").alias("symbol"), F.lit(1.0).alias("old"))
    known = targets.select("run_id", "pos").distinct()
    old = last.join(known, ["run_id", "pos"], "left_semi").unionByName(first)
    return targets.join(old, ["run_id", "pos", "symbol"], "full").select("run_id", "pos", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("old", F.lit(0.0)).alias("old"))


def turnover(changed: DataFrame) -> DataFrame:
    move = F.abs(F.col("weight") - F.col("old"))
    return changed.groupBy("run_id", "pos").agg((F.sum(move) / 2).alias("turnover"), F.sum(F.when(F.col("symbol") != "CASH", move).otherwise(0.0)).alias("asset_turnover"))


def self_financing_cost(changed: DataFrame, cost_bps: float) -> DataFrame:
    """(run_id, pos, cost): the share c for which c = fee * sum |weight * (1 - c) - old| over risky names; 60 bisections."""
    fee = cost_bps / 10_000
    lists = changed.where("symbol <> 'CASH'").groupBy("run_id", "pos").agg(F.sort_array(F.collect_list(F.struct("symbol", "weight", "old"))).alias("w"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        need = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x["weight"] * (1 - mid) - x["old"])) * fee
        return F.struct(F.when(need > mid, mid).otherwise(s["lo"]).alias("lo"), F.when(need > mid, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    cost = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: (s["lo"] + s["hi"]) / 2) if fee else F.lit(0.0)
    return lists.select("run_id", "pos", cost.alias("cost"))


def equity_curve(growth: DataFrame, costs: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(run_id, pos, day_pos, equity, gross_equity, return) from interval growth and rebalance costs; starts at 1."""
    g = growth.join(F.broadcast(rebalances.select("pos", "next_pos")), "pos").join(costs, ["run_id", "pos"])
    ends = g.where("day_pos = next_pos").select("run_id", "pos", (F.log("growth") + F.log1p(-F.col("cost"))).alias("net"), F.log("growth").alias("gross"))
    before = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("run_id", "pos", F.coalesce(F.sum("net").over(before), F.lit(0.0)).alias("net0"), F.coalesce(F.sum("gross").over(before), F.lit(0.0)).alias("gross0"))
    days = g.join(base, ["run_id", "pos"]).select("run_id", "pos", "day_pos", (F.exp("net0") * (1 - F.col("cost")) * F.col("growth")).alias("equity"), (F.exp("gross0") * F.col("growth")).alias("gross_equity"))
    order = Window.partitionBy("run_id").orderBy("day_pos")
    return days.withColumn("return", F.col("equity") / F.coalesce(F.lag("equity").over(order), F.lit(1.0)) - 1)


def rebalance_log(targets: DataFrame, turned: DataFrame, costs: DataFrame, curve: DataFrame) -> DataFrame:
    """One row per rebalance: names held, turnover, cost, equity before, value of the cost, return of the interval."""
    names = targets.where("symbol <> 'CASH' and weight > 0").groupBy("run_id", "pos").agg(F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("selected"), F.count("*").alias("positions"))
    interval = curve.groupBy("run_id", "pos").agg(F.max_by("equity", "day_pos").alias("end_equity"))
    order = Window.partitionBy("run_id").orderBy("pos")
    before = F.coalesce(F.lag("end_equity").over(order), F.lit(1.0))
    log = interval.withColumn("equity_before", before)
    log = log.join(turned, ["run_id", "pos"]).join(costs, ["run_id", "pos"]).join(names, ["run_id", "pos"], "left")
    return log.select("run_id", "pos", (F.col("pos") - 1).alias("information_through"), "selected", F.coalesce("positions", F.lit(0)).alias("positions"), "turnover", "cost",
                      (F.col("equity_before") * F.col("cost")).alias("cost_value"), (F.col("end_equity") / F.col("equity_before") - 1).alias("period_return"))


def performance_metrics(curve: DataFrame, log: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per run, dearest Sharpe ratio first."""
    order = Window.partitionBy("run_id").orderBy("day_pos")
    rows = curve.join(F.broadcast(calendar.select(F.col("pos").alias("day_pos"), "date")), "day_pos")
    rows = rows.withColumn("fall", F.col("equity") / F.greatest(F.max("equity").over(order), F.lit(1.0)) - 1)
    m = rows.groupBy("run_id").agg(
        F.max_by("equity", "day_pos").alias("final"), F.max_by("gross_equity", "day_pos").alias("gross"), F.stddev_samp("return").alias("sd"), F.avg("return").alias("mean"),
        F.min("fall").alias("max_drawdown"), F.date_diff(F.max("date"), F.min("date")).alias("days"))
    l = log.groupBy("run_id").agg(F.avg("turnover").alias("average_turnover"), F.sum("cost_value").alias("fees"))
    vol = F.when(F.col("sd") * F.sqrt(F.lit(DAYS)) < 1e-12, 0.0).otherwise(F.col("sd") * F.sqrt(F.lit(DAYS)))
    out = m.join(l, "run_id", "left").select(
        "run_id", (F.pow("final", F.lit(365.25) / F.col("days")) - 1).alias("cagr"), vol.alias("volatility"), F.when(vol > 0, F.col("mean") * DAYS / vol).alias("sharpe"),
        F.col("max_drawdown"), "average_turnover", (F.col("gross") - F.col("final")).alias("cost_drag"), "fees", F.col("final").alias("final_equity"))
    return out.orderBy(F.desc_nulls_last("sharpe"), "run_id")


def equal_weight_benchmark(panel: DataFrame, start: int, end: int) -> DataFrame:
    """Mean growth since `start` over the symbols that have a price there."""
    first = panel.where(F.col("pos") == start).where("close is not null").select("symbol", F.col("close").alias("p0"))
    rows = panel.where((F.col("pos") >= start) & (F.col("pos") <= end)).join(first, "symbol")
    return rows.groupBy("date", "pos").agg(F.avg(F.col("close") / F.col("p0")).alias("benchmark"))


def drawdown_series(curve: DataFrame) -> DataFrame:
    top = F.max("equity").over(Window.partitionBy("run_id").orderBy("day_pos"))
    return curve.select("run_id", "day_pos", (F.col("equity") / F.greatest(top, F.lit(1.0)) - 1).alias("drawdown"))


def rolling_return(curve: DataFrame, width: int = 63) -> DataFrame:
    back = F.lag("equity", width).over(Window.partitionBy("run_id").orderBy("day_pos"))
    return curve.select("run_id", "day_pos", (F.col("equity") / back - 1).alias("rolling_return"))


def concentration(weights: DataFrame) -> DataFrame:
    """Herfindahl index and the largest three and five shares of positive risky weights."""
    risky = weights.where("symbol <> 'CASH' and weight > 0")
    share = risky.select("run_id", "pos", (F.col("weight") / F.sum("weight").over(Window.partitionBy("run_id", "pos"))).alias("w"), F.row_number().over(Window.partitionBy("run_id", "pos").orderBy(F.desc("weight"), "symbol")).alias("n"))
    return share.groupBy("run_id", "pos").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.sum(F.when(F.col("n") <= 3, F.col("w"))).alias("top_3"), F.sum(F.when(F.col("n") <= 5, F.col("w"))).alias("top_5"))


def weight_drift(current: DataFrame, reference: DataFrame) -> DataFrame:
    joined = current.select("run_id", "symbol", F.col("weight").alias("a")).join(reference.select("run_id", "symbol", F.col("weight").alias("b")), ["run_id", "symbol"], "full")
    return joined.select("run_id", "symbol", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("drift"))


def downsample_extrema(series: DataFrame, buckets: int = 1000, limit: int = 2000) -> DataFrame:
    """(pos, value): lowest and highest point of each of `buckets` stretches when there are more than `limit` points."""
    # places are counted inside slices of the range of positions, whose few totals meet in one window
    span = series.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    sliced = series.select("pos", "value").crossJoin(F.broadcast(span)).withColumn("slice", F.floor((F.col("pos") - F.col("lo")) * 1024 / (F.col("hi") - F.col("lo") + 1)))
    before = sliced.groupBy("slice").count().select("slice", (F.sum("count").over(Window.orderBy("slice")) - F.col("count")).alias("before"))
    rows = sliced.join(before, "slice").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("pos")) - 1)
    cells = rows.withColumn("bucket", F.when(F.col("n") > limit, F.floor(F.col("i") * buckets / F.col("n"))).otherwise(F.col("i")))
    ends = cells.groupBy("bucket").agg(F.min_by("pos", F.struct("value", "pos")).alias("low"), F.min_by("pos", F.struct(-F.col("value"), "pos")).alias("high"))
    return series.join(ends.select(F.explode(F.array("low", "high")).alias("pos")).distinct(), "pos").select("pos", "value")


def return_contributions(held: DataFrame, targets: DataFrame, panel: DataFrame, curve: DataFrame) -> DataFrame:
    """(run_id, symbol, contribution): what each symbol added to the gross return; cash adds nothing."""
    by = Window.partitionBy("run_id", "pos", "symbol").orderBy("day_pos")
    rows = held.join(targets.select("run_id", "pos", "symbol", F.col("weight").alias("first")), ["run_id", "pos", "symbol"], "left").withColumn("w", F.coalesce(F.lag("weight").over(by), "first"))
    moves = panel.select("symbol", F.col("pos").alias("day_pos"), (F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("pos")) - 1).alias("move"))
    before = curve.select("run_id", "day_pos", F.coalesce(F.lag("gross_equity").over(Window.partitionBy("run_id").orderBy("day_pos")), F.lit(1.0)).alias("g"))
    risky = rows.where("symbol <> 'CASH'").join(moves, ["symbol", "day_pos"]).join(before, ["run_id", "day_pos"])
    return risky.groupBy("run_id", "symbol").agg(F.sum(F.col("w") * F.col("move") * F.col("g")).alias("contribution"))
