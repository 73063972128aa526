"""Rule-based scores, selection and closed-form weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import over_full
from .panel import by_symbol


def sma_trend(panel: DataFrame, fast: int, slow: int) -> DataFrame:
    """score: fast over slow average less 1, while fast stands above slow."""
    a, b = over_full(F.avg, F.col("close"), fast), over_full(F.avg, F.col("close"), slow)
    return panel.select("symbol", "date", "pos", F.when(a - b > 0, a / b - 1).alias("score"))


def sma_cross(panel: DataFrame, fast: int, slow: int, rebalance_days: int) -> DataFrame:
    """As sma_trend, only where fast crossed above slow within the last `rebalance_days` rows."""
    a, b = over_full(F.avg, F.col("close"), fast), over_full(F.avg, F.col("close"), slow)
    both = panel.select("symbol", "date", "pos", a.alias("a"), b.alias("b"))
    gap = F.col("a") - F.col("b")
    crossed = both.withColumn("up", F.when((gap > 0) & (F.lag(gap).over(by_symbol()) <= 0), 1).otherwise(0))
    recent = F.max("up").over(by_symbol().rowsBetween(1 - rebalance_days, 0)) == 1
    return crossed.select("symbol", "date", "pos", F.when(recent & (gap > 0), F.col("a") / F.col("b") - 1).alias("score"))


def rsi_wilder(panel: DataFrame, period: int = 14, threshold: float = 30.0) -> DataFrame:
    """Wilder's index and its score; the smoothing is a recursion, so each symbol's series is one linear scan."""
    import numpy as np
    import pandas as pd

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        x = g["close"].to_numpy(float)
        change = np.diff(x, prepend=np.nan)
        gain, loss = np.clip(change, 0, None), np.clip(-change, 0, None)
        out = np.full(len(x), np.nan)
        up = down = 0.0
        for t in range(period, len(x)):
            if t == period:
                up, down = gain[1 : period + 1].mean(), loss[1 : period + 1].mean()
            else:
                up, down = (up * (period - 1) + gain[t]) / period, (down * (period - 1) + loss[t]) / period
            out[t] = 50.0 if up == 0 and down == 0 else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        rsi = pd.Series(out).where(~np.isnan(out), None).astype(object)
        return pd.DataFrame({"symbol": g["symbol"].to_numpy(), "date": g["date"].to_numpy(), "pos": g["pos"].to_numpy(), "rsi": rsi.to_numpy()})

    series = panel.where("close is not null").select("symbol", "date", "pos", "close")
    out = series.groupBy("symbol").applyInPandas(scan, "symbol string, date date, pos int, rsi double")
    return out.withColumn("score", F.when(F.col("rsi") < threshold, 100 - F.col("rsi")))


def momentum_score(panel: DataFrame, lookback: int, positive_only: bool = True) -> DataFrame:
    m = F.col("close") / F.lag("close", lookback).over(by_symbol()) - 1
    return panel.select("symbol", "date", "pos", (F.when(m > 0, m) if positive_only else m).alias("score"))


def lagged_score(scores: DataFrame) -> DataFrame:
    """Scores as of the row before."""
    return scores.withColumn("score", F.lag("score").over(by_symbol()))


def mask_scores(scores: DataFrame, eligible: DataFrame, warmup: int) -> DataFrame:
    """No score after a symbol's last real row, nor before `warmup` rows of its listing; eligible: (symbol, listed_pos, cutoff_pos)."""
    joined = scores.join(F.broadcast(eligible), "symbol", "left")
    ok = (F.col("cutoff_pos").isNull() | (F.col("pos") <= F.col("cutoff_pos"))) & (F.col("listed_pos").isNull() | (F.col("pos") > F.col("listed_pos") + warmup))
    return joined.select("symbol", "date", "pos", F.when(ok, F.col("score")).alias("score"))


def rebalance_dates(calendar: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Calendar rows start, start + step, ... before end; next_pos is where the interval ends."""
    rows = calendar.where((F.col("pos") >= start) & (F.col("pos") < end) & ((F.col("pos") - start) % step == 0))
    return rows.withColumn("next_pos", F.least(F.col("pos") + step, F.lit(end)))


def select_top_n(scores: DataFrame, rebalances: DataFrame, n: int) -> DataFrame:
    """The n best scores of each rebalance; ties go by symbol."""
    at = scores.where("score is not null").join(F.broadcast(rebalances.select("pos")), "pos")
    best = Window.partitionBy("pos").orderBy(F.desc("score"), "symbol")
    return at.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def capped_weights(raw: DataFrame, total: Column, cap: Column, key: str = "pos") -> DataFrame:
    """raw shared out to `total` with no weight above `cap`; what can't be placed stays in cash.

    raw descends: if k names stand at the cap, the others share total - k * cap by raw. The smallest k for which the
    next name stays under the cap holds, so running sums replace a loop.
    """
    rows = raw.withColumn("raw", F.when(F.col("raw") > 0, F.col("raw")).otherwise(0.0)).withColumn("total", total).withColumn("cap", cap)
    group = Window.partitionBy(key)
    rows = rows.withColumn("raw", F.when(F.sum("raw").over(group) > 0, F.col("raw")).otherwise(1.0)).withColumn("names", F.count("*").over(group))
    by = group.orderBy(F.desc("raw"), "symbol")
    rows = rows.withColumn("k", F.row_number().over(by) - 1).withColumn("tail", F.sum("raw").over(by.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("fits", (F.col("total") - F.col("k") * F.col("cap")) * F.col("raw") <= F.col("cap") * F.col("tail") * (1 + 1e-12))
    rows = rows.withColumn("placed", F.min(F.when(F.col("fits"), F.struct("k", "tail"))).over(group))
    left = F.greatest(F.col("total") - F.col("placed.k") * F.col("cap"), F.lit(0.0))
    # where only names of raw 0 are left, they share equally
    open_ = F.when(F.col("placed.tail") > 0, left * F.col("raw") / F.col("placed.tail")).otherwise(F.least(F.col("cap"), left / F.greatest(F.col("names") - F.col("placed.k"), F.lit(1))))
    weight = F.when(F.col("placed.k").isNull() | (F.col("k") < F.col("placed.k")), F.least("cap", "total")).otherwise(F.least("cap", open_))
    return rows.select(key, "symbol", weight.alias("weight"))


def with_cash(weights: DataFrame, key: str = "pos") -> DataFrame:
    """The weights and a CASH row for what is left of 1."""
    cash = weights.groupBy(key).agg((1 - F.sum("weight")).alias("weight")).select(key, F.lit("CASH").alias("symbol"), "weight")
    return weights.unionByName(cash)


def equal_weight_target(selected: DataFrame, cash: float, cap: float) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("pos"))
    return with_cash(capped_weights(selected.select("pos", "symbol", F.lit(1.0).alias("raw"), n.alias("n")), F.least(F.lit(1 - cash), F.col("n") * cap), F.lit(cap)))


def inverse_vol_target(selected: DataFrame, returns: DataFrame, cash: float, cap: float, tail: int = 126) -> DataFrame:
    """Weights by the inverse deviation of the last `tail` returns before the rebalance."""
    recent = F.stddev_samp("r").over(by_symbol().rowsBetween(-tail, -1))
    raw = returns.select("symbol", "pos", F.when(recent > 0, 1 / recent).otherwise(0.0).alias("raw"))
    chosen = selected.select("pos", "symbol").join(raw, ["pos", "symbol"]).withColumn("n", F.count("*").over(Window.partitionBy("pos")))
    return with_cash(capped_weights(chosen, F.least(F.lit(1 - cash), F.col("n") * cap), F.lit(cap)))
