"""Leak-free features, targets, risk estimates and forecast evidence over a long panel (symbol, date, pos, close)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lake import settled
from .panel import by_symbol

YEAR = 252
FEATURES = ("momentum_21d", "momentum_63d", "momentum_126d", "volatility_21d", "volatility_63d", "trend_21d", "trend_63d", "trend_126d", "volatility_126d", "drawdown_126d")


def over_full(agg, column: Column, width: int) -> Column:
    """A rolling aggregate that is null until `width` values are there."""
    w = by_symbol().rowsBetween(1 - width, 0)
    return F.when(F.count(column).over(w) == width, agg(column).over(w))


def daily_returns(panel: DataFrame) -> DataFrame:
    """r: change of close since the row before; null where either is missing or the change isn't finite."""
    back = F.lag("close").over(by_symbol())
    return panel.withColumn("r", F.when((back != 0) & F.col("close").isNotNull(), F.col("close") / back - 1))


def momentum(width: int) -> Column:
    back = F.lag("close", width).over(by_symbol())
    return F.when(back != 0, F.col("close") / back - 1)


def volatility(width: int) -> Column:
    return over_full(F.stddev_samp, F.col("r"), width) * F.sqrt(F.lit(float(YEAR)))


def trend(width: int) -> Column:
    mean = over_full(F.avg, F.col("close"), width)
    return F.when(mean != 0, F.col("close") / mean - 1)


def drawdown(width: int) -> Column:
    top = over_full(F.max, F.col("close"), width)
    return F.when(top != 0, F.col("close") / top - 1)


def raw_features(panel: DataFrame) -> DataFrame:
    """The ten features, each as of the row before."""
    made = {"momentum": momentum, "volatility": volatility, "trend": trend, "drawdown": drawdown}
    now = daily_returns(panel).select("symbol", "date", "pos", *[made[name.split("_")[0]](int(name.split("_")[1][:-1])).alias(name) for name in FEATURES])
    return now.select("symbol", "date", "pos", *[F.lag(name).over(by_symbol()).alias(name) for name in FEATURES])


def xs_zscore(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Columns standardised across the symbols of a date, by the population deviation; null where that is 0."""
    day = Window.partitionBy("date")
    return df.select("symbol", "date", "pos", *[((F.col(c) - F.avg(c).over(day)) / F.nullif(F.stddev_pop(c).over(day), F.lit(0.0))).alias(c) for c in columns])


def feature_panel(panel: DataFrame) -> DataFrame:
    """Standardised features; rows without any go, single gaps become 0."""
    return xs_zscore(raw_features(panel), FEATURES).dropna(how="all", subset=list(FEATURES)).fillna(0.0, list(FEATURES))


def forward_return(panel: DataFrame, horizon: int = 21) -> DataFrame:
    ahead = F.lead("close", horizon).over(by_symbol())
    return panel.select("symbol", "date", "pos", F.when(F.col("close") != 0, ahead / F.col("close") - 1).alias("forward_return"))


def ridge_daily_stats(features: DataFrame, target: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per date the sums that a ridge fit needs: n, sum of y, of each x, of x*y and of each product of two features."""
    both = features.join(target.select("symbol", "date", F.col("forward_return").alias("y")), ["symbol", "date"]).dropna(subset=[*columns, "y"])
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)] + [F.sum(F.col(c) * F.col("y")).alias(f"xy_{i}") for i, c in enumerate(columns)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return both.groupBy("date", "pos").agg(F.count("*").alias("n"), F.sum("y").alias("s_y"), *sums)


#: positions of a block of running sums
SUM_BLOCK = 1024


def window_sums(stats: DataFrame, spans: DataFrame, names: list[str]) -> DataFrame:
    """(decision, sums): a map of the sums of `names`, and of `days`, the rows, over lo <= pos <= hi of each span (decision, lo, hi).

    A sum over a window is the difference of two prefix sums. Ends of windows stand among the rows as marks; each name's sums
    run inside blocks of `SUM_BLOCK` positions, and one number for each block is carried on. Spans without rows are left out.
    """
    end = F.struct(F.col("hi").alias("pos"), F.lit(1).alias("sign"))
    begin = F.struct((F.col("lo") - 1).alias("pos"), F.lit(-1).alias("sign"))
    marks = spans.where("lo <= hi").select("decision", F.inline(F.array(begin, end))).select("pos", F.explode(F.array(*map(F.lit, ["days", *names]))).alias("name"), F.lit(0.0).alias("value"), "decision", "sign")
    facts = stats.select(F.col("pos").cast("long").alias("pos"), F.lit(1.0).alias("days"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot("pos", ["days", *names], "name", "value")
    rows = facts.select("*", F.lit(None).cast("long").alias("decision"), F.lit(0).alias("sign")).unionByName(marks).withColumn("block", F.floor(F.col("pos") / SUM_BLOCK)).repartition("name", "block")  # read twice below
    # a mark stands after the row of its position
    inside = Window.partitionBy("name", "block").orderBy("pos", F.abs("sign"), "decision").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("name", "block", "decision", "sign", F.sum("value").over(inside).alias("value")).where("sign <> 0")
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("name", "block").agg(F.sum("value").alias("v")).select("name", "block", F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("before"))
    sums = running.join(blocks, ["name", "block"]).groupBy("decision", "name").agg(F.sum(F.col("sign") * (F.col("value") + F.col("before"))).alias("value"))
    return sums.groupBy("decision").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("sums")).where("sums['days'] > 0")


def ridge_spans(decisions: DataFrame, train: int = 504, horizon: int = 21, first: int = 126) -> DataFrame:
    """(decision, lo, hi): the days whose labels a fit at each decision may use."""
    d = F.col("pos").cast("long")
    return decisions.select(d.alias("decision"), F.greatest(F.lit(first), d - train).alias("lo"), (d - 1 - horizon).alias("hi")).distinct()


def ridge_windows(stats: DataFrame, decisions: DataFrame, columns: tuple[str, ...] = FEATURES, train: int = 504, horizon: int = 21, alpha: float = 8.0, first: int = 126) -> DataFrame:
    """(pos, n, days, base, mean, beta): ridge coefficients for each decision from the labels of so many days that had matured by then."""
    p = len(columns)
    names = ["n", "s_y", *[f"s_{i}" for i in range(p)], *[f"xy_{i}" for i in range(p)], *[f"xx_{i}_{j}" for i in range(p) for j in range(i, p)]]
    sums = window_sums(stats, ridge_spans(decisions, train, horizon, first), names)

    def solve(parts):
        for part in parts:
            rows = []
            for decision, r in zip(part["decision"], map(dict, part["sums"]), strict=True):
                n, days = round(r["n"]), round(r["days"])
                if n < max(40, 4 * p):
                    rows.append((decision, n, days, 0.0, [0.0] * p, [0.0] * p))
                    continue
                s, xy = (np.array([r[f"{k}_{i}"] for i in range(p)]) for k in ("s", "xy"))
                xx = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        xx[i, j] = xx[j, i] = r[f"xx_{i}_{j}"]
                mean, base = s / n, r["s_y"] / n
                c = xx - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
                sd = np.where(sd < 1e-12, 1.0, sd)
                beta = np.linalg.solve(c / np.outer(sd, sd) + alpha * np.eye(p), (xy - n * mean * base) / sd) / sd
                rows.append((decision, n, days, float(base), mean.tolist(), beta.tolist()))
            yield pd.DataFrame(rows, columns=["pos", "n", "days", "base", "mean", "beta"])

    return sums.mapInPandas(solve, "pos long, n long, days long, base double, mean array<double>, beta array<double>")


def ridge_scores(features: DataFrame, fits: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(symbol, date, pos, prediction, baseline) at each decision."""
    terms = sum(((F.coalesce(F.col(c), F.lit(0.0)) - F.col("mean")[i]) * F.col("beta")[i] for i, c in enumerate(columns)), F.lit(0.0))
    return features.join(fits, "pos").select("symbol", "date", "pos", (F.col("base") + terms).alias("prediction"), F.col("base").alias("baseline"))


#: symbols of a block of returns
SYMBOL_BLOCK = 128


def return_blocks(returns: DataFrame, decisions: DataFrame, window: int = YEAR, size: int = SYMBOL_BLOCK) -> DataFrame:
    """(decision, block, blocks, days, symbols, pos, x): the returns of the `window` days before each decision by blocks of symbols.

    x holds `symbols` by `pos` as bytes of doubles, NaN where a symbol has no row; a null return is 0. A block has about
    `size` symbols, which a hash deals.
    """
    blocks = max(1, -(-returns.select("symbol").distinct().count() // size))
    days = decisions.select(F.col("pos").cast("long").alias("decision")).distinct().select("decision", F.explode(F.sequence(F.col("decision") - window, F.col("decision") - 1)).alias("pos"))
    rows = returns.select("symbol", F.col("pos").cast("long").alias("pos"), F.coalesce("r", F.lit(0.0)).alias("r")).join(days, "pos").withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        symbols, i = np.unique(table["symbol"].to_numpy(zero_copy_only=False), return_inverse=True)
        pos, j = np.unique(table["pos"].to_numpy(), return_inverse=True)
        x = np.full((len(symbols), len(pos)), np.nan)
        x[i, j] = table["r"].to_numpy()
        return pa.table({"decision": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "blocks": pa.array([blocks], pa.int32()), "symbols": [symbols.tolist()], "pos": [pos.tolist()], "x": [x.tobytes()]})

    return rows.select("decision", "block", "symbol", "pos", "r").groupBy("decision", "block").applyInArrow(pack, "decision long, block int, blocks int, symbols array<string>, pos array<bigint>, x binary")


def shrinkage_covariance(returns: DataFrame, decisions: DataFrame, shrinkage: float = 0.25, window: int = YEAR, size: int = SYMBOL_BLOCK) -> DataFrame:
    """(decision, i, j, cov) for i <= j: annual covariance shrunk to its diagonal, with a small ridge on it.

    Blocks of symbols meet in pairs, each pair of a decision in a place of its own; their sums over common days are matrix products.
    """
    packed = settled(return_blocks(returns, decisions, window, size))
    side = lambda p, other: packed.select("decision", *[F.col(c).alias(f"{p}_{c}") for c in ("block", "symbols", "pos", "x")], other)
    left = side("a", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b_block"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("a_block"))

    def products(batches):
        for batch in batches:
            for r in batch.to_pylist():
                days, ai, bi = np.intersect1d(r["a_pos"], r["b_pos"], return_indices=True)
                a, b = (np.frombuffer(r[f"{p}_x"]).reshape(len(r[f"{p}_symbols"]), -1)[:, at] for p, at in (("a", ai), ("b", bi)))
                ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
                a, b = np.nan_to_num(a), np.nan_to_num(b)
                n, sa, sb = ma @ mb.T, a @ mb.T, ma @ b.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (a @ b.T - sa * sb / n) / (n - 1)
                i, j = (np.array(r[f"{p}_symbols"], object) for p in ("a", "b"))
                first = i[:, None] <= j[None, :]
                # two blocks hold each pair once, in either order; a block with itself holds it twice
                keep = (n > 0) & (first if r["a_block"] == r["b_block"] else True)
                p, q = np.nonzero(keep)
                low, high = np.where(first[p, q], i[p], j[q]), np.where(first[p, q], j[q], i[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), r["decision"])), pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(s[p, q]), pa.array(n[p, q].astype(np.int64))], ["decision", "i", "j", "s", "n"])

    pairs = left.join(right, ["decision", "a_block", "b_block"]).mapInArrow(products, "decision long, i string, j string, s double, n long")
    same = F.col("i") == F.col("j")
    cov = F.when(F.col("n") < 20, F.when(same, 0.04).otherwise(0.0)).otherwise(F.col("s") * YEAR * F.when(same, 1.0).otherwise(1 - shrinkage) + F.when(same, 1e-6).otherwise(0.0))
    kind = decisions.schema["pos"].dataType
    return pairs.select(F.col("decision").cast(kind).alias("decision"), "i", "j", cov.alias("cov"))


def market_regime(returns: DataFrame, window: int = 63) -> DataFrame:
    """Per date the market's return and volatility over the window before it, and the regime they name."""
    daily = returns.groupBy("date", "pos").agg(F.avg("r").alias("m")).where("m is not null")
    w = Window.orderBy("pos").rowsBetween(-window, -1)
    seen = daily.select("date", "pos", F.count("m").over(w).alias("n"), (F.exp(F.sum(F.log1p("m")).over(w)) - 1).alias("market_return"), (F.stddev_samp("m").over(w) * F.sqrt(F.lit(float(YEAR)))).alias("market_volatility"))
    ret, vol = F.col("market_return"), F.col("market_volatility")
    regime = F.when(F.col("n") < window, "insufficient-history").when((ret < -0.08) & (vol > 0.22), "risk-off").when((ret > 0.08) & (vol < 0.24), "risk-on").when(vol > 0.28, "high-volatility").otherwise("neutral")
    return seen.select("date", "pos", "market_return", "market_volatility", regime.alias("regime"))


def investable(eligible: DataFrame, decisions: DataFrame, min_history: int = YEAR) -> DataFrame:
    """(symbol, pos): symbols that have been listed for `min_history` rows at a decision, or have no late start."""
    return eligible.crossJoin(F.broadcast(decisions.select("pos"))).where(F.col("listed_pos").isNull() | (F.col("listed_pos") + min_history <= F.col("pos"))).select("symbol", "pos")


def validation_origins(decisions: DataFrame, train: int = 504, horizon: int = 21, first: int = 126, least_days: int = 40, blocks: int = 6) -> DataFrame:
    """(decision, pos): the last `blocks` origins, a horizon apart, whose outcomes are known before each decision."""
    d = F.col("pos")
    begin = F.greatest(d - train + first, F.lit(first)) + least_days + horizon
    line = F.when(begin <= d - horizon - 1, F.sequence(begin, d - horizon - 1, F.lit(horizon)))
    return decisions.select(d.alias("decision"), F.explode(F.slice(line, F.greatest(F.size(line) - blocks + 1, F.lit(1)), blocks)).alias("pos"))


def validation_blocks(features: DataFrame, target: DataFrame, decisions: DataFrame, columns: tuple[str, ...] = FEATURES, train: int = 504, horizon: int = 21, least_days: int = 40) -> DataFrame:
    """(decision, date, pos, symbol, prediction, actual, baseline): what the fits of each decision's origins said and what came."""
    origins = validation_origins(decisions, train, horizon, least_days=least_days)
    fits = ridge_windows(ridge_daily_stats(features, target, columns), origins.select("pos").distinct(), columns, train, horizon)
    said = ridge_scores(features, fits.where(F.col("days") >= least_days), columns)
    rows = said.join(target.select("symbol", "pos", F.col("forward_return").alias("actual")), ["symbol", "pos"]).join(origins, "pos")
    return rows.select("decision", "date", "pos", "symbol", "prediction", "actual", "baseline").dropna(subset=["prediction", "actual", "baseline"])


def forecast_evidence(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each `by`) on (date, symbol, prediction, actual, baseline): skill, win rate, rank correlation, hit rate, eligibility, confidence."""
    day = Window.partitionBy(*by, "date")

    def rank(c: str) -> Column:
        return F.rank().over(day.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, "date", c)) - 1) / 2.0

    ranked = records.select("*", rank("prediction").alias("rp"), rank("actual").alias("ra"))
    error, naive = F.pow(F.col("prediction") - F.col("actual"), 2), F.pow(F.col("baseline") - F.col("actual"), 2)
    blocks = ranked.groupBy(*by, "date").agg(F.sum(error).alias("e"), F.sum(naive).alias("b"), F.count("*").alias("n"), F.coalesce(F.corr("rp", "ra"), F.lit(0.0)).alias("ic"),
                                             F.count_if(F.signum("prediction") == F.signum("actual")).alias("hits"), F.stddev_pop("rp").alias("sp"), F.stddev_pop("ra").alias("sa"))
    ic = F.when((F.col("sp") == 0) | (F.col("sa") == 0), 0.0).otherwise(F.col("ic"))
    total = blocks.groupBy(*by).agg(F.sqrt(F.sum("e") / F.sum("n")).alias("rmse"), F.sqrt(F.sum("b") / F.sum("n")).alias("baseline_rmse"), F.avg(F.when(F.col("e") < F.col("b"), 1.0).otherwise(0.0)).alias("win_rate"),
                                    F.avg(ic).alias("mean_ic"), (F.sum("hits") / F.sum("n")).alias("hit_rate"), F.count("*").alias("blocks"))
    skill = F.when(F.col("baseline_rmse") > 1e-12, 1 - F.col("rmse") / F.col("baseline_rmse")).otherwise(0.0)
    total = total.withColumn("skill", skill)
    good = (F.col("blocks") >= 3) & (F.col("skill") > 0) & (F.col("win_rate") > 0.5) & (F.col("mean_ic") > 0)
    return total.withColumn("eligible", good).withColumn("confidence", F.when(good, F.least(F.greatest("skill", F.lit(0.0)), F.lit(1.0))).otherwise(0.0))


def forecast_outcomes(scores: DataFrame, evidence: DataFrame, target: DataFrame, covariance: DataFrame, allowed: DataFrame, last: int, horizon: int = 21) -> DataFrame:
    """(date, pos, symbol, expected_return, adjusted_return, actual_return, annualized_volatility, effective_method) of each decision.

    Expected returns are null for symbols that are not `allowed` (symbol, pos) yet, adjusted ones are scaled by the evidence's
    confidence; a decision without evidence falls back to equal weights. Outcomes after position `last` are not known.
    """
    own = allowed.select("symbol", "pos", F.lit(True).alias("ok"))
    told = evidence.select(F.col("decision").alias("pos"), "confidence", "eligible")
    deviation = covariance.where("i = j").select(F.col("decision").alias("pos"), F.col("i").alias("symbol"), F.sqrt("cov").alias("annualized_volatility"))
    rows = scores.join(told, "pos", "left").join(own, ["symbol", "pos"], "left").join(target.select("symbol", "pos", "forward_return"), ["symbol", "pos"], "left").join(deviation, ["symbol", "pos"], "left")
    expected = F.when(F.col("ok"), F.col("prediction"))
    return rows.select("date", "pos", "symbol", expected.alias("expected_return"), (expected * F.coalesce("confidence", F.lit(0.0))).alias("adjusted_return"), F.when(F.col("pos") + horizon <= last, F.col("forward_return")).alias("actual_return"),
                       F.when(F.col("ok"), F.col("annualized_volatility")).alias("annualized_volatility"), F.when(F.col("eligible"), "ML mean-variance").otherwise("Equal weight").alias("effective_method"))


def factor_covariance(returns: DataFrame, decisions: DataFrame, n_factors: int = 10, window: int = YEAR, size: int = SYMBOL_BLOCK) -> DataFrame:
    """(decision, symbol, loadings, specific, factor_var): a statistical factor model of the window before each decision.

    Each block of symbols gives its part of the days' Gram matrix (window x window), parts are added up in two steps, and the
    leading vectors are the factors of a decision. Loadings are one product of a block with them. Symbols need not have a
    row on each day; a missing one counts as the symbol's mean.
    """
    packed = settled(return_blocks(returns, decisions, window, size))
    symbols = returns.select("symbol").distinct().count()

    def centred(r: dict) -> np.ndarray:
        x = np.frombuffer(r["x"]).reshape(len(r["symbols"]), -1)
        return np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))

    def gram(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = centred(r)
                yield pa.RecordBatch.from_arrays([pa.array([r["decision"]]), pa.array([r["block"] % 32], pa.int32()), pa.array([r["pos"]], pa.list_(pa.int64())), pa.array([(x.T @ x).tobytes()], pa.binary())], ["decision", "part", "pos", "g"])

    def total(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        days = np.unique(np.concatenate(table["pos"].to_pylist()))
        g = np.zeros((len(days), len(days)))
        for pos, cell in zip(table["pos"].to_pylist(), table["g"].to_pylist(), strict=True):
            at = np.searchsorted(days, pos)
            g[np.ix_(at, at)] += np.frombuffer(cell).reshape(len(at), -1)
        return days, g

    def add(key: tuple, table: pa.Table) -> pa.Table:
        days, g = total(table)
        return pa.table({"decision": [key[0].as_py()], "pos": pa.array([days.tolist()], pa.list_(pa.int64())), "g": [g.tobytes()]})

    def factors(key: tuple, table: pa.Table) -> pa.Table:
        days, g = total(table)
        k = max(1, min(n_factors, len(days) - 1, symbols))
        values, vectors = np.linalg.eigh(g)
        lead = np.argsort(values)[::-1][:k]
        scale = np.sqrt(np.maximum(values[lead], 1e-18))
        variance = np.maximum(values[lead], 0) / max(len(days) - 1, 1) * YEAR
        return pa.table({"decision": [key[0].as_py()], "f_pos": pa.array([days.tolist()], pa.list_(pa.int64())), "scale": [scale.tolist()], "factor_var": [variance.tolist()], "u": [np.ascontiguousarray(vectors[:, lead]).tobytes()]})

    parts = packed.mapInArrow(gram, "decision long, part int, pos array<bigint>, g binary").groupBy("decision", "part").applyInArrow(add, "decision long, pos array<bigint>, g binary")
    found = parts.groupBy("decision").applyInArrow(factors, "decision long, f_pos array<bigint>, scale array<double>, factor_var array<double>, u binary")

    def loads(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, scale = centred(r), np.array(r["scale"])
                u = np.frombuffer(r["u"]).reshape(-1, len(scale))[np.searchsorted(r["f_pos"], r["pos"])]
                loadings = x @ u / scale
                specific = ((x * x).sum(1) - (loadings**2 * scale**2).sum(1)) / max(len(r["f_pos"]) - 1, 1) * YEAR
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([r["decision"]] * n), pa.array(r["symbols"]), pa.array(loadings.tolist(), pa.list_(pa.float64())), pa.array(np.maximum(specific, 1e-6) + 1e-6), pa.array([r["factor_var"]] * n, pa.list_(pa.float64()))], ["decision", "symbol", "loadings", "specific", "factor_var"])

    return packed.join(found, "decision").select("decision", "symbols", "pos", "x", "f_pos", "scale", "factor_var", "u").mapInArrow(loads, "decision long, symbol string, loadings array<double>, specific double, factor_var array<double>")
