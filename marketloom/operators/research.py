"""Research summaries, scores and robustness evidence for every symbol or run at once."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lake import settled
from . import equity, signals

from .features import daily_returns

WINDOWS = (21, 63, 126, 252)


def trailing_returns(panel: DataFrame) -> DataFrame:
    by = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = panel.where("close is not null").withColumn("back", F.row_number().over(by) - 1)
    g = rows.groupBy("symbol").agg(F.max(F.when(F.col("back") == 0, F.col("close"))).alias("last"), *[F.max(F.when(F.col("back") == w, F.col("close"))).alias(f"p{w}") for w in WINDOWS])
    return g.select("symbol", "last", *[(F.col("last") / F.col(f"p{w}") - 1).alias(f"return_{w}d") for w in WINDOWS])


def symbol_summary(panel: DataFrame) -> DataFrame:
    """Latest price, full-period return, volatility, Sharpe ratio, drawdown and beta to the equal-weight universe."""
    rows = daily_returns(panel.where("close is not null"))
    market = F.avg("r").over(Window.partitionBy("date"))
    top = F.max("close").over(Window.partitionBy("symbol").orderBy("pos"))
    rows = rows.select("symbol", "date", "close", "r", F.when(F.col("r").isNotNull(), market).alias("m"), (F.col("close") / top - 1).alias("fall"))
    g = rows.groupBy("symbol").agg(F.max_by("close", "date").alias("latest"), F.min_by("close", "date").alias("first"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.min("fall").alias("max_drawdown"), F.covar_samp("r", "m").alias("cov"), F.var_samp("m").alias("var"))
    vol = F.col("sd") * F.sqrt(F.lit(252.0))
    return g.select("symbol", "latest", (F.col("latest") / F.col("first") - 1).alias("total_return"), vol.alias("volatility"), F.when(vol > 0, F.col("mean") * 252 / vol).alias("sharpe"), "max_drawdown", F.when(F.col("var") > 0, F.col("cov") / F.col("var")).alias("beta"))


def trend_state(panel: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    by = Window.partitionBy("symbol").orderBy("pos")

    def mean(n: int) -> Column:
        w = by.rowsBetween(1 - n, 0)
        return F.when(F.count("close").over(w) == n, F.avg("close").over(w))

    last = Window.partitionBy("symbol").orderBy(F.desc("pos"))
    rows = panel.select("symbol", "close", mean(short).alias("a"), mean(long).alias("b"), F.row_number().over(last).alias("n")).where("n = 1")
    state = F.when(F.col("b").isNotNull(), F.when(F.col("close") >= F.col("b"), "above long average").otherwise("below long average")).when(F.col("a").isNotNull(), F.when(F.col("close") >= F.col("a"), "above short average").otherwise("below short average")).otherwise("unknown")
    return rows.select("symbol", "close", F.col("a").alias("sma_short"), F.col("b").alias("sma_long"), state.alias("trend"))


def default_peers(panel: DataFrame, n: int = 5) -> DataFrame:
    """The first n other symbols by name: they are among the first n + 1 of all, so only these meet each symbol."""
    symbols = panel.select("symbol").distinct()
    first = symbols.orderBy("symbol").limit(n + 1).select(F.col("symbol").alias("peer"))
    pairs = symbols.crossJoin(F.broadcast(first)).where("symbol <> peer")
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("peer"))).where(F.col("k") <= n).drop("k")


def peer_table(panel: DataFrame, peers: DataFrame) -> DataFrame:
    """Per symbol: median half-year return of its peers and the best of them."""
    r = trailing_returns(panel).select(F.col("symbol").alias("peer"), "return_126d")
    g = peers.join(r, "peer").groupBy("symbol")
    return g.agg(F.percentile("return_126d", F.lit(0.5)).alias("peer_median"), F.max_by("peer", F.struct("return_126d", "peer")).alias("best_peer"))


def scaled(x: Column, lo: float, hi: float) -> Column:
    """0 to 100 between the bounds; 50 where unknown."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo))) * 100
    return F.when(x.isNull() | F.isnan(x), 50.0).otherwise(y)


def research_scores(panel: DataFrame, peers: DataFrame) -> DataFrame:
    rows = trailing_returns(panel).join(symbol_summary(panel).select("symbol", "volatility", "max_drawdown"), "symbol").join(trend_state(panel).select("symbol", "close", "sma_long"), "symbol").join(peer_table(panel, peers), "symbol", "left")
    over = F.coalesce(F.col("close") / F.col("sma_long") - 1, F.col("return_63d"))
    s = rows.select("symbol", scaled(F.col("return_126d"), -0.15, 0.30).alias("momentum"), scaled(over, -0.10, 0.20).alias("trend"),
                    (0.55 * (100 - scaled(F.col("volatility"), 0.10, 0.45)) + 0.45 * scaled(F.col("max_drawdown"), -0.45, -0.08)).alias("risk"), scaled(F.col("return_126d") - F.col("peer_median"), -0.15, 0.15).alias("peer"))
    return s.withColumn("overall", 0.35 * F.col("momentum") + 0.25 * F.col("trend") + 0.25 * F.col("risk") + 0.15 * F.col("peer"))


def scenario_range(panel: DataFrame, width: int = 252, least: int = 20) -> DataFrame:
    """10, 50 and 90 percentiles of rolling returns."""
    by = Window.partitionBy("symbol").orderBy("pos")
    rows = panel.where("close is not null").select("symbol", (F.col("close") / F.lag("close", width).over(by) - 1).alias("r")).where("r is not null")
    g = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile("r", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).where(F.col("n") >= least)
    return g.select("symbol", F.col("p")[0].alias("low"), F.col("p")[1].alias("middle"), F.col("p")[2].alias("high"), "n")


#: runs of one sweep, at most
MAX_SWEEP = 24


#: the settings that each rule reads
RULES = {"momentum": ("lookback",), "sma_trend": ("fast", "slow"), "sma_cross": ("fast", "slow", "hold"), "rsi": ("period", "threshold")}
SETTINGS = "lookback int, fast int, slow int, hold int, period int, threshold double, top_n int"


def settings_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(run_id, rule, the settings, error): one row for each run; what a rule lacks or can't use is an error row."""
    names = [c.split()[0] for c in SETTINGS.split(", ")]
    kinds = {c.split()[0]: float if c.endswith("double") else int for c in SETTINGS.split(", ")}
    plain = [(r.get("run_id") or "-".join(str(r[c]) for c in ("rule", *names) if r.get(c) is not None), r["rule"], *[None if r.get(c) is None else kinds[c](r[c]) for c in names]) for r in rows]
    table = spark.createDataFrame(plain, f"run_id string, rule string, {SETTINGS}")
    missing = F.lit(None).cast("string")
    for rule, needs in RULES.items():
        missing = F.when((F.col("rule") == rule) & F.array_contains(F.array(*[F.col(c).isNull() for c in (*needs, "top_n")]), True), f"{rule} needs {', '.join(needs)} and top_n").otherwise(missing)
    short = F.exists(F.array("lookback", "fast", "slow", "hold", "period", "top_n"), lambda x: x < 1)
    error = F.when(~F.col("rule").isin(*RULES), "unknown rule").when(missing.isNotNull(), missing).when(short, "windows must be 1 or more")
    return table.withColumn("error", error.when(F.col("rule").startswith("sma") & (F.col("fast") >= F.col("slow")), "fast must be shorter than slow"))


def warmup() -> Column:
    """Rows that a run's rule needs before its first score."""
    return F.when(F.col("rule") == "momentum", F.col("lookback")).when(F.col("rule") == "sma_trend", F.col("slow") - 1).when(F.col("rule") == "sma_cross", F.col("slow")).otherwise(F.col("period"))


def rule_scores(panel: DataFrame, decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, pos, symbol, score) at each decision, of the row before it, for runs of all rules with windows of any width in one job.

    Averages are differences of prefix sums: a run asks for the few rows where its windows begin and end, which is an
    equi-join, however long the windows are. RSI is one scan of a symbol for all periods.
    """
    by = Window.partitionBy("symbol").orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    sums = settled(panel.select("symbol", "pos", (F.row_number().over(by)).alias("k"), "close", F.coalesce(F.sum("close").over(upto), F.lit(0.0)).alias("total"), F.count("close").over(upto).alias("n")))
    known = sums.withColumn("pos", F.col("pos") + 1).join(decisions.select("pos").distinct(), "pos").select("symbol", "pos", "k")
    asked = known.join(runs.where("error is null and rule <> 'rsi'").select("run_id", "rule", "lookback", "fast", "slow", "hold"))
    # step 0 is the row before the decision; a crossing looks back over `hold` rows and the one before them
    steps = F.when(F.col("rule") == "sma_cross", F.sequence(F.lit(0), F.col("hold"))).otherwise(F.array(F.lit(0)))
    point = lambda name, back: F.struct(F.lit(name).alias("point"), (F.col("k") - F.col("step") - back).alias("at"))
    points = F.when(F.col("rule") == "momentum", F.array(point("now", F.lit(0)), point("back", F.col("lookback")))).otherwise(F.array(point("now", F.lit(0)), point("fast", F.col("fast")), point("slow", F.col("slow"))))
    rows = asked.withColumn("step", F.explode(steps)).select("run_id", "rule", "symbol", "pos", "step", "fast", "slow", F.inline(points))
    met = rows.join(sums.select("symbol", F.col("k").alias("at"), "close", "total", "n"), ["symbol", "at"], "left")
    # before the first row nothing has been summed
    met = met.withColumn("total", F.when(F.col("at") == 0, 0.0).otherwise(F.col("total"))).withColumn("n", F.when(F.col("at") == 0, 0).otherwise(F.col("n")))
    of = lambda name, c: F.max(F.when(F.col("point") == name, F.col(c)))
    wide = met.groupBy("run_id", "rule", "symbol", "pos", "step", "fast", "slow").agg(*[of(p, c).alias(f"{c}_{p}") for p in ("now", "back", "fast", "slow") for c in ("close", "total", "n")])
    mean = lambda p: F.when(F.col("n_now") - F.col(f"n_{p}") == F.col(p), (F.col("total_now") - F.col(f"total_{p}")) / F.col(p))
    wide = wide.select("run_id", "rule", "symbol", "pos", "step", mean("fast").alias("a"), mean("slow").alias("b"), F.when(F.col("close_back") != 0, F.col("close_now") / F.col("close_back") - 1).alias("gain"))
    # a sum's difference can miss equal averages by rounding alone
    gap = F.when(F.abs(F.col("a") - F.col("b")) > 1e-9 * F.abs("b"), F.col("a") - F.col("b")).when(F.col("a").isNotNull() & F.col("b").isNotNull(), 0.0)
    wide = wide.withColumn("gap", gap)
    older = Window.partitionBy("run_id", "symbol", "pos").orderBy("step")
    wide = wide.withColumn("up", (F.col("gap") > 0) & (F.lead("gap").over(older) <= 0))
    now = F.max(F.when((F.col("step") == 0) & (F.col("gap") > 0), F.col("a") / F.col("b") - 1))
    one = wide.groupBy("run_id", "rule", "symbol", "pos").agg(now.alias("trend"), F.max("gain").alias("gain"), F.max("up").alias("crossed"))
    score = F.when(F.col("rule") == "momentum", F.when(F.col("gain") > 0, F.col("gain"))).when(F.col("rule") == "sma_trend", F.col("trend")).when(F.col("crossed"), F.col("trend"))
    scores = one.select("run_id", "pos", "symbol", score.alias("score")).where("score is not null")
    periods = [r[0] for r in runs.where("error is null and rule = 'rsi'").select("period").distinct().collect()]  # as many as a grid has
    for period in periods:
        index = signals.rsi_wilder(panel, period).select("symbol", (F.col("pos") + 1).alias("pos"), "rsi").join(decisions.select("pos").distinct(), "pos")
        own = index.join(runs.where((F.col("rule") == "rsi") & F.col("error").isNull() & (F.col("period") == period)).select("run_id", "threshold"))
        scores = scores.unionByName(own.where("rsi < threshold").select("run_id", "pos", "symbol", (100 - F.col("rsi")).alias("score")))
    return scores


def rule_runs(panel: DataFrame, rebalances: DataFrame, runs: DataFrame, cash: float = 0.1) -> DataFrame:
    """(run_id, pos, symbol, weight): for each run the `top_n` highest scores known the day before, equally weighed."""
    rank = Window.partitionBy("run_id", "pos").orderBy(F.desc("score"), "symbol")
    chosen = rule_scores(panel, rebalances, runs).join(runs.select("run_id", "top_n"), "run_id").withColumn("k", F.row_number().over(rank)).where("k <= top_n")
    names = chosen.withColumn("weight", F.lit(1 - cash) / F.count("*").over(Window.partitionBy("run_id", "pos"))).select("run_id", "pos", "symbol", "weight")
    rest = names.groupBy("run_id", "pos").agg((1 - F.sum("weight")).alias("weight")).select("run_id", "pos", F.lit("CASH").alias("symbol"), "weight")
    return names.unionByName(rest)


def backtests(targets: DataFrame, panel: DataFrame, rebalances: DataFrame, calendar: DataFrame, cost_bps: float) -> DataFrame:
    """Metrics of all runs of `targets` in one job."""
    targets = settled(targets)
    values = settled(equity.interval_values(targets, panel, rebalances))
    changed = settled(equity.changes(targets, equity.drifted_holdings(values), rebalances))
    costs = settled(equity.self_financing_cost(changed, cost_bps))
    curve = settled(equity.equity_curve(equity.interval_growth(values), costs, rebalances))
    return equity.performance_metrics(curve, equity.rebalance_log(targets, equity.turnover(changed), costs, curve), calendar)


def parameter_sweep(panel: DataFrame, rebalances: DataFrame, grid: dict[str, list], selection_end: int, test_start: int, cost_bps: float = 10.0, metric: str = "sharpe", rule: str = "momentum", fixed: dict | None = None) -> DataFrame:
    """One row for each run of the grid over the selection window, and one more for the best on the final test.

    Any setting of `rule` can be swept, `fixed` has the others. phase is "selection" or "test"; runs with settings that the
    rule can't use, whose windows are longer than what stands before the first decision, or that had no position, have an
    error. The test begins after the selection has ended and sees the one chosen run only.
    """
    if test_start <= selection_end:
        raise ValueError("the test must start after the selection has ended")
    names = list(grid)
    values = list(product(*grid.values()))
    if not names or not values:
        raise ValueError("a sweep needs a setting and candidate values for each")
    if len(values) > MAX_SWEEP:
        raise ValueError(f"a sweep has at most {MAX_SWEEP} runs, not {len(values)}")
    runs = settings_table(panel.sparkSession, [{"run_id": "-".join(map(str, v)), "rule": rule, **(fixed or {}), **dict(zip(names, v, strict=True))} for v in values])
    calendar = panel.select("pos", "date").distinct()
    first = settled(rebalances.where(F.col("next_pos") <= selection_end))
    begin, least = panel.agg(F.min("pos")).first()[0], first.agg(F.min("pos")).first()[0]
    runs = settled(runs.withColumn("error", F.coalesce("error", F.when(warmup() >= F.lit((least or 0) - (begin or 0)), "not enough history"))))
    found = runs.join(backtests(rule_runs(panel, first, runs), panel, first, calendar, cost_bps), "run_id", "left")
    selection = settled(found.withColumn("phase", F.lit("selection")).withColumn("error", F.coalesce("error", F.when(F.col("final_equity").isNull(), "no position in the selection window"))))
    champion = selection.where(F.col("error").isNull() & F.col(metric).isNotNull()).orderBy(F.desc(metric), "run_id").limit(1).select(*runs.columns)
    last = settled(rebalances.where(F.col("pos") >= test_start))
    test = champion.join(backtests(rule_runs(panel, last, champion), panel, last, calendar, cost_bps), "run_id", "left")
    unused = [c.split()[0] for c in SETTINGS.split(", ") if c.split()[0] not in (*RULES[rule], "top_n")]
    return selection.unionByName(test.withColumn("phase", F.lit("test"))).drop(*unused)


def common_period(curves: DataFrame) -> DataFrame:
    """`curves` (run_id, pos, equity, ...) of runs with calendars of their own, on the positions that all of them have, each begun anew at 1.

    What is common is an intersection: positions are counted over the runs, so no run is compared with another.
    """
    runs = curves.agg(F.countDistinct("run_id").alias("runs"))
    days = curves.groupBy("day_pos").agg(F.countDistinct("run_id").alias("n")).join(F.broadcast(runs), F.col("n") == F.col("runs"), "left_semi").select("day_pos")
    line = Window.partitionBy("run_id").orderBy("day_pos")
    rows = curves.join(days, "day_pos").select("run_id", "day_pos", "equity", "gross_equity")
    first = lambda c: F.first(c).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", first("equity")).withColumn("gross_first", first("gross_equity")).withColumn("return", F.col("equity") / F.lag("equity").over(line) - 1)
    return rows.select("run_id", "day_pos", (F.col("equity") / F.col("first")).alias("equity"), (F.col("gross_equity") / F.col("gross_first")).alias("gross_equity"), "return")


def strategy_comparison(targets: DataFrame, panel: DataFrame, rebalances: DataFrame, calendar: DataFrame, cost_bps: float) -> DataFrame:
    """Metrics of all runs of `targets` on the period that they have in common, dearest Sharpe ratio first, with its first and last position."""
    targets = settled(targets)
    values = settled(equity.interval_values(targets, panel, rebalances))
    changed = settled(equity.changes(targets, equity.drifted_holdings(values), rebalances))
    costs = settled(equity.self_financing_cost(changed, cost_bps))
    whole = settled(equity.equity_curve(equity.interval_growth(values), costs, rebalances))
    shared = settled(common_period(whole))
    ends = shared.agg(F.min("day_pos").alias("first_pos"), F.max("day_pos").alias("last_pos"))
    log = equity.rebalance_log(targets, equity.turnover(changed), costs, whole)
    inside = log.join(F.broadcast(ends), (F.col("pos") >= F.col("first_pos")) & (F.col("pos") < F.col("last_pos")), "left_semi")
    # costs in units of what each run had when the common period began
    base = whole.join(ends, F.col("day_pos") == F.col("first_pos"), "left_semi").select("run_id", F.col("equity").alias("base"))
    inside = inside.join(base, "run_id").withColumn("cost_value", F.col("cost_value") / F.col("base"))
    return equity.performance_metrics(shared, inside, calendar).join(F.broadcast(ends)).orderBy(F.desc_nulls_last("sharpe"), "run_id")


def placebo_curves(panel: DataFrame, rebalances: DataFrame, drawn: DataFrame, calendar: DataFrame, cost_bps: float, cash: float = 0.1) -> DataFrame:
    """Metrics of each trial of `random_placebo`, over the same costs as any other run; run_id is the trial."""
    names = drawn.select(F.col("trial").cast("string").alias("run_id"), "pos", "symbol", (F.lit(1 - cash) / F.count("*").over(Window.partitionBy("trial", "pos"))).alias("weight"))
    rest = names.groupBy("run_id", "pos").agg((1 - F.sum("weight")).alias("weight")).select("run_id", "pos", F.lit("CASH").alias("symbol"), "weight")
    return backtests(names.unionByName(rest), panel, rebalances, calendar, cost_bps)


def subperiods(start: int, end: int, n: int) -> list[tuple[int, int]]:
    """n equal stretches of positions."""
    edges = [start + int((end - start) * i / n) for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def subperiod_metrics(targets: DataFrame, panel: DataFrame, rebalances: DataFrame, calendar: DataFrame, cost_bps: float, n: int = 4, least: int = 63) -> DataFrame:
    """(run_id, period, start, end, error, metrics): each run of `targets` over n equal stretches, all in one job.

    Rebalances belong to the stretch that they begin in and end with it at the latest; a stretch of fewer than `least`
    positions is an error row.
    """
    if n < 2:
        raise ValueError("at least two periods")
    start, end = (v or 0 for v in rebalances.agg(F.min("pos"), F.max("next_pos")).first())
    spans = panel.sparkSession.createDataFrame([(i + 1, a, b, None if b - a >= least else "too short after splitting") for i, (a, b) in enumerate(subperiods(start, end, n))], "period int, start int, end int, error string")
    own = rebalances.join(F.broadcast(spans.where("error is null")), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).withColumn("next_pos", F.least("next_pos", "end")).where("pos < next_pos")
    parts = targets.join(own.select("pos", "period"), "pos").withColumn("run_id", F.concat_ws("@", "run_id", F.col("period").cast("string"))).drop("period")
    found = backtests(parts, panel, settled(own.select(*rebalances.columns)), calendar, cost_bps).withColumn("period", F.element_at(F.split("run_id", "@"), -1).cast("int")).withColumn("run_id", F.regexp_replace("run_id", "@[0-9]+$", ""))
    every = targets.select("run_id").distinct().join(F.broadcast(spans))
    return every.join(found, ["run_id", "period"], "left").withColumn("error", F.coalesce("error", F.when(F.col("final_equity").isNull(), "no position in the period")))


def perturb(settings: dict[str, float], share: float = 0.2) -> list[dict[str, float]]:
    """Each numeric setting moved down and up; windows are whole and at least 2, a threshold stays within 1 to 99."""
    out = []
    for name, value in settings.items():
        for way in (1 - share, 1 + share):
            moved = min(99.0, max(1.0, value * way)) if name == "threshold" else max(2, round(value * way))
            if moved != value:
                out.append({**settings, name: moved})
    return out


def perturbed_settings(spark: SparkSession, rule: str, settings: dict[str, float], top_n: int, share: float = 0.2) -> DataFrame:
    """The settings of a rule and those around them as runs of one job: `baseline`, and field and direction of what was moved."""
    rows = [{"run_id": "baseline", "rule": rule, "top_n": top_n, **settings}]
    for moved in perturb({k: settings[k] for k in RULES[rule] if k in settings}, share):
        field = next(k for k in moved if moved[k] != settings[k])
        rows.append({**settings, **moved, "run_id": f"{field}{'-' if moved[field] < settings[field] else '+'}", "rule": rule, "top_n": top_n})
    return settings_table(spark, rows)


def random_placebo(eligible: DataFrame, names: int, trials: int = 20, seed: int = 7) -> DataFrame:
    """(trial, pos, symbol): names drawn alike for every eligible symbol by a hash, for each trial and rebalance."""
    drawn = eligible.crossJoin(F.broadcast(eligible.sparkSession.range(trials).withColumnRenamed("id", "trial"))).withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.col("pos").cast("string"), "symbol").cast("binary")))
    pick = Window.partitionBy("trial", "pos").orderBy("h", "symbol")
    return drawn.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= names).select("trial", "pos", "symbol")


def block_bootstrap_sharpe(returns: DataFrame, trials: int = 500, block: int = 21, seed: int = 7) -> DataFrame:
    """Quantiles of the Sharpe ratio over moving-block resamples of (run_id, i, r), i from 0."""
    sizes = returns.groupBy("run_id").agg(F.count("*").alias("n")).where("n >= 30").withColumn("b", F.least(F.lit(block), F.floor(F.col("n") / 2)))
    blocks = sizes.select("run_id", "n", "b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("b")) - 1)).alias("k"), ).crossJoin(F.broadcast(returns.sparkSession.range(trials).withColumnRenamed("id", "trial")))
    start = F.pmod(F.xxhash64(F.lit(seed), "run_id", "trial", "k"), F.col("n") - F.col("b") + 1)
    rows = blocks.withColumn("start", start).select("run_id", "n", "b", "k", "trial", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("o")).where("k * b + o < n")
    drawn = rows.select("run_id", "trial", (F.col("start") + F.col("o")).alias("i")).join(returns.select("run_id", F.col("i").cast("long").alias("i"), "r"), ["run_id", "i"])
    sharpe = drawn.groupBy("run_id", "trial").agg((F.avg("r") * F.sqrt(F.lit(252.0)) / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("s"))
    return sharpe.groupBy("run_id").agg(F.percentile("s", F.lit(0.05)).alias("low"), F.percentile("s", F.lit(0.95)).alias("high"), F.avg("s").alias("mean"), F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("positive"))


def run_evidence(targets: DataFrame, panel: DataFrame, rebalances: DataFrame, calendar: DataFrame, cost_bps: float, names: int, periods: int = 4, least: int = 63, trials: int = 20, seed: int = 7) -> DataFrame:
    """(run_id, baseline, at_max_cost, subperiods_positive, placebo_percentile, ci_low) of each run of `targets`, which `verdict` weighs.

    baseline is the Sharpe ratio at `cost_bps`, at_max_cost that at three times the costs, subperiods_positive the share of
    the usable stretches with a positive one, placebo_percentile the share of random draws of `names` symbols of the panel
    that the run is not below, ci_low the lower end of the block bootstrap. What can't be computed is null.
    """
    targets, rebalances = settled(targets), settled(rebalances)
    values = settled(equity.interval_values(targets, panel, rebalances))
    growth = settled(equity.interval_growth(values))
    changed = settled(equity.changes(targets, equity.drifted_holdings(values), rebalances))
    turned = equity.turnover(changed)

    def measured(bps: float) -> tuple[DataFrame, DataFrame]:
        costs = settled(equity.self_financing_cost(changed, bps))
        curve = settled(equity.equity_curve(growth, costs, rebalances))
        return curve, equity.performance_metrics(curve, equity.rebalance_log(targets, turned, costs, curve), calendar)

    curve, once = measured(cost_bps)
    _, thrice = measured(3 * cost_bps)
    parts = subperiod_metrics(targets, panel, rebalances, calendar, cost_bps, periods, least).where("sharpe is not null")
    share = parts.groupBy("run_id").agg(F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)).alias("subperiods_positive"))
    drawn = random_placebo(panel.join(rebalances.select("pos"), "pos").select("pos", "symbol"), names, trials, seed)
    random = placebo_curves(panel, rebalances, drawn, calendar, cost_bps).where("sharpe is not null").select(F.col("sharpe").alias("random"))
    base = settled(once.select("run_id", F.col("sharpe").alias("baseline")))
    # as many rows as there are trials
    beaten = base.join(F.broadcast(random)).groupBy("run_id").agg(F.avg(F.when(F.col("random") <= F.col("baseline"), 1.0).otherwise(0.0)).alias("placebo_percentile"))
    line = Window.partitionBy("run_id").orderBy("day_pos")
    returns = curve.where("return is not null").select("run_id", (F.row_number().over(line) - 1).alias("i"), F.col("return").alias("r"))
    low = block_bootstrap_sharpe(returns, seed=seed).select("run_id", F.col("low").alias("ci_low"))
    found = base.join(thrice.select("run_id", F.col("sharpe").alias("at_max_cost")), "run_id", "left")
    return found.join(share, "run_id", "left").join(beaten, "run_id", "left").join(low, "run_id", "left")


def verdict(evidence: DataFrame) -> DataFrame:
    """supported, inconclusive or falsified from (run_id, baseline, at_max_cost, subperiods_positive, placebo_percentile, ci_low)."""
    checks = [F.col("baseline") > 0, F.col("at_max_cost") > 0, F.col("subperiods_positive") > 0.5, F.col("placebo_percentile") >= 0.9, F.col("ci_low") > 0]
    passed = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0))
    word = F.when(~F.coalesce(checks[0], F.lit(False)) | (passed <= 1), "falsified").when(passed >= 4, "supported").otherwise("inconclusive")
    return evidence.select("run_id", passed.alias("passed"), word.alias("verdict"))


def registry_counts(manifests: DataFrame) -> DataFrame:
    """Counts by status and by kind, in one pass."""
    return manifests.groupingSets([["status"], ["kind"]], "status", "kind").agg(F.count("*").alias("n"))
