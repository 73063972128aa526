"""Data-quality checks. Each gives findings (dataset, symbol, check, severity, detail, value) for all symbols in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finding(rows: DataFrame, dataset: str, check: str, severity: str | Column, detail: Column | str, value: Column | str | None = None) -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    level = F.lit(severity) if isinstance(severity, str) else severity
    number = F.lit(None).cast("double") if value is None else (F.col(value) if isinstance(value, str) else value).cast("double")
    return rows.select(F.lit(dataset).alias("dataset"), "symbol", F.lit(check).alias("check"), level.alias("severity"), text.alias("detail"), number.alias("value"))


def check_coverage(universe: DataFrame, datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """datasets: name -> (rows with symbol, severity of a symbol that has none)."""
    out = [_finding(universe.select("symbol").join(rows.select("symbol").distinct(), "symbol", "left_anti"), name, "coverage", severity, "no rows") for name, (rows, severity) in datasets.items()]
    return reduce(DataFrame.unionByName, out)


def check_prices(bars: DataFrame) -> DataFrame:
    """Non-positive prices, bars that contradict themselves, repeated timestamps."""
    tol = F.abs("close") * 1e-6 + 1e-6
    bad = (F.col("high") < F.col("low") - tol) | (F.col("high") < F.greatest("open", "close") - tol) | (F.col("low") > F.least("open", "close") + tol)
    g = bars.groupBy("symbol").agg(F.count_if(F.least("open", "high", "low", "close") <= 0).alias("nonpositive"), F.count_if(bad).alias("odd"), (F.count("*") - F.countDistinct("ts")).alias("repeats"))
    return (_finding(g.where("nonpositive > 0"), "bars", "nonpositive_price", "ERROR", "prices at or below 0", "nonpositive")
            .unionByName(_finding(g.where("odd > 0"), "bars", "inconsistent_ohlc", "ERROR", "high or low contradicts open or close", "odd"))
            .unionByName(_finding(g.where("repeats > 0"), "bars", "duplicate_timestamps", "ERROR", "rows beyond the first of a timestamp", "repeats")))


def check_jumps(panel: DataFrame, actions: DataFrame, limit: float = 0.5, days: int = 3) -> DataFrame:
    """Moves above the limit with no corporate action within some days; the first three dates are named."""
    moves = panel.where("close is not null").withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("date")) - 1).where(F.abs("r") > limit)
    known = actions.select(F.col("symbol").alias("of"), "ex_date")
    alone = moves.join(known, (F.col("symbol") == F.col("of")) & (F.abs(F.date_diff("date", "ex_date")) <= days), "left_anti")
    g = alone.groupBy("symbol").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.col("date").cast("string"))), 1, 3).alias("dates"))
    return _finding(g, "prices", "unexplained_jump", "WARN", F.array_join("dates", ","), "n")


def check_history(panel: DataFrame, today: str, since: str = "2015-01-01", gap_days: int = 10, flat: int = 15) -> DataFrame:
    """Gaps, runs of one close, stale and short histories."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = panel.where("close is not null").withColumn("gap", F.date_diff("date", F.lag("date").over(w))).withColumn("new", F.when(F.col("close") == F.lag("close").over(w), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("symbol", "run").agg((F.count("*") - 1).alias("repeats")).groupBy("symbol").agg(F.max("repeats").alias("repeats"))
    g = rows.groupBy("symbol").agg(F.count_if(F.col("gap") > gap_days).alias("gaps"), F.max("date").alias("last"), F.min("date").alias("first")).join(runs, "symbol")
    g = g.withColumn("age", F.date_diff(F.to_date(F.lit(today)), "last"))
    return (_finding(g.where("gaps > 1"), "prices", "history_gap", "WARN", "gaps in the dates", "gaps")
            .unionByName(_finding(g.where(F.col("repeats") >= flat), "prices", "flatline", "WARN", "one close repeated", "repeats"))
            .unionByName(_finding(g.where(F.col("age") > gap_days), "prices", "stale", "WARN", F.col("last").cast("string"), "age"))
            .unionByName(_finding(g.where(F.col("first") > F.to_date(F.lit(since))), "prices", "short_history", "INFO", F.col("first").cast("string"))))


#: Names of each concept, best first.
CONCEPTS = {"revenue": ("Total Revenue", "Operating Revenue", "Sales"), "net_income": ("Net Income", "Net Income Common Stockholders", "Net Profit"), "cfo": ("Operating Cash Flow", "Cash from Operating Activity")}


def concept_series(statements: DataFrame, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """(symbol, concept, fiscal_year, value): the best named line of each concept, its last value in a fiscal year."""
    ranked = None
    for concept, names in concepts.items():
        rank = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(names))):
            rank = F.when(F.lower("line_item") == name.lower(), i).when(rank.isNull() & F.contains(F.lower("line_item"), F.lit(name.lower())), 100 + i).otherwise(rank)
        rows = statements.where("value is not null").withColumn("rank", rank).where("rank is not null").withColumn("concept", F.lit(concept))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.withColumn("best", F.min("rank").over(Window.partitionBy("symbol", "concept"))).where("rank = best")
    year = F.when(F.month("period_end") >= 4, F.year("period_end")).otherwise(F.year("period_end") - 1)
    return best.groupBy("symbol", "concept", year.alias("fiscal_year")).agg(F.max_by("value", "period_end").alias("value"))


def check_cashflow(statements: DataFrame, parts: tuple[str, str, str], total: str) -> DataFrame:
    """Periods in which the three cash flows don't add up to the net change."""
    names = [*parts, total]
    wide = statements.groupBy("symbol", "period_end").agg(*[F.max(F.when(F.col("line_item") == n, F.col("value"))).alias(f"c{i}") for i, n in enumerate(names)]).dropna()
    gap = F.abs(F.col("c0") + F.col("c1") + F.col("c2") - F.col("c3"))
    g = wide.where(gap > 0.02 * F.greatest(F.abs("c3"), F.lit(1.0)) + 1).groupBy("symbol").agg(F.count("*").alias("n"))
    return _finding(g, "statements", "cashflow_recon", "WARN", "cash flows don't add up", "n")


def check_statements(universe: DataFrame, statements: DataFrame, series: DataFrame, today: str) -> DataFrame:
    annual = statements.where("freq = 'annual'").groupBy("symbol").agg(F.max("period_end").alias("last"))
    age = F.date_diff(F.to_date(F.lit(today)), "last") / 30.4
    none = universe.select("symbol").join(annual, "symbol", "left_anti")
    low = series.where("concept = 'revenue' and value <= 0").groupBy("symbol").agg(F.count("*").alias("n"))
    return (_finding(low, "statements", "nonpositive_revenue", "WARN", "revenue at or below 0", "n").unionByName(_finding(none, "statements", "no_annual", "WARN", "no annual rows"))
            .unionByName(_finding(annual.withColumn("age", age).where("age > 18"), "statements", "statement_stale", "WARN", F.col("last").cast("string"), F.round("age", 4))))


def check_currency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbols whose two sources differ by a steady factor of 55 to 100."""
    ratio = a.select("symbol", "concept", "fiscal_year", F.col("value").alias("x")).join(b.select("symbol", "concept", "fiscal_year", F.col("value").alias("y")), ["symbol", "concept", "fiscal_year"]).where("concept = 'revenue' and x <> 0")
    g = ratio.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile(F.col("y") / F.col("x"), F.lit(0.5)).alias("m"), F.stddev_pop(F.col("y") / F.col("x")).alias("sd"))
    return _finding(g.where("n >= 2 and m between 55 and 100 and sd / m < 0.15"), "statements", "currency_mismatch", "ERROR", "sources differ by a steady factor", F.round("m", 6))


def check_fundamentals(a: DataFrame, b: DataFrame, financial: DataFrame, skip: DataFrame) -> DataFrame:
    """The worst difference of two sources for each concept; financial symbols are checked on net income only."""
    pairs = a.select("symbol", "concept", "fiscal_year", F.col("value").alias("x")).join(b.select("symbol", "concept", "fiscal_year", F.col("value").alias("y")), ["symbol", "concept", "fiscal_year"])
    pairs = pairs.join(skip.select("symbol"), "symbol", "left_anti").join(financial.select("symbol", F.lit(True).alias("fin")), "symbol", "left").where("fin is null or concept = 'net_income'")
    diff = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.abs("y"), F.lit(1.0))
    g = pairs.withColumn("d", diff).groupBy("symbol", "concept").agg(F.max("d").alias("d"), F.max_by("fiscal_year", F.struct("d", -F.col("fiscal_year"))).alias("fy")).where("d > 0.10")
    return _finding(g, "statements", "fundamental_mismatch", F.when(F.col("d") > 0.30, "ERROR").otherwise("WARN"), F.concat_ws(" ", "concept", F.col("fy").cast("string")), F.round("d", 6))


def check_price_basis(filing: DataFrame, panel: DataFrame, days: int = 6) -> DataFrame:
    """Month-end prices of filings against the trading day nearest to them, the one after first."""
    rows = filing.select("symbol", F.col("date").alias("month_end"), F.col("price").alias("filed")).join(panel.where("close is not null").select(F.col("symbol").alias("of"), "date", "close"), (F.col("symbol") == F.col("of")) & F.date_diff("date", "month_end").between(-days, days))
    ahead = F.date_diff("date", "month_end")
    pick = Window.partitionBy("symbol", "month_end").orderBy(F.when(ahead >= 0, ahead).otherwise(100 - ahead))
    near = rows.withColumn("n", F.row_number().over(pick)).where("n = 1")
    g = near.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile(F.abs(F.col("close") - F.col("filed")) / F.col("filed"), F.lit(0.5)).alias("m")).where("n >= 5 and m > 0.05")
    return _finding(g, "prices", "price_basis_mismatch", F.when(F.col("m") > 0.25, "ERROR").otherwise("WARN"), "filed and traded prices differ", F.round("m", 6))


def check_actions(existing: DataFrame, derived: DataFrame, days: int = 400) -> DataFrame:
    """Symbols with derived splits or bonuses that no known action is near to, with their years."""
    known = existing.where(F.col("action_type").isin("split", "bonus")).select(F.col("symbol").alias("of"), F.col("ex_date").alias("known"))
    left = derived.join(known, (F.col("symbol") == F.col("of")) & (F.abs(F.date_diff("ex_date", "known")) <= days), "left_anti")
    g = left.groupBy("symbol").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.year("ex_date").cast("string"))), ",").alias("years"))
    return _finding(g, "actions", "action_coverage", "WARN", F.col("years"), "n")


def findings_report(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return findings.orderBy(rank, "dataset", "symbol", "check", "detail")


def findings_by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "dataset", "check").agg(F.count("*").alias("n"))
