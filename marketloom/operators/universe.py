"""Universe, funds, corporate actions and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_universe(sources: list[DataFrame], instruments: DataFrame) -> DataFrame:
    """The first source that has rows; symbols trimmed and upper, without repeats or DUMMY rows; instruments joined by isin."""
    ranked = None
    for i, s in enumerate(sources):
        rows = s.select(F.lit(i).alias("source_no"), F.upper(F.trim("symbol")).alias("symbol"), F.upper(F.trim("isin")).alias("isin"), "industry")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    chosen = ranked.join(ranked.agg(F.min("source_no").alias("source_no")), "source_no")
    one = Window.partitionBy("symbol").orderBy("isin", "industry")
    rows = chosen.where(~F.col("symbol").startswith("DUMMY")).withColumn("n", F.row_number().over(one)).where("n = 1")
    return rows.join(instruments.select("isin", "instrument_key"), "isin", "left").select("symbol", "isin", "industry", "instrument_key", F.concat("symbol", F.lit(".NS")).alias("yf_ticker"))


def equity_instruments(raw: DataFrame) -> DataFrame:
    isin = F.element_at(F.split("instrument_key", r"\|"), -1)
    return raw.where("instrument_type = 'EQUITY'").withColumn("isin", isin).where(F.col("isin").startswith("INE")).select("isin", "instrument_key")


def unmatched_universe(universe: DataFrame) -> DataFrame:
    return universe.where("instrument_key is null").select("symbol", "isin")


def priceable(universe: DataFrame) -> DataFrame:
    return universe.where("instrument_key is not null").orderBy("symbol")


def asof_return(nav: DataFrame, years: int) -> DataFrame:
    """(scheme_code, return): latest value over the last one on or before the day that many years earlier."""
    last = nav.groupBy("scheme_code").agg(F.max("date").alias("latest"), F.max_by("nav", "date").alias("now"), F.min("date").alias("first"))
    target = F.date_sub("latest", int(years * 365.25))
    base = nav.join(F.broadcast(last.select("scheme_code", "latest")), "scheme_code").where(F.col("date") <= target).groupBy("scheme_code").agg(F.max_by("nav", "date").alias("base"))
    return last.join(base, "scheme_code", "left").select("scheme_code", F.when((target >= F.col("first")) & (F.col("base") > 0), F.col("now") / F.col("base") - 1).alias("return"))


def fund_catalog(nav: DataFrame, schemes: DataFrame) -> DataFrame:
    """Latest value, span, one-year return and three-year growth rate of each named scheme."""
    g = nav.groupBy("scheme_code").agg(F.max("date").alias("latest_date"), F.max_by("nav", "date").alias("latest_nav"), F.min("date").alias("first_date"), F.count("*").alias("n"))
    one, three = asof_return(nav, 1).withColumnRenamed("return", "return_1y"), asof_return(nav, 3).withColumnRenamed("return", "r3")
    rows = schemes.join(g, "scheme_code").join(one, "scheme_code").join(three, "scheme_code")
    return rows.select("scheme_code", "name", "house", "latest_date", "latest_nav", "first_date", "n", "return_1y", (F.pow(1 + F.col("r3"), F.lit(1 / 3)) - 1).alias("cagr_3y"))


def curated_funds(catalog: DataFrame, words: tuple[str, ...] = ("direct", "growth"), days: int = 45) -> DataFrame:
    newest = catalog.agg(F.max("latest_date").alias("newest"))
    named = catalog.crossJoin(F.broadcast(newest)).where(F.date_diff("newest", "latest_date") <= days).drop("newest")
    for w in words:
        named = named.where(F.contains(F.lower("name"), F.lit(w)))
    return named.withColumn("return_1y", F.when(F.col("return_1y").between(-0.75, 3.0), F.col("return_1y")))


def search_catalog(df: DataFrame, query: str, columns: list[str], order_by: str, page: int = 0, size: int = 100) -> DataFrame:
    """Rows that hold `query` in any of the columns, whatever the case; largest first, one page of them."""
    found = None
    for c in columns:
        hit = F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
        found = hit if found is None else found | hit
    return df.where(found).orderBy(F.desc_nulls_last(order_by), columns[0]).offset(page * size).limit(size)


def rank_funds(catalog: DataFrame, query: str = "", page: int = 0, size: int = 20, days: int = 45) -> DataFrame:
    """One page of the curated funds by one-year return, dearest first and unknown last, with their place and how many there are.

    `query` narrows them to names, houses or categories that hold it; without a query all curated funds are ranked.
    """
    columns = [c for c in ("name", "house", "category") if c in catalog.columns]
    rows = curated_funds(catalog, days=days)
    if query.strip():
        hit = reduce(lambda a, b: a | b, [F.contains(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(query.strip().upper())) for c in columns])
        rows = rows.where(hit)
    order = [F.desc_nulls_last("return_1y"), F.col("scheme_code")]
    # only the rows up to the page's end are numbered
    last = (page + 1) * size
    top = rows.orderBy(*order).limit(last).withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > page * size)
    return top.join(F.broadcast(rows.agg(F.count("*").alias("funds"))))


def stock_catalog(panel: DataFrame, universe: DataFrame) -> DataFrame:
    g = panel.where("close is not null").groupBy("symbol").agg(F.max_by("close", "date").alias("last"), F.min_by("close", "date").alias("first"))
    rows = g.join(universe, "symbol", "left")
    return rows.select("symbol", F.coalesce("isin", F.lit("")).alias("isin"), F.coalesce("industry", F.lit("")).alias("industry"), "last", (F.col("last") / F.col("first") - 1).alias("window_return"))


def latest_and_previous(panel: DataFrame) -> DataFrame:
    by = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = panel.where("close is not null").select("symbol", "date", "close", F.row_number().over(by).alias("n")).where("n <= 2")
    g = rows.groupBy("symbol").agg(F.max(F.when(F.col("n") == 1, F.col("close"))).alias("latest"), F.max(F.when(F.col("n") == 2, F.col("close"))).alias("back"), F.max("date").alias("date"))
    previous = F.coalesce("back", "latest")
    return g.select("symbol", "date", "latest", previous.alias("previous"), (F.col("latest") / previous - 1).alias("day_change"))


def split_factor(actions: DataFrame) -> DataFrame:
    """split_adj_factor: product of the ratios of splits with a strictly later ex-date."""
    day = F.date_diff("ex_date", F.lit("1970-01-01").cast("date"))
    later = Window.partitionBy("symbol").orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    ratio = F.when(F.col("action_type").isin("split", "bonus") & (F.col("ratio") > 0), F.log("ratio")).otherwise(0.0)
    return actions.withColumn("day", day).withColumn("split_adj_factor", F.exp(F.coalesce(F.sum(ratio).over(later), F.lit(0.0)))).drop("day")


def merge_actions(existing: DataFrame, derived: DataFrame, tolerance_days: int = 400) -> DataFrame:
    """Existing actions and those derived ones that no known split or bonus is near to; factors anew."""
    known = existing.where(F.col("action_type").isin("split", "bonus")).select("symbol", F.col("ex_date").alias("known"))
    fresh = derived.join(known, (derived.symbol == known.symbol) & (F.abs(F.date_diff("ex_date", "known")) <= tolerance_days), "left_anti")
    columns = ["symbol", "ex_date", "action_type", "ratio"]
    return split_factor(existing.select(*columns, F.lit("listed").alias("source")).unionByName(fresh.select(*columns, F.lit("derived").alias("source"))))


def derive_actions(balance: DataFrame) -> DataFrame:
    """Splits from falls of the face value, bonuses from rises of the share count, out of (symbol, period_end, line_item, value)."""
    def item(name: str) -> Column:
        return F.max(F.when(F.col("line_item") == name, F.col("value")))

    wide = balance.groupBy("symbol", "period_end").agg(item("Face Value").alias("face"), item("Share Issued").alias("shares"), item("New Bonus Shares").alias("bonus"))
    by = Window.partitionBy("symbol").orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = wide.select("*", F.last("face", ignorenulls=True).over(by).alias("face0"), F.last("shares", ignorenulls=True).over(by).alias("shares0"))
    split = F.when(F.col("face0") - F.col("face") > 0.01, F.col("face0") / F.col("face"))
    grown = F.col("shares") / F.col("shares0")
    bonus = F.when((grown >= 1.15) & (F.col("bonus") > 0) & ~F.coalesce(F.abs(grown / split - 1) <= 0.05, F.lit(False)), grown)
    pairs = F.array(F.struct(F.lit("split").alias("action_type"), split.alias("ratio")), F.struct(F.lit("bonus").alias("action_type"), bonus.alias("ratio")))
    return rows.select("symbol", F.col("period_end").alias("ex_date"), F.explode(pairs).alias("a")).select("symbol", "ex_date", "a.action_type", "a.ratio").where("ratio is not null")
