"""Price panels: one row per (symbol, date) with `pos`, the place of the date in the trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    """Rows of a symbol in calendar order."""
    return Window.partitionBy("symbol").orderBy("pos")


def calendar(prices: DataFrame) -> DataFrame:
    """(date, pos) of all dates on which any symbol has a row."""
    return prices.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def align_calendar(prices: DataFrame) -> DataFrame:
    """All symbols by all dates; close is null where a symbol has no row."""
    grid = calendar(prices).crossJoin(prices.select("symbol").distinct())
    return grid.join(prices.select("symbol", "date", "close"), ["symbol", "date"], "left").select("symbol", "date", "pos", "close")


def dense(prices: DataFrame) -> DataFrame:
    """Rows as they are, with pos."""
    return prices.select("symbol", "date", "close").join(F.broadcast(calendar(prices)), "date").select("symbol", "date", "pos", "close")


def ffill_limited(panel: DataFrame, limit: int = 5) -> DataFrame:
    """close carried forward over at most `limit` calendar rows; `filled` marks carried cells."""
    carried = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(-limit, 0))
    return panel.select("symbol", "date", "pos", carried.alias("close"), (F.col("close").isNull() & carried.isNotNull()).alias("filled"))


def classify_gaps(panel: DataFrame) -> DataFrame:
    """(symbol, status, reason): excluded when there is no data, or a hole between the first and the last value."""
    has = F.when(F.col("close").isNotNull(), F.col("pos"))
    spans = panel.groupBy("symbol").agg(F.min(has).alias("first_pos"), F.max(has).alias("last_pos"), F.count("close").alias("n"))
    hole = F.col("last_pos") - F.col("first_pos") + 1 > F.col("n")
    reason = F.when(F.col("n") == 0, "no data in range").when(hole, "interior gap longer than the fill limit")
    return spans.select("symbol", F.when(reason.isNull(), "kept").otherwise("excluded").alias("status"), reason.alias("reason"), "first_pos", "last_pos", "n")


def eligibility(panel: DataFrame) -> DataFrame:
    """(symbol, eligible_from, eligible_through): set only where data begin late or end early."""
    has = F.col("close").isNotNull()
    spans = panel.groupBy("symbol").agg(F.min(F.when(has, F.struct("pos", "date"))).alias("first"), F.max(F.when(has, F.struct("pos", "date"))).alias("last"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    return spans.where("first is not null").select(
        "symbol", F.when(F.col("first.pos") > F.col("p0"), F.col("first.date")).alias("eligible_from"), F.when(F.col("last.pos") < F.col("p1"), F.col("last.date")).alias("eligible_through"))


def fill_edges(panel: DataFrame) -> DataFrame:
    """Flat values before a symbol's first and after its last row; is_placeholder marks them."""
    whole = Window.partitionBy("symbol")
    has = F.col("close").isNotNull()
    first = F.min(F.when(has, F.struct("pos", "close"))).over(whole)
    last = F.max(F.when(has, F.struct("pos", "close"))).over(whole)
    edge = (F.col("pos") < first["pos"]) | (F.col("pos") > last["pos"])
    filled = F.when(F.col("pos") < first["pos"], first["close"]).when(F.col("pos") > last["pos"], last["close"]).otherwise(F.col("close"))
    return panel.select("symbol", "date", "pos", filled.alias("close"), F.coalesce(edge, F.lit(True)).alias("is_placeholder"))


def listed_only(panel: DataFrame) -> DataFrame:
    """The panel with placeholders emptied again."""
    return panel.withColumn("close", F.when(~F.col("is_placeholder"), F.col("close")))


def clean(prices: DataFrame, limit: int = 5) -> DataFrame:
    """Calendar, bounded fill, exclusion of symbols with holes, flat edges."""
    filled = ffill_limited(align_calendar(prices), limit)
    kept = classify_gaps(filled).where("status = 'kept'").select("symbol")
    return fill_edges(filled.join(kept, "symbol", "left_semi"))


def validate_prices(panel: DataFrame) -> DataFrame:
    """One row of counts: rows, symbols, span, missing cells, non-positive prices, large daily moves."""
    back = F.lag("close").over(by_symbol())
    moves = panel.withColumn("r", F.col("close") / back - 1)
    return moves.agg(
        F.countDistinct("date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(F.col("close").isNull()).alias("missing_cells"), F.count_if(F.col("close") <= 0).alias("nonpositive"), F.count_if(F.abs("r") > 0.25).alias("large_moves"))


def load_report(panel: DataFrame, requested: DataFrame, as_of: str) -> DataFrame:
    """Per requested symbol: status, coverage and age in days of its last value."""
    has = F.when(F.col("close").isNotNull(), F.col("date"))
    coverage = panel.groupBy("symbol").agg(F.min(has).alias("first_date"), F.max(has).alias("last_date"), F.count("close").alias("n"))
    found = requested.select("symbol").distinct().join(coverage, "symbol", "left")
    return found.select("symbol", F.when(F.coalesce("n", F.lit(0)) == 0, "missing").otherwise("loaded").alias("status"), "first_date", "last_date", F.coalesce("n", F.lit(0)).alias("n"),
                        F.date_diff(F.to_date(F.lit(as_of)), "last_date").alias("age_days"))


def fingerprint(panel: DataFrame) -> DataFrame:
    """Order-independent content hash of a panel, of closes to four digits.

    The cut between two digits stands off the middle, so that sums of one day's values in another order rarely fall on its
    other side.
    """
    cell = F.md5(F.concat_ws("|", "symbol", F.col("date").cast("string"), F.floor(F.col("close") * 10000 + 0.37).cast("string")).cast("binary"))
    return panel.agg(F.bit_xor(F.conv(F.substring(cell, 1, 15), 16, 10).cast("long")).alias("hash"), F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


def top_by_volatility(panel: DataFrame, n: int = 40, tail: int = 126) -> DataFrame:
    """The n symbols with the largest standard deviation of their last `tail` returns."""
    returns = panel.withColumn("r", F.col("close") / F.lag("close").over(by_symbol()) - 1).where("r is not null")
    recent = returns.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("pos")))).where(F.col("back") <= tail)
    spread = recent.groupBy("symbol").agg(F.stddev_samp("r").alias("volatility"))
    return spread.orderBy(F.desc_nulls_last("volatility"), "symbol").limit(n)
