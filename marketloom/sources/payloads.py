"""Readers of landed payloads: bars, fund values, macro series, filings, feeds, sitemaps, capture indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url

BAR_SCHEMA = "symbol string, ts_utc timestamp, open double, high double, low double, close double, volume long, open_interest long"


def read_daily_close(spark: SparkSession, root: str, start: str, end: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """(symbol, date, close) of a bar lake partitioned by symbol; the last bar of a local day counts."""
    bars = spark.read.parquet(root).select("symbol", "ts_utc", "close")
    day = bars.withColumn("date", F.to_date(F.from_utc_timestamp("ts_utc", zone))).where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return day.groupBy("symbol", "date").agg(F.max_by("close", "ts_utc").alias("close"))


def absent_symbols(requested: DataFrame, prices: DataFrame) -> DataFrame:
    """Requested symbols without any row."""
    return requested.select("symbol").distinct().join(prices.select("symbol").distinct(), "symbol", "left_anti")


def read_price_csv(spark: SparkSession, path: str, least_rows: int = 10) -> DataFrame:
    """(symbol, date, close) of a wide or long CSV; bad dates and symbols with few values go, the last value of a day counts."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns]).withColumn("_n", F.monotonically_increasing_id())
    names = {c.lower(): c for c in raw.columns}
    if "date" not in names:
        raise ValueError("a date column is needed")
    date = F.coalesce(*[F.try_to_timestamp(F.col(names["date"]), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "dd/MM/yyyy")]).cast("date").alias("date")
    if {"symbol", "close"} <= set(names):
        rows = raw.select(date, F.col(names["symbol"]).alias("symbol"), F.col(names["close"]).alias("value"), "_n")
    else:
        rows = raw.select(date, "_n", *[c for c in raw.columns if c not in (names["date"], "_n")]).unpivot(["date", "_n"], None, "symbol", "value")
    rows = rows.select(F.upper(F.trim("symbol")).alias("symbol"), "date", F.expr("try_cast(value as double)").alias("close"), "_n").where("date is not null and close is not null")
    last = rows.groupBy("symbol", "date").agg(F.max_by("close", "_n").alias("close"))
    return last.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("n") > least_rows).drop("n")


def price_csv_problems(prices: DataFrame) -> DataFrame:
    """Reasons for which a price table can't be used, as rows."""
    g = prices.agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("date").alias("dates"), F.count_if(F.col("close") <= 0).alias("low"), F.count_if(F.col("symbol") == "CASH").alias("cash"))
    checks = F.array(F.when(F.col("symbols") < 2, "fewer than 2 symbols"), F.when(F.col("dates") < 260, "fewer than 260 dates"), F.when(F.col("low") > 0, "a price is not positive"), F.when(F.col("cash") > 0, "CASH is not a symbol"))
    return g.select(F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem"))


def read_bars_json(spark: SparkSession, path: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """Candle payloads, one JSON document a file or line: {symbol, data: {candles: [[ts, o, h, l, c, volume, oi]]}}."""
    raw = spark.read.schema("symbol string, data struct<candles: array<array<string>>>").option("multiLine", True).json(path)
    c = raw.select("symbol", F.explode("data.candles").alias("c"))
    at = lambda i, kind: F.expr(f"try_cast(c[{i}] as {kind})")
    return c.select("symbol", F.try_to_timestamp(F.col("c")[0]).alias("ts_utc"), *[at(i, "double").alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)], at(5, "long").alias("volume"), at(6, "long").alias("open_interest")).withColumn("ts_local", F.from_utc_timestamp("ts_utc", zone))


def read_fund_nav_json(spark: SparkSession, path: str) -> DataFrame:
    """(scheme_code, house, type, category, name, date, nav) of fund value payloads; rows that don't parse go."""
    schema = "meta struct<scheme_code: string, fund_house: string, scheme_type: string, scheme_category: string, scheme_name: string>, data array<struct<date: string, nav: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("meta.*", F.explode("data").alias("d"))
    rows = rows.select(F.expr("try_cast(scheme_code as int)").alias("scheme_code"), F.col("fund_house").alias("house"), F.col("scheme_type").alias("type"), F.col("scheme_category").alias("category"), F.col("scheme_name").alias("name"),
                       F.try_to_timestamp(F.col("d.date"), F.lit("dd-MM-yyyy")).cast("date").alias("date"), F.expr("try_cast(d.nav as double)").alias("nav"))
    return rows.where("date is not null and nav is not null")


def read_scheme_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("schemeCode string, schemeName string").option("multiLine", True).json(path)
    return rows.select(F.expr("try_cast(schemeCode as int)").alias("scheme_code"), F.col("schemeName").alias("name")).where("scheme_code is not null").dropDuplicates(["scheme_code"])


def read_fred_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    rows = spark.read.schema("observations array<struct<date: string, value: string, realtime_start: string>>").option("multiLine", True).json(path).select(F.inline("observations"))
    return rows.select(F.lit(series).alias("series_id"), F.to_date("date").alias("date"), F.expr("try_cast(value as double)").alias("value"), F.to_date("realtime_start").alias("realtime_start")).where("value is not null")


def read_worldbank_json(spark: SparkSession, path: str) -> DataFrame:
    """[meta, rows] payloads; a year stands for its last day."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$[1]"), "array<struct<indicator: struct<id: string>, countryiso3code: string, date: string, value: double>>").alias("r"))
    return raw.select(F.inline("r")).where("value is not null").select(F.col("indicator.id").alias("series_id"), F.col("countryiso3code").alias("country"), F.make_date(F.expr("try_cast(date as int)"), F.lit(12), F.lit(31)).alias("date"), "value")


def read_shareholding_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("symbol string, date string, pr_and_prgrp string, public_val string, employeeTrusts string").option("multiLine", True).json(path)
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return rows.select("symbol", F.try_to_timestamp("date", F.lit("dd-MMM-yyyy")).cast("date").alias("date"), number("pr_and_prgrp").alias("promoters"), number("public_val").alias("public"), number("employeeTrusts").alias("employee_trusts")).where("date is not null")


def melt_statements(df: DataFrame, symbol: str, freq: str, statement: str) -> DataFrame:
    """Line items by period columns -> (symbol, period_end, freq, statement, line_item, value)."""
    periods = [c for c in df.columns if c != "line_item"]
    long = df.select("line_item", *[F.col(c).cast("double").alias(c) for c in periods]).unpivot(["line_item"], periods, "period", "value")
    return long.select(F.lit(symbol).alias("symbol"), F.to_date("period").alias("period_end"), F.lit(freq).alias("freq"), F.lit(statement).alias("statement"), "line_item", "value").where("value is not null and period_end is not null")


def key_stats_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """(symbol, info map) -> (symbol, key, value_str, value_num) for the named keys."""
    rows = df.select("symbol", F.explode("info").alias("key", "value_str")).where(F.col("key").isin(keys) & F.col("value_str").isNotNull())
    return rows.withColumn("value_num", F.expr("try_cast(value_str as double)"))


def grid_to_long(cells: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Spreadsheet cells (file, row, col, value) -> (file, section, line_item, period_end, value); `sections`: label -> section.

    A label in the first column that is a known name opens a section; a date row gives the periods of its columns.
    """
    label = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    names = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    rows = cells.where("col = 0").select("file", "row", F.trim("value").alias("line_item"), label.alias("label"))
    order = Window.partitionBy("file").orderBy("row")
    rows = rows.withColumn("opened", F.try_element_at(names, F.col("label"))).withColumn("dated", F.when(F.col("label").isin("report date", "date", "narration"), F.col("row")))
    rows = rows.select("file", "row", "line_item", "opened", "dated", F.last("opened", ignorenulls=True).over(order).alias("section"), F.last("dated", ignorenulls=True).over(order).alias("date_row"))
    values = cells.where("col > 0").select("file", "row", "col", "value")
    dates = values.select("file", F.col("row").alias("date_row"), "col", F.coalesce(F.try_to_timestamp("value"), F.try_to_timestamp("value", F.lit("MMM-yy"))).cast("date").alias("period_end"))
    named = rows.where("section is not null and date_row is not null and dated is null and line_item <> ''")
    found = named.join(values, ["file", "row"]).join(dates, ["file", "date_row", "col"])
    return found.select("file", "section", "line_item", "period_end", F.expr("try_cast(value as double)").alias("value")).where("value is not null and period_end is not null")


BOILERPLATE = ("economic times", "markets", "companies")


FEED_ITEM = "title string, description string, link string, pubDate string"


def feed_rows(items: DataFrame, feed: Column, seen: Column | None = None) -> DataFrame:
    """(feed, title, summary, url, published) of feed items as they are in the XML; `seen` dates those that state no time.

    Items without title or link and section names go.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.col(c), "<[^>]+>", " "), r"\s+", " "))
    published = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"), *([] if seen is None else [seen]))
    rows = items.select(feed.alias("feed"), clean("title").alias("title"), clean("description").alias("summary"), canonical_url(F.trim("link")).alias("url"), published.alias("published"))
    return rows.where((F.col("title") != "") & (F.col("url") != "") & ~F.lower("title").isin(*BOILERPLATE))


def read_rss_xml(spark: SparkSession, path: str, feed: str) -> DataFrame:
    return feed_rows(spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path), F.lit(feed))


def read_sitemap_xml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.select(F.trim("loc").alias("url"), F.try_to_timestamp("lastmod").alias("lastmod")).where("url <> ''")


def sitemap_parts(index: DataFrame, year: int, month: str) -> DataFrame:
    """Part files of a month, by part number."""
    number = F.regexp_extract("url", rf"/{year}-{month}-(\d+)\.xml$", 1)
    return index.where(number != "").select("url", number.cast("int").alias("part")).orderBy("part")


def read_capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Crawl index lines; bad lines, failed captures and other media go."""
    schema = "url string, timestamp string, status string, mime string, filename string, offset string, length string"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("j")).where("j is not null and j.url is not null").select("j.*")
    kept = rows.where("(status is null or status = '200') and (mime is null or mime = 'text/html')")
    return kept.select("url", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss")).alias("captured"), "filename", F.expr("try_cast(offset as long)").alias("offset"), F.expr("try_cast(length as long)").alias("length"))
