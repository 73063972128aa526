"""Market, fund, ledger and news tables derived from the given test tables, as DataFrames and as the same SQL.

Each function takes (spark, sf_dir). `SQL` holds a common table expression of the same name and columns for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prices(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    date = F.to_date(F.date_trunc(unit, "l_shipdate"))
    return joined.groupBy(F.col("p_brand").alias("symbol"), date.alias("date")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 9).alias("close"))


def prices_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, "month")


def prices_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, "week")


def prices_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, "day")


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts_utc")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of many accounts; the first event of an account and symbol opens a lot of 3."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.round("value", 6).alias("value"))
    e = e.withColumn("symbol", F.concat(F.lit("S"), F.col("event_id") % 3)).withColumn("date", F.to_date("ts"))
    first = F.row_number().over(Window.partitionBy("user_id", "symbol").orderBy("ts", "event_id")) == 1
    e = e.withColumn("opens", first)
    kind = F.when(F.col("opens") | (F.col("event_type") == "purchase"), "buy").when(F.col("event_type") == "click", "sell").when(F.col("event_type") == "signup", "deposit").when(F.col("event_type") == "view", "distribution").otherwise("fee")
    quantity = F.when(F.col("opens"), 3.0).when(F.col("event_type") == "purchase", (F.col("event_id") % 5 + 1).cast("double")).when(F.col("event_type") == "click", 1.0)
    e = e.withColumn("action", kind).withColumn("quantity", quantity)
    trade = F.col("action").isin("buy", "sell")
    return e.select(
        F.col("user_id").alias("account_id"), "event_id", "action", "symbol", F.lit("Stock").alias("instrument_type"), "date", F.when(trade, F.col("quantity")).alias("quantity"),
        F.when(trade, F.col("value")).alias("price"), F.when(F.col("action") == "deposit", F.col("value") * 100).when(~trade, F.col("value")).alias("amount"), F.lit(None).cast("string").alias("notes"))


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return o.groupBy((F.col("o_custkey") % 50).alias("scheme_code"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("nav"))


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.groupBy((F.col("c_custkey") % 50).alias("scheme_code")).agg(F.min_by("c_mktsegment", "c_custkey").alias("house"), F.min_by("c_name", "c_custkey").alias("name"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey")
    by = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return by.groupBy(F.col("p_brand").alias("symbol")).agg(F.min_by("p_type", F.struct(-F.col("n"), "p_type")).alias("industry")).select(
        "symbol", F.concat(F.lit("INE"), F.upper(F.regexp_replace("symbol", "[^A-Za-z0-9]", ""))).alias("isin"), "industry")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corporate action for each brand and year: the latest line with the largest discount."""
    lines = table(spark, sf_dir, "lineitem").where("round(l_discount, 2) = 0.10 and l_linenumber >= 2").select("l_partkey", "l_shipdate", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("ex_date"), F.col("l_linenumber").cast("double").alias("ratio"))
    return j.groupBy("symbol", F.year("ex_date").alias("y")).agg(F.max(F.struct("ex_date", "ratio")).alias("m")).select("symbol", F.col("m.ex_date").alias("ex_date"), F.lit("split").alias("action_type"), F.col("m.ratio").alias("ratio"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual line items of each brand, fiscal years ending in March."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    fy = F.when(F.month("l_shipdate") >= 4, F.year("l_shipdate") + 1).otherwise(F.year("l_shipdate"))
    wide = j.groupBy(F.col("p_brand").alias("symbol"), fy.alias("y")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("Total Revenue"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("Net Income"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("Operating Cash Flow"), F.round(F.sum("l_quantity"), 2).alias("Share Issued"))
    long = wide.unpivot(["symbol", "y"], ["Total Revenue", "Net Income", "Operating Cash Flow", "Share Issued"], "line_item", "value")
    return long.select("symbol", F.make_date("y", F.lit(3), F.lit(31)).alias("period_end"), F.lit("annual").alias("freq"), F.lit("income").alias("statement"), "line_item", "value")


def _prices_sql(name: str, unit: str) -> str:
    return f"""{name} as (select p_brand as symbol, date_trunc('{unit}', l_shipdate)::date as date, round(sum(l_extendedprice) / sum(l_quantity), 9) as close
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


SQL = {
    "prices_m": _prices_sql("prices_m", "month"),
    "prices_w": _prices_sql("prices_w", "week"),
    "prices_d": _prices_sql("prices_d", "day"),
    "bars_h": """bars_h as (select event_type as symbol, date_trunc('hour', ts) as ts_utc, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low,
  arg_max(value, row(ts, event_id)) as close, count(*) as volume from events group by 1, 2)""",
    "tx": """tx0 as (select *, 'S' || (event_id % 3) as symbol, ts::date as date, round(value, 6) as v,
  row_number() over (partition by user_id, 'S' || (event_id % 3) order by ts, event_id) = 1 as opens from events),
tx1 as (select *, case when opens or event_type = 'purchase' then 'buy' when event_type = 'click' then 'sell' when event_type = 'signup' then 'deposit' when event_type = 'view' then 'distribution' else 'fee' end as action,
  case when opens then 3.0 when event_type = 'purchase' then (event_id % 5 + 1)::double when event_type = 'click' then 1.0 end as q from tx0),
tx as (select user_id as account_id, event_id, action, symbol, 'Stock' as instrument_type, date, case when action in ('buy', 'sell') then q::double end as quantity,
  case when action in ('buy', 'sell') then v end as price, case when action = 'deposit' then v * 100 when action not in ('buy', 'sell') then v end as amount, null::varchar as notes from tx1)""",
    "nav": "nav as (select o_custkey % 50 as scheme_code, o_orderdate::date as date, round(avg(o_totalprice), 6) as nav from orders group by 1, 2)",
    "schemes": "schemes as (select c_custkey % 50 as scheme_code, arg_min(c_mktsegment, c_custkey) as house, arg_min(c_name, c_custkey) as name from customer group by 1)",
    "universe": """universe as (select symbol, 'INE' || upper(regexp_replace(symbol, '[^A-Za-z0-9]', '', 'g')) as isin, industry from
  (select p_brand as symbol, arg_min(p_type, row(-n, p_type)) as industry from (select p_brand, p_type, count(*) as n from part group by 1, 2) group by 1))""",
    "actions": """actions as (select symbol, (max(row(ex_date, ratio)))[1] as ex_date, 'split' as action_type, (max(row(ex_date, ratio)))[2] as ratio from
  (select p_brand as symbol, l_shipdate::date as ex_date, l_linenumber::double as ratio from lineitem join part on l_partkey = p_partkey where round(l_discount, 2) = 0.10 and l_linenumber >= 2)
  group by symbol, year(ex_date))""",
    "statements": """st0 as (select p_brand as symbol, (year(l_shipdate) + case when month(l_shipdate) >= 4 then 1 else 0 end) as y, round(sum(l_extendedprice), 2) as a, round(sum(l_extendedprice * (1 - l_discount)), 2) as b,
  round(sum(l_extendedprice * l_tax), 2) as c, round(sum(l_quantity), 2) as d from lineitem join part on l_partkey = p_partkey group by 1, 2),
statements as (select symbol, make_date(y, 3, 31) as period_end, 'annual' as freq, 'income' as statement, line_item, value from
  (select symbol, y, unnest(['Total Revenue', 'Net Income', 'Operating Cash Flow', 'Share Issued']) as line_item, unnest([a, b, c, d]) as value from st0))""",
}


def sql(query: str, *names: str, more: str = "") -> str:
    """A query over derived tables: their expressions, `more` expressions, then the query."""
    parts = [SQL[n] for n in names] + ([more] if more else [])
    return f"with {', '.join(parts)} {query}"
