"""Readers, keyed writes and incremental jobs on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from marketloom.operators import asof
from marketloom.sources import lake, payloads
from marketloom.streaming import jobs

D = dt.date


def put(folder, name, content):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_price_csv(spark, tmp_path):
    wide = "Date , aaa,bbb\n" + "\n".join(f"2024-01-{d:02d},{d}.5,{'' if d > 5 else d}" for d in range(1, 21)) + "\nnonsense,1,1\n2024-01-20,99,\n"
    got = payloads.read_price_csv(spark, put(tmp_path, "w.csv", wide)).collect()
    assert {r["symbol"] for r in got} == {"AAA"} and len(got) == 20 and [r["close"] for r in got if r["date"] == D(2024, 1, 20)] == [99.0]
    problems = payloads.price_csv_problems(spark.createDataFrame(got)).collect()
    assert {r["problem"] for r in problems} == {"fewer than 2 symbols", "fewer than 260 dates"}


def test_json_payloads(spark, tmp_path):
    bars = payloads.read_bars_json(spark, put(tmp_path, "b.json", {"symbol": "X", "data": {"candles": [["2024-01-02T09:15:00+05:30", 1, 2, 0.5, 1.5, 10, None]]}})).first()
    assert bars["ts_utc"] == dt.datetime(2024, 1, 2, 3, 45) and bars["volume"] == 10 and bars["open_interest"] is None
    nav = payloads.read_fund_nav_json(spark, put(tmp_path, "n.json", {"meta": {"scheme_code": 7, "fund_house": "H"}, "data": [{"date": "02-01-2024", "nav": "10.5"}, {"date": "bad", "nav": "1"}, {"date": "03-01-2024", "nav": "x"}]})).collect()
    assert [(r["scheme_code"], r["date"], r["nav"]) for r in nav] == [(7, D(2024, 1, 2), 10.5)]
    fred = payloads.read_fred_json(spark, put(tmp_path, "f.json", {"observations": [{"date": "2024-01-01", "value": ".", "realtime_start": "2024-02-01"}, {"date": "2024-02-01", "value": "3", "realtime_start": "2024-03-01"}]}), "S").collect()
    assert [(r["date"], r["value"]) for r in fred] == [(D(2024, 2, 1), 3.0)]
    wb = payloads.read_worldbank_json(spark, put(tmp_path, "w.json", [{"page": 1}, [{"indicator": {"id": "GDP"}, "countryiso3code": "IND", "date": "2020", "value": 5.0}, {"indicator": {"id": "GDP"}, "date": "2021", "value": None}]])).collect()
    assert [(r["series_id"], r["date"], r["value"]) for r in wb] == [("GDP", D(2020, 12, 31), 5.0)]
    holders = payloads.read_shareholding_json(spark, put(tmp_path, "s.json", [{"symbol": "X", "date": "31-Mar-2024", "pr_and_prgrp": "51.2", "public_val": "-", "employeeTrusts": "0"}])).first()
    assert holders["date"] == D(2024, 3, 31) and holders["promoters"] == 51.2 and holders["public"] is None
    index = put(tmp_path, "c.jsonl", '{"url":"u","timestamp":"20240102030405","status":"200","mime":"text/html","offset":"5","length":"9"}\nnot json\n{"url":"v","status":"404"}\n{"url":"w","mime":"image/png"}\n')
    assert [(r["url"], r["offset"]) for r in payloads.read_capture_index(spark, index).collect()] == [("u", 5)]


def test_xml_payloads(spark, tmp_path):
    rss = put(tmp_path, "r.xml", "<rss><channel><item><title>&lt;b&gt;Big&lt;/b&gt; news</title><description>d</description><link>http://a/b?utm_source=x</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>Markets</title><link>http://a/c</link></item></channel></rss>")
    got = payloads.read_rss_xml(spark, rss, "f").collect()
    assert [(r["title"], r["url"], r["published"]) for r in got] == [("Big news", "http://a/b", dt.datetime(2024, 1, 2, 3, 4, 5))]
    site = put(tmp_path, "s.xml", "<urlset><url><loc> http://x/2024-January-2.xml </loc><lastmod>2024-01-02T00:00:00Z</lastmod></url><url><loc>http://x/2024-January-10.xml</loc></url></urlset>")
    rows = payloads.read_sitemap_xml(spark, site)
    assert rows.count() == 2 and [r["part"] for r in payloads.sitemap_parts(rows, 2024, "January").collect()] == [2, 10]


def test_grid(spark):
    cells = [("f", 0, 0, "Profit & Loss"), ("f", 1, 0, "Report Date"), ("f", 1, 1, "2023-03-31"), ("f", 1, 2, "2024-03-31"), ("f", 2, 0, "Sales"), ("f", 2, 1, "10"), ("f", 2, 2, "12"), ("f", 3, 0, "Balance Sheet"), ("f", 4, 0, "Report Date"), ("f", 4, 1, "2024-03-31"), ("f", 5, 0, "Debt"), ("f", 5, 1, "3")]
    got = payloads.grid_to_long(spark.createDataFrame(cells, "file string, row int, col int, value string"), {"profit & loss": "pl", "balance sheet": "bs"}).collect()
    assert {(r["section"], r["line_item"], r["period_end"], r["value"]) for r in got} == {("pl", "Sales", D(2023, 3, 31), 10.0), ("pl", "Sales", D(2024, 3, 31), 12.0), ("bs", "Debt", D(2024, 3, 31), 3.0)}


def test_melt_and_stats(spark):
    df = spark.createDataFrame([("Sales", 1.0, None), ("Cost", 2.0, 3.0)], "line_item string, `2023-03-31` double, `2024-03-31` double")
    assert payloads.melt_statements(df, "X", "annual", "income").count() == 3
    stats = payloads.key_stats_long(spark.createDataFrame([("X", {"beta": "1.2", "name": "n", "other": "o"})], "symbol string, info map<string,string>"), ["beta", "name"])
    assert {(r["key"], r["value_num"]) for r in stats.collect()} == {("beta", 1.2), ("name", None)}
    steps = spark.createDataFrame([(D(2020, 1, 1), 5.0), (D(2021, 1, 1), 4.0)], "date date, rate double")
    asked = spark.createDataFrame([(D(2019, 1, 1),), (D(2020, 6, 1),), (D(2021, 1, 1),)], "date date")
    assert [r["rate"] for r in asof.policy_rate_asof(steps, asked).orderBy("date").collect()] == [None, 5.0, 4.0]


def test_upsert_and_worklist(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = lambda *x: spark.createDataFrame(list(x), "symbol string, ts_utc timestamp, close double")
    t = lambda d: dt.datetime(2024, 1, d)
    lake.upsert_parquet(rows(("A", t(1), 1.0), ("A", t(2), 2.0), ("B", t(1), 3.0)), path, ["symbol", "ts_utc"], ["symbol"], ["ts_utc"])
    lake.upsert_parquet(rows(("A", t(2), 9.0), ("A", t(3), 4.0)), path, ["symbol", "ts_utc"], ["symbol"], ["ts_utc"])
    lake.upsert_parquet(rows(), path, ["symbol", "ts_utc"], ["symbol"])
    # without partitions: written beside, an interrupted swap is mended, an order tells what is newer
    flat = str(tmp_path / "flat")
    lake.upsert_parquet(rows(("A", t(1), 1.0), ("A", t(2), 2.0)), flat, ["symbol", "ts_utc"])
    (tmp_path / "flat").rename(tmp_path / "flat._old")
    both = rows(("A", t(2), 9.0), ("A", t(2), 4.0), ("C", t(1), 3.0)).withColumn("seen", F.expr("if(close = 4.0, 2, 1)"))
    lake.upsert_parquet(both.select("symbol", "ts_utc", "close", "seen"), flat, ["symbol", "ts_utc"], newest=["seen"])
    assert {(r["symbol"], r["ts_utc"].day, r["close"]) for r in spark.read.parquet(flat).collect()} == {("A", 1, 1.0), ("A", 2, 4.0), ("C", 1, 3.0)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["flat", "lake"]
    assert {(r["symbol"], r["ts_utc"].day, r["close"]) for r in spark.read.parquet(path).collect()} == {("A", 1, 1.0), ("A", 2, 9.0), ("A", 3, 4.0), ("B", 1, 3.0)}
    done = spark.createDataFrame([("A", D(2024, 1, 15), "done", "2024-03-01"), ("A", D(2024, 2, 1), "failed", "2024-03-01")], "symbol string, from_date date, status string, ts string")
    work = lake.backfill_worklist(spark.createDataFrame([("A",)], "symbol string"), "2024-01-15", "2024-03-10", done, 10, "2024-03-05").orderBy("from_date").collect()
    assert [(r["from_date"], r["to_date"]) for r in work] == [(D(2024, 2, 1), D(2024, 2, 29)), (D(2024, 3, 1), D(2024, 3, 10))]
    assert lake.upsert_statement("t", "s", ["a", "b"], ["a"]) == 'insert into "t" ("a", "b") select "a", "b" from "s" on conflict ("a") do update set "b" = excluded."b"'
    status = lake.ingest_status(spark.createDataFrame([("d", "k1", "done", 5), ("d", "k2", "failed", 0)], "dataset string, key string, status string, rows long")).first()
    assert (status["done"], status["failed"], status["rows"], status["failed_keys"]) == (1, 1, 5, "k2")


def test_daily_close(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, 3, 45), 1.0), ("A", dt.datetime(2024, 1, 1, 9, 0), 2.0), ("A", dt.datetime(2024, 1, 1, 20, 0), 3.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts_utc timestamp, close double")
    lake.write_bars(bars, str(tmp_path / "bars"), "minute")
    got = payloads.read_daily_close(spark, str(tmp_path / "bars"), "2024-01-01", "2024-01-01").collect()
    assert [(r["date"], r["close"]) for r in got] == [(D(2024, 1, 1), 2.0)]
    assert payloads.absent_symbols(spark.createDataFrame([("A",), ("Z",)], "symbol string"), spark.createDataFrame(got)).collect() == [("Z",)]


def test_bars_are_merged(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = lambda rows: spark.createDataFrame(rows, "symbol string, ts_utc timestamp, close double")
    t = lambda day, minute: dt.datetime(2024, 1, day, 5, minute)
    lake.write_bars(bars([("A", t(1, 0), 1.0), ("A", t(1, 1), 2.0), ("B", t(1, 0), 9.0)]), path, "minute")
    lake.write_bars(bars([("A", t(1, 1), 3.0), ("A", t(2, 0), 4.0)]), path, "minute")
    got = sorted((r["symbol"], r["ts_utc"].day, r["ts_utc"].minute, r["close"]) for r in spark.read.parquet(path).collect())
    assert got == [("A", 1, 0, 1.0), ("A", 1, 1, 3.0), ("A", 2, 0, 4.0), ("B", 1, 0, 9.0)]
