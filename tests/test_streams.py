"""Stream jobs: any cut of the input into batches gives what the operators over whole tables give."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger
from marketloom.sources import lake, runs
from marketloom.streaming import jobs, positions

D = dt.date


def drain(stream, folder, name):
    """Runs the stream to the end of its input and returns the rows so far."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def fed(spark, folder, batches, make, name):
    """Rows out of the stream `make` when files arrive batch by batch, with a restart between; a row far ahead ends the last day."""
    batches = [*batches, [(-1, 0, "fee", None, D(2030, 1, 1), None, None, 0.0)], [(-1, 1, "fee", None, D(2030, 1, 9), None, None, 0.0)]]
    for some in (batches[:1], batches[1:]):
        for rows in some:
            spark.createDataFrame(rows, positions.TX_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-in")
        drain(make(spark.readStream.schema(positions.TX_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in")), folder, name)
    return spark.read.parquet(f"{folder}/{name}").where("account_id >= 0")


@pytest.fixture(scope="module")
def book():
    """One account with most rows, ties in a day, partial matches, two groups that sell too much."""
    rnd, rows, held = random.Random(2), [], {}
    for i in range(400):
        account = 0 if rnd.random() < 0.7 else rnd.randrange(1, 5)
        symbol, day = rnd.choice("AB"), D(2024, 1, 1) + dt.timedelta(days=i // 16)
        key = (account, symbol)
        draw = rnd.random()
        if draw < 0.15:
            rows.append((account, i, rnd.choice(["deposit", "fee", "distribution"]), None, day, None, None, float(rnd.randrange(1, 900))))
        elif draw < 0.6 or held.get(key, 0) < 1:
            q = rnd.randrange(1, 9)
            held[key] = held.get(key, 0) + q
            rows.append((account, i, "buy", symbol, day, float(q), float(rnd.randrange(5, 90)), None))
        else:
            q = rnd.randrange(1, held[key] + 1)
            held[key] -= q
            rows.append((account, i, "sell", symbol, day, float(q), float(rnd.randrange(5, 90)), None))
    return rows + [(3, 1000, "sell", "A", D(2024, 1, 20), 500.0, 9.0, None), (4, 1001, "sell", "C", D(2024, 1, 2), 1.0, 9.0, None), (4, 1002, "buy", "C", D(2024, 1, 3), 1.0, 9.0, None)]


def cut(rows, seed):
    """By day in batches of some days; inside a batch rows stand in any order."""
    rnd = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[4])
    out = []
    while rows:
        n = rnd.randrange(60, 200)
        last = rows[min(n, len(rows)) - 1][4]
        part = [r for r in rows if r[4] <= last]
        rows = rows[len(part) :]
        rnd.shuffle(part)
        out.append(part)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_lots_of_any_cut(spark, tmp_path, book, seed):
    tx = spark.createDataFrame(book, positions.TX_SCHEMA).withColumn("instrument_type", F.lit("Stock"))
    told = fed(spark, tmp_path, cut(book, seed), positions.running_lots, "lots").cache()
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = ledger.fifo_match(tx)
    got = positions.matches_told(told)
    assert got.columns == want.columns and plain(got) == plain(want) and got.count() > 50
    assert plain(positions.lots_told(told)) == plain(ledger.open_lots(tx, want).drop("instrument_type"))
    wrong = {(r["account_id"], r["symbol"]) for r in told.where("kind = 'oversold'").collect()}
    assert wrong == {(r["account_id"], r["symbol"]) for r in ledger.oversells(tx).collect()} == {(3, "A"), (4, "C")}


def test_cash_of_any_cut(spark, tmp_path, book):
    path = {r["event_id"]: r for r in ledger.cash_path(spark.createDataFrame(book, positions.TX_SCHEMA)).collect()}
    told = {r["event_id"]: r for r in fed(spark, tmp_path, cut(book, 5), positions.running_positions, "cash").collect()}
    assert told.keys() == path.keys()
    assert all(abs(told[k]["cash"] - path[k]["cash"]) < 1e-6 for k in path)
    assert {k for k in told if told[k]["violation"] == "oversold"} >= {1000, 1001}


def test_rows_within_the_lateness_are_booked_in_order(spark, tmp_path):
    buy = lambda i, day, price: (1, i, "buy", "S", day, 1.0, price, None)
    batches = [[buy(2, D(2024, 1, 3), 20.0), (1, 3, "sell", "S", D(2024, 1, 4), 1.0, 30.0, None)], [buy(1, D(2024, 1, 2), 10.0)]]
    told = fed(spark, tmp_path, batches, lambda tx: positions.running_lots(tx, "3 days"), "late")
    assert [(r["buy_id"], r["sell_id"]) for r in positions.matches_told(told).collect()] == [(1, 3)]


def test_runs_read_like_an_upsert(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 3)
    rnd = random.Random(4)
    path, table = str(tmp_path / "runs"), str(tmp_path / "table")
    for number in range(10):
        rows = [(rnd.choice("ABC"), dt.datetime(2024, 1, rnd.randrange(1, 20)), float(number), n) for n in range(12)]
        batch = spark.createDataFrame(rows, "symbol string, ts_utc timestamp, close double, n int").coalesce(1)
        before = {p.name for p in (tmp_path / "runs" / "runs").iterdir()} if number else set()
        for _ in range(2 if number == 4 else 1):  # a batch that comes again changes nothing
            runs.append(batch, path, number, ["symbol", "ts_utc"], ["n"])
        lake.upsert_parquet(batch, table, ["symbol", "ts_utc"], newest=["n"])
        assert {p.name for p in (tmp_path / "runs" / "runs").iterdir()} - before >= {f"{number}-{number}"}
    assert runs.live_runs(spark, path) == [(0, 8), (9, 9)]
    plain = lambda df: sorted(map(tuple, df.select("symbol", "ts_utc", "close").collect()))
    want = plain(spark.read.parquet(table))
    assert plain(runs.read(spark, path, ["symbol", "ts_utc"])) == want
    # a run without its mark does not count; one that was removed too early would
    (tmp_path / "runs" / "runs" / "0-26").mkdir()
    assert runs.live_runs(spark, path) == [(0, 8), (9, 9)]
    assert runs.vacuum(spark, path, 10**12, 0) == 0 and runs.vacuum(spark, path, -(10**15), 0) == 12
    assert plain(runs.read(spark, path, ["symbol", "ts_utc"])) == want
    assert runs.read(spark, str(tmp_path / "none"), ["a"], "a int").columns == ["a"]


def test_stream_bars(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda d, c: ("A", dt.datetime(2024, 1, d), c, c, c, c, 1, 0)
    for some in ([row(1, 1.0), row(1, 1.0), row(2, 2.0)], [row(2, 5.0), row(2, 4.0)], [row(1, 3.0)], [row(1, 1.0)]):
        spark.createDataFrame(some, jobs.BAR_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_bars(spark, src, path, str(tmp_path / "cp")).awaitTermination()
    # the first value of day 1 comes back after a correction and is the newest again
    assert {(r["ts_utc"].day, r["close"]) for r in jobs.streamed_bars(spark, path).collect()} == {(1, 1.0), (2, 4.0)}
    assert jobs.streamed_bars(spark, path).columns == [c.split()[0] for c in jobs.BAR_SCHEMA.split(", ")]


def feed_file(folder, name, items):
    folder.mkdir(parents=True, exist_ok=True)
    body = "".join(f"<item><title>{t}</title><link>{u}</link><description>&lt;p&gt;{d}&lt;/p&gt;</description>{f'<pubDate>{p}</pubDate>' if p else ''}</item>" for t, u, d, p in items)
    (folder / name).write_text(f"<?xml version='1.0'?><rss><channel>{body}</channel></rss>")


def test_stream_news(spark, tmp_path):
    when = lambda d, h=0: f"Mon, {d:02d} Jan 2024 {h:02d}:00:00 +0000"
    aliases = spark.createDataFrame([("tata", "T"), ("tata steel", "TS")], "alias string, symbol string")
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    steps = [
        ("a", "1.xml", [("Tata Steel up", "http://x/1?utm_id=3", "", when(10)), ("Again", "http://x/1#top", "", when(10, 2)), ("Markets", "http://x/9", "", when(10)), ("", "http://x/8", "", when(10))]),
        ("b", "2.xml", [("Other feed", "http://x/1", "", when(11)), ("Tata", "http://x/2", "l&amp;t", when(20))]),
        ("b", "3.xml", [("Too late", "http://x/3", "", when(2)), ("In time", "http://x/4", "on tata&amp;sons", when(19))]),
        ("a", "4.xml", [("No time", "http://x/5", "", None)]),
    ]
    counts = jobs.NewsCounts()
    for feed, name, items in steps:
        feed_file(source / feed, name, items)
        query = jobs.stream_news(spark, str(source), out, cp, aliases, counts=counts)
        query.awaitTermination()
    rows = {r["url"]: r for r in spark.read.parquet(out).collect()}
    assert {u: (r["feed"], r["symbols"]) for u, r in rows.items()} == {"http://x/1": ("a", "TS"), "http://x/2": ("b", "T"), "http://x/4": ("b", "T"), "http://x/5": ("a", None)}
    assert rows["http://x/2"]["day"] == D(2024, 1, 20)
    for _ in range(100):  # events reach the listener a little later
        if counts.totals["arrived"] == 7 and counts.totals["written"] + counts.totals["repeats"] + counts.totals["late"] == 7:
            break
        time.sleep(0.1)
    assert {k: v for k, v in counts.totals.items() if k != "batches"} == {"arrived": 7, "written": 4, "repeats": 2, "late": 1}
    spark.streams.removeListener(counts)
