"""As-of joins, rules of any width, settings as tables, common periods, databases, balances: against plainer ways."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import asof, features, ledger, panel, proposals, research, signals, universe
from marketloom.sources import lake

D = dt.date


@pytest.fixture(scope="module")
def prices(spark):
    rnd = random.Random(8)
    rows = []
    for s in range(6):
        level = 100.0
        for pos in range(s % 2 * 7, 160):
            level *= 1 + rnd.gauss(0.0005 * s, 0.02)
            rows.append((f"S{s}", D(2020, 1, 1) + dt.timedelta(days=pos), pos, round(level, 4)))
    return spark.createDataFrame(rows, "symbol string, date date, pos int, close double").cache()


def test_asof_join_by_key(spark):
    rnd = random.Random(3)
    day = lambda: None if rnd.random() < 0.05 else D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(900))
    facts = [(rnd.choice(["a", "b", None]), day(), rnd.randrange(9)) for _ in range(60)]
    rows = [(i, rnd.choice(["a", "a", "b", "c", None]), day()) for i in range(300)]
    got = asof.asof_join(spark.createDataFrame(rows, "id int, k string, d date"), spark.createDataFrame(facts, "k string, d date, v int"), "d", ["v"], ["k"], bucket_days=7)

    def newest(k, d):
        known = [(t, v) for x, t, v in facts if k is not None and x == k and d is not None and t is not None and t <= d]
        return max(known)[1] if known else None

    assert got.columns == ["id", "k", "d", "v"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(i, k, d, newest(k, d)) for i, k, d in rows]
    assert "Nested" not in got._jdf.queryExecution().toString()
    rates = asof.policy_rate_table(spark)
    assert rates.count() == 37 and rates.select("date").distinct().count() == 37


def test_rules_score_like_the_signals(spark, prices):
    runs = research.settings_table(spark, [
        {"run_id": "m", "rule": "momentum", "lookback": 20, "top_n": 2}, {"run_id": "t", "rule": "sma_trend", "fast": 5, "slow": 30, "top_n": 2}, {"run_id": "c", "rule": "sma_cross", "fast": 4, "slow": 9, "hold": 10, "top_n": 2},
        {"run_id": "r", "rule": "rsi", "period": 14, "threshold": 55, "top_n": 2}, {"run_id": "x", "rule": "rsi", "period": 14, "top_n": 2}, {"run_id": "y", "rule": "sma_trend", "fast": 9, "slow": 9, "top_n": 2}, {"run_id": "z", "rule": "none", "top_n": 2}])
    assert {r["run_id"]: r["error"] for r in runs.collect() if r["error"]} == {"x": "rsi needs period, threshold and top_n", "y": "fast must be shorter than slow", "z": "unknown rule"}
    decisions = spark.createDataFrame([(p,) for p in range(3, 160, 6)], "pos int")
    got = {(r["run_id"], r["pos"], r["symbol"]): r["score"] for r in research.rule_scores(prices, decisions, runs).collect()}
    want = {}
    for name, scores in (("m", signals.momentum_score(prices, 20)), ("t", signals.sma_trend(prices, 5, 30)), ("c", signals.sma_cross(prices, 4, 9, 10)), ("r", signals.rsi_wilder(prices, 14, 55.0))):
        for r in signals.lagged_score(scores.select("symbol", "date", "pos", "score")).join(decisions, "pos").where("score is not null").collect():
            want[name, r["pos"], r["symbol"]] = r["score"]
    assert got.keys() == want.keys() and {k[0] for k in got} == {"m", "t", "c", "r"}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_sweep_of_another_rule_and_periods(spark, prices):
    rebalances = spark.createDataFrame([(p, p + 10) for p in range(40, 150, 10)], "pos int, next_pos int").withColumn("date", F.lit(None).cast("date"))
    rows = research.parameter_sweep(prices, rebalances, {"fast": [3, 30], "slow": [20, 60]}, 100, 110, rule="sma_trend", fixed={"top_n": 2}).collect()
    errors = {r["run_id"]: r["error"] for r in rows if r["phase"] == "selection"}
    assert errors["3-60"] == "not enough history" and errors["30-20"] == "fast must be shorter than slow" and errors["3-20"] is None
    assert [r["run_id"] for r in rows if r["phase"] == "test"] == ["3-20"]
    around = research.perturbed_settings(spark, "rsi", {"period": 14, "threshold": 90.0}, 2).collect()
    assert {(r["run_id"], r["period"], r["threshold"]) for r in around} == {("baseline", 14, 90.0), ("period-", 11, 90.0), ("period+", 17, 90.0), ("threshold-", 14, 72.0), ("threshold+", 14, 99.0)}
    runs = research.settings_table(spark, [{"run_id": "a", "rule": "momentum", "lookback": 20, "top_n": 2}])
    targets = research.rule_runs(prices, rebalances, runs).cache()
    calendar = panel.calendar(prices)
    parts = {r["period"]: r for r in research.subperiod_metrics(targets, prices, rebalances, calendar, 10.0, 2, 50).collect()}
    assert [(p, parts[p]["start"], parts[p]["end"], parts[p]["error"]) for p in (1, 2)] == [(1, 40, 95, None), (2, 95, 150, None)]
    assert parts[1]["final_equity"] > 0 and all(r["error"] for r in research.subperiod_metrics(targets, prices, rebalances, calendar, 10.0, 11, 50).collect())
    # two runs, one of which begins later, are compared on what both have
    both = targets.unionByName(targets.where("pos >= 80").withColumn("run_id", F.lit("b")))
    rows = {r["run_id"]: r for r in research.strategy_comparison(both, prices, rebalances, calendar, 0.0).collect()}
    assert {r["first_pos"] for r in rows.values()} == {81} and len({r["last_pos"] for r in rows.values()}) == 1
    assert abs(rows["a"]["final_equity"] - rows["b"]["final_equity"]) < 1e-9


def test_unpriced_holdings_are_errors(spark):
    holdings = spark.createDataFrame([(1, "A", 2.0), (1, "GONE", 5.0), (2, "A", 1.0)], "account_id int, symbol string, quantity double")
    targets = spark.createDataFrame([(1, "A", 0.5), (2, "A", 0.5), (2, "NEW", 0.2)], "account_id int, symbol string, weight double")
    latest = spark.createDataFrame([("A", 10.0, "Stock"), ("B", 5.0, "Stock")], "symbol string, price double, instrument_type string")
    cash = spark.createDataFrame([(1, 100.0), (2, 90.0)], "account_id int, cash double")
    got = {(r["account_id"], r["symbol"]): (r["error"], r["target_quantity"]) for r in proposals.proposal_trades(holdings, cash, targets, latest, 0.0).collect()}
    assert got == {(1, "A"): ("the account holds something without a price", None), (1, "GONE"): ("held without a price", None), (2, "A"): (None, 5.0), (2, "NEW"): ("target without a price", None)}


def test_a_batch_merges_once(spark):
    """In an embedded database: two runs of a batch are one, a newer row wins, a batch that fails leaves nothing."""
    url, settings = "jdbc:derby:memory:lake;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    put = lambda df, name: df.write.option("createTableColumnTypes", "key VARCHAR(40)").jdbc(url, name, properties=settings)
    put(spark.createDataFrame([("a", 1.0)], "key string, value double"), '"rates"')
    rows = spark.createDataFrame([("a", 2.0, 1), ("b", 3.0, 1), ("b", 4.0, 2), (None, 5.0, 1)], "key string, value double, seen int")
    put(spark.createDataFrame([], "key string, value double, seen int"), '"rates2"')
    read = lambda: sorted((r["key"], r["value"]) for r in spark.read.jdbc(url, '"rates2"', properties=settings).collect())
    assert lake.upsert_jdbc(rows, url, "rates2", ["key"], settings, "one", merge=True, newest=["seen"])
    assert read() == [("a", 2.0), ("b", 4.0)]
    assert not lake.upsert_jdbc(rows.withColumn("value", F.lit(9.0)), url, "rates2", ["key"], settings, "one", merge=True) and read() == [("a", 2.0), ("b", 4.0)]
    assert lake.upsert_jdbc(rows.where("key = 'a'").withColumn("value", F.lit(7.0)), url, "rates2", ["key"], settings, "two", merge=True)
    assert read() == [("a", 7.0), ("b", 4.0)]
    with pytest.raises(Exception):  # noqa: B017 - a table without the column
        lake.upsert_jdbc(rows, url, "rates", ["key"], settings, "three", merge=True)
    assert [tuple(r) for r in spark.read.jdbc(url, '"rates"', properties=settings).collect()] == [("a", 1.0)]
    assert spark.read.jdbc(url, '"rates_batches"', properties=settings).count() == 0


def test_cash_of_a_batch(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(4), i, rnd.choice(["buy", "sell", "fee", "distribution"] + ["deposit"] * (i > 60)), D(2024, 1, 1) + dt.timedelta(days=i // 3), 1.0, float(rnd.randrange(50)), float(rnd.randrange(90))) for i in range(120)]
    tx = spark.createDataFrame(rows, "account_id int, event_id int, action string, date date, quantity double, price double, amount double")
    old, new = tx.where("date < '2024-01-20'"), tx.where("date >= '2024-01-20'")
    plain = lambda df: sorted((r["event_id"], round(r["cash"], 6), r["violation"]) for r in df.collect())
    whole = ledger.cash_path(tx).where("date >= '2024-01-20'")
    got = ledger.cash_path_of_batch(ledger.balances(old), new)
    assert plain(got) == plain(whole) and got.where("violation").count() > 3
    late = ledger.cash_path_of_batch(ledger.balances(new), old)
    assert late.where("not late or cash is not null or violation").count() == 0


def test_ids_tell_parts_apart(spark):
    columns = "account_id int, event_id int, action string, symbol string, date date, quantity double, price double, amount double, notes string"
    one, two = (spark.createDataFrame([(1, 1, a, s, None, None, None, None, "")], columns) for a, s in (("a|b", "c"), ("a", "b|c")))
    assert ledger.transaction_id(one).first()["transaction_id"] != ledger.transaction_id(two).first()["transaction_id"]


def test_covariances_by_blocks(spark, prices):
    returns = features.daily_returns(prices).where("not (symbol = 'S2' and pos % 11 = 0)")
    decisions = spark.createDataFrame([(60,), (110,), (159,)], "pos int")
    got = {(r["decision"], r["i"], r["j"]): r["cov"] for r in features.shrinkage_covariance(returns, decisions, window=50, size=2).collect()}
    r = returns.select("symbol", "pos", F.coalesce("r", F.lit(0.0)).alias("r")).join(decisions.withColumnRenamed("pos", "d"), (F.col("pos") < F.col("d")) & (F.col("pos") >= F.col("d") - 50))
    a, b = r.select("d", "pos", F.col("symbol").alias("i"), F.col("r").alias("x")), r.select("d", "pos", F.col("symbol").alias("j"), F.col("r").alias("y"))
    want = {(x["d"], x["i"], x["j"]): x["s"] * 252 * (1 if x["i"] == x["j"] else 0.75) + (1e-6 if x["i"] == x["j"] else 0) for x in a.join(b, ["d", "pos"]).where("i <= j").groupBy("d", "i", "j").agg(F.covar_samp("x", "y").alias("s")).collect()}
    assert got.keys() == want.keys() and len(got) == 63 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # with as many factors as symbols the model is the sample's covariance
    whole = features.daily_returns(prices.where("pos >= 7"))
    model = {x["symbol"]: x for x in features.factor_covariance(whole, decisions.where("pos = 110"), 6, 50, size=4).collect()}
    sample = {(x["i"], x["j"]): x["cov"] for x in features.shrinkage_covariance(whole, decisions.where("pos = 110"), 0.0, 50).collect()}
    for (i, j), cov in sample.items():
        made = sum(p * q * v for p, q, v in zip(model[i]["loadings"], model[j]["loadings"], model[i]["factor_var"], strict=True)) + (model[i]["specific"] - 1e-6 if i == j else 0)
        assert abs(made - cov) < 2e-6


def test_ranked_funds(spark):
    rows = [(i, f"Fund {i} Direct Growth", "H", D(2024, 1, 1), None if i == 3 else i / 100) for i in range(1, 8)] + [(9, "Fund Regular", "H", D(2024, 1, 1), 0.5), (10, "Old Direct Growth", "H", D(2023, 1, 1), 0.5)]
    catalog = spark.createDataFrame(rows, "scheme_code int, name string, house string, latest_date date, return_1y double")
    got = [(r["scheme_code"], r["place"], r["funds"]) for r in universe.rank_funds(catalog, size=4).orderBy("place").collect()]
    assert got == [(7, 1, 7), (6, 2, 7), (5, 3, 7), (4, 4, 7)]
    assert [r["scheme_code"] for r in universe.rank_funds(catalog, page=1, size=4).orderBy("place").collect()] == [2, 1, 3]
    assert [r["scheme_code"] for r in universe.rank_funds(catalog, "fund 5").collect()] == [5]


def test_rates_of_summed_days(spark):
    """Flows of a day count as one; an account with most rows is as long as its days; the signs are those of the flows."""
    day = lambda i: D(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(1, day(i % 40), -1.0) for i in range(4000)] + [(1, day(400), 4400.0)]
    rows += [(2, day(0), -100.0), (2, day(365), 110.0), (3, day(0), -5.0), (3, day(9), None), (4, day(0), 7.0), (4, day(0), -7.0), (4, day(365), 3.0)]
    got = {r["account_id"]: (r["rate"], r["note"]) for r in ledger.xirr(spark.createDataFrame(rows, "account_id int, date date, amount double")).collect()}
    value = sum(a / (1 + got[1][0]) ** ((d - day(0)).days / 365) for k, d, a in rows if k == 1)
    assert abs(value) < 1e-6 and got[1][1] is None
    assert abs(got[2][0] - 0.1) < 1e-9
    assert got[3] == (None, "flows have one sign") and got[4] == (None, "no root in range")


def test_verdict_of_runs(spark):
    """Evidence of two runs from prices that only rise in one of them: a winner beats the draws, a loser doesn't."""
    rnd, days = random.Random(3), 190
    rows = []
    for k in range(8):
        close = 50.0
        for i in range(days):
            rows.append((f"S{k}", D(2023, 1, 1) + dt.timedelta(days=i), i, close))
            close *= 1 + (0.004 if k == 0 else -0.004 if k == 1 else 0.0) + rnd.gauss(0, 0.004)
    prices = spark.createDataFrame(rows, "symbol string, date date, pos int, close double")
    calendar = prices.select("pos", "date").distinct()
    rebalances = signals.rebalance_dates(calendar, 10, 180, 10)
    targets = rebalances.select("pos").crossJoin(spark.createDataFrame([("up", "S0", 0.9), ("up", "CASH", 0.1), ("down", "S1", 0.9), ("down", "CASH", 0.1)], "run_id string, symbol string, weight double")).select("run_id", "pos", "symbol", "weight")
    evidence = research.run_evidence(targets, prices, rebalances, calendar, 10.0, 1, least=30).cache()
    got = {r["run_id"]: r for r in evidence.collect()}
    assert got["up"]["baseline"] > got["up"]["at_max_cost"] > 0 and got["up"]["subperiods_positive"] == 1.0 and got["up"]["ci_low"] > 0
    assert got["down"]["baseline"] < 0 and got["down"]["subperiods_positive"] == 0.0 and got["down"]["placebo_percentile"] == 0.0
    assert got["up"]["placebo_percentile"] >= 0.9
    words = {r["run_id"]: (r["passed"], r["verdict"]) for r in research.verdict(evidence).collect()}
    assert words == {"up": (5, "supported"), "down": (0, "falsified")}
    assert research.run_evidence(targets.limit(0), prices, rebalances, calendar, 10.0, 1, least=30).count() == 0


def test_no_rebalances_have_no_stretches(spark, prices):
    calendar = prices.select("pos", "date").distinct()
    none = signals.rebalance_dates(calendar, 900, 900, 20)
    targets = spark.createDataFrame([("a", 1, "CASH", 1.0)], "run_id string, pos int, symbol string, weight double")
    got = research.subperiod_metrics(targets, prices, none, calendar, 10.0).collect()
    assert len(got) == 4 and all(r["error"] == "too short after splitting" for r in got)
