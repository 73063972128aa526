"""Operators on hand-made inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import equity, features, ledger, news, options, panel, quality, research, signals, universe

D = dt.date


def days(n, start=D(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def shaped(spark):
    rows = [(s, d, float(f(i))) for i, d in enumerate(days(320)) for s, f in (("AAA", lambda i: 100 + i * 0.25), ("BBB", lambda i: 100 - i * 0.03), ("CCC", lambda i: 100 + (i % 10)))]
    return panel.dense(spark.createDataFrame(rows, "symbol string, date date, close double"))


def test_gaps(spark):
    d = days(60)
    rows = [("AAA", x, 1.0) for x in d] + [("STALE", x, 2.0) for x in d[:30]] + [("NEWLY", x, 3.0) for x in d[20:]] + [("BRIEF", x, 4.0) for x in d[10:40]] + [("HOLE", x, 5.0) for i, x in enumerate(d) if not 20 <= i < 27]
    clean = panel.ffill_limited(panel.align_calendar(spark.createDataFrame(rows, "symbol string, date date, close double")))
    status = {r["symbol"]: r["status"] for r in panel.classify_gaps(clean).collect()}
    assert status == {"AAA": "kept", "STALE": "kept", "NEWLY": "kept", "BRIEF": "kept", "HOLE": "excluded"}
    edges = {r["symbol"]: (r["eligible_from"], r["eligible_through"]) for r in panel.eligibility(clean).collect()}
    assert edges["AAA"] == (None, None) and edges["NEWLY"][0] == d[20] and edges["STALE"][1] == d[34]
    kept = panel.clean(spark.createDataFrame(rows, "symbol string, date date, close double"))
    assert kept.where("close is null").count() == 0 and kept.where("symbol = 'BRIEF' and is_placeholder").count() == 60 - 35


def test_rsi(spark):
    rows = [("UP", d, 100.0 + i) for i, d in enumerate(days(40))] + [("FLAT", d, 5.0) for d in days(40)]
    p = panel.dense(spark.createDataFrame(rows, "symbol string, date date, close double"))
    last = {r["symbol"]: r["rsi"] for r in signals.rsi_wilder(p).where("pos = 39").collect()}
    assert last == {"UP": 100.0, "FLAT": 50.0}
    assert signals.rsi_wilder(p).where("pos < 14 and rsi is not null").count() == 0


def test_features_are_lagged(shaped):
    raw = features.raw_features(shaped).where("symbol = 'AAA'").orderBy("pos").collect()
    assert raw[21]["momentum_21d"] is None and raw[22]["momentum_21d"] == pytest.approx((100 + 21 * 0.25) / 100 - 1)
    z = features.feature_panel(shaped).where("pos = 200").agg(*[F.abs(F.avg(c)).alias(c) for c in features.FEATURES]).first()
    assert max(z) < 1e-9


def test_capped_weights(spark):
    raw = spark.createDataFrame([(1, "A", 10.0), (1, "B", 1.0), (1, "C", 1.0), (2, "A", 0.0), (2, "B", 0.0), (3, "A", 5.0), (3, "B", 0.0), (3, "C", 0.0)], "pos int, symbol string, raw double")
    w = {(r["pos"], r["symbol"]): r["weight"] for r in signals.capped_weights(raw, F.lit(0.9), F.lit(0.4)).collect()}
    assert w[1, "A"] == pytest.approx(0.4) and w[1, "B"] == pytest.approx(0.25) and w[2, "A"] == pytest.approx(0.4)
    assert w[3, "A"] == pytest.approx(0.4) and w[3, "B"] == w[3, "C"] == pytest.approx(0.25)


def test_costs_and_contributions(spark, shaped):
    cal = panel.calendar(shaped)
    rebalances = signals.rebalance_dates(cal, 40, 300, 20)
    targets = signals.with_cash(rebalances.crossJoin(spark.createDataFrame([("AAA", 0.5), ("BBB", 0.3)], "symbol string, weight double")).select("pos", "symbol", "weight")).withColumn("run_id", F.lit("x"))
    values = equity.interval_values(targets, shaped, rebalances)
    held = equity.drifted_holdings(values)
    changed = equity.changes(targets, held, rebalances)
    costs = equity.self_financing_cost(changed, 10.0)
    first = costs.orderBy("pos").first()["cost"]
    assert first == pytest.approx(0.001 * 0.8 * (1 - first), rel=1e-9)
    curve = equity.equity_curve(equity.interval_growth(values), costs, rebalances)
    gross = curve.orderBy(F.desc("day_pos")).first()["gross_equity"]
    parts = equity.return_contributions(held, targets, shaped, curve).agg(F.sum("contribution")).first()[0]
    assert parts == pytest.approx(gross - 1, abs=1e-9)
    assert equity.performance_metrics(curve, equity.rebalance_log(targets, equity.turnover(changed), costs, curve), cal).count() == 1


def test_concentration(spark):
    w = spark.createDataFrame([("r", 1, s, 0.2) for s in "ABCD"] + [("r", 1, "CASH", 0.2)], "run_id string, pos int, symbol string, weight double")
    assert equity.concentration(w).first()["hhi"] == pytest.approx(0.25)


TX = "account_id long, event_id long, action string, symbol string, instrument_type string, date date, quantity double, price double, amount double, notes string"


def test_positions_that_cost_nothing(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from marketloom.plans import book_queries

    at = dt.datetime(2024, 1, 2)
    rows = [(3, at, 1, "purchase", 0.0), (6, at, 2, "purchase", 4.0), (9, at, 2, "purchase", 8.0), (4, at, 3, "purchase", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = book_queries.f7_value_positions(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2:] for r in con.execute(f'select account_id, symbol, cost, value, "return" from ({book_queries.R.oracle["f7_value_positions"]})').fetchall()}
    assert {(r["account_id"], r["symbol"]): (r["cost"], r["value"], r["return"]) for r in got.collect()} == want
    assert want[1, "S0"] == (0.0, 24.0, float("inf")) and want[3, "S1"] == (0.0, None, None)


def test_fifo(spark):
    tx = spark.createDataFrame([(1, 1, "buy", "S", "Stock", D(2020, 1, 1), 10.0, 80.0, None, None), (1, 2, "buy", "S", "Stock", D(2020, 2, 1), 20.0, 110.0, None, None), (1, 3, "sell", "S", "Stock", D(2020, 3, 1), 15.0, 130.0, None, None),
                                (2, 4, "buy", "S", "Stock", D(2020, 3, 1), 1.0, 1.0, None, None), (2, 5, "sell", "S", "Stock", D(2020, 3, 1), 2.0, 1.0, None, None)], TX)
    m = ledger.fifo_match(tx)
    assert [(r["quantity"], r["gain"]) for r in m.where("account_id = 1").orderBy("buy_id").collect()] == [(10.0, 500.0), (5.0, 100.0)]
    lots = ledger.open_lots(tx, m)
    assert [(r["quantity"], r["purchase_price"]) for r in lots.where("account_id = 1").collect()] == [(15.0, 110.0)]
    assert ledger.oversells(tx).select("account_id", "short_by").collect() == [(2, 1.0)]
    bad = ledger.validate_transactions(tx.withColumn("quantity", F.when(F.col("event_id") == 2, 1.5).otherwise(F.col("quantity"))), "2021-01-01").collect()
    assert [(r["event_id"], r["reason"]) for r in bad] == [(2, "stocks trade in whole shares")]
    fresh = ledger.append_transactions(tx.where("event_id < 3"), tx.unionByName(tx.where("event_id = 3").withColumn("event_id", F.lit(9).cast("long"))))
    assert sorted(r["event_id"] for r in fresh.collect()) == [3, 4, 5]


def test_returns_on_flows(spark):
    flows = spark.createDataFrame([(1, D(2020, 1, 1), -1000.0), (1, D(2020, 12, 31), 1100.0), (2, D(2020, 1, 1), -5.0)], "account_id long, date date, amount double")
    got = {r["account_id"]: (r["rate"], r["note"]) for r in ledger.xirr(flows).collect()}
    assert got[1][0] == pytest.approx(0.1, abs=1e-3) and got[2] == (None, "flows have one sign")
    spans = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 31), 0.0, 1100.0)], "account_id long, start date, end date, start_value double, end_value double")
    paid = spark.createDataFrame([(1, D(2020, 1, 16), 1000.0)], "account_id long, date date, amount double")
    assert ledger.modified_dietz(paid, spans).first()["dietz"] == pytest.approx(0.2)


def test_options(spark):
    rows = [(t, 100.0, 100.0, 365, 0.2, 0.05, 0.0) for t in ("call", "put")]
    p = {r["option_type"]: r for r in options.price_contracts(spark.createDataFrame(rows, "option_type string, spot double, strike double, days int, vol double, rate double, dividend double")).collect()}
    assert p["call"]["price"] - p["put"]["price"] == pytest.approx(100 - 100 * 2.718281828459045**-0.05, abs=1e-6)
    assert p["call"]["price"] == pytest.approx(10.4506, abs=1e-3) and p["call"]["gamma"] == pytest.approx(p["put"]["gamma"])
    dead = spark.createDataFrame([("put", 90.0, 100.0, 0, 0.2, 0.05, 0.0)], "option_type string, spot double, strike double, days int, vol double, rate double, dividend double")
    r = options.price_contracts(dead).first()
    assert (r["price"], r["delta"], r["gamma"]) == (10.0, -1.0, 0.0)


def test_payoff(spark):
    legs = options.template_legs(spark.createDataFrame([("X", 102.0, 5.0)], "symbol string, spot double, spacing double"))
    legs = legs.withColumn("days", F.lit(30)).withColumn("vol", F.lit(0.2)).withColumn("rate", F.lit(0.05)).withColumn("dividend", F.lit(0.0)).withColumn("lot_size", F.lit(1))
    priced = options.price_contracts(legs)
    s = {r["strategy_id"]: r for r in options.payoff_summary(options.expiry_payoff(priced), priced).collect()}
    assert s["X-straddle"]["max_profit"] is None and len(s["X-straddle"]["breakevens"].split(",")) == 2
    assert s["X-iron_condor"]["max_profit"] is not None and s["X-iron_condor"]["max_loss"] < 0
    assert options.scenario_matrix(priced).where("spot_move = 0 and vol_move = 0 and strategy_id = 'X-straddle'").first()["pnl"] < 0


def test_splits(spark):
    acts = spark.createDataFrame([("A", D(2020, 1, 1), "split", 2.0), ("A", D(2021, 1, 1), "split", 5.0), ("A", D(2021, 1, 1), "dividend", 3.0)], "symbol string, ex_date date, action_type string, ratio double")
    f = {(r["ex_date"], r["action_type"]): r["split_adj_factor"] for r in universe.split_factor(acts).collect()}
    assert f[D(2020, 1, 1), "split"] == pytest.approx(5.0) and f[D(2021, 1, 1), "split"] == pytest.approx(1.0)


def test_entities(spark):
    aliases = spark.createDataFrame([("tata motors", "TM"), ("tata", "T"), ("motors finance", "MF")], "alias string, symbol string")
    docs = spark.createDataFrame([(1, "Tata Motors Finance up; Tata down"), (2, "tatami"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["symbols"] for r in news.entity_match(docs, aliases).collect()} == {1: "T,TM"}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normalize_text(F.lit("The Reliance Industries Ltd. & Co, (India)")).alias("n"), text.canonical_url(F.lit("http://a.b/c?x=1&UTM_Source=z&y=#f")).alias("u"), text.canonical_url(F.lit("http://a.b/c?utm_id=1")).alias("v"),
        text.byline_names(F.lit("Ann Lee and Bo Ray, SECTIONS top, Agent 007,")).alias("b"), text.company_query_name(F.lit("Acme Corp. Ltd.")).alias("c")).first()
    assert row["n"] == "reliance &" and row["u"] == "http://a.b/c?x=1&y=" and row["v"] == "http://a.b/c" and row["b"] == ["Ann Lee", "Bo Ray"] and row["c"] == "Acme"


def test_quality(spark):
    bars = spark.createDataFrame([("A", 1, 10.0, 9.0, 8.0, 10.0), ("A", 1, 10.0, 11.0, 9.0, 10.0), ("B", 1, -1.0, 5.0, -1.0, 2.0)], "symbol string, ts int, open double, high double, low double, close double")
    assert {(r["symbol"], r["check"]) for r in quality.check_prices(bars).collect()} == {("A", "inconsistent_ohlc"), ("A", "duplicate_timestamps"), ("B", "nonpositive_price")}


def test_verdict(spark):
    rows = [("a", 1.0, 0.5, 0.8, 0.95, 0.1), ("b", -1.0, 0.5, 0.8, 0.95, 0.1), ("c", 1.0, 0.5, 0.4, 0.5, -0.1)]
    got = {r["run_id"]: r["verdict"] for r in research.verdict(spark.createDataFrame(rows, "run_id string, baseline double, at_max_cost double, subperiods_positive double, placebo_percentile double, ci_low double")).collect()}
    assert got == {"a": "supported", "b": "falsified", "c": "inconclusive"}
    assert research.subperiods(0, 10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert {"fast": 2} not in research.perturb({"fast": 2}) and research.perturb({"fast": 10}) == [{"fast": 8}, {"fast": 12}]
    m = spark.createDataFrame([("done", "x"), ("failed", "x"), ("done", "y")], "status string, kind string")
    assert {(r["status"], r["kind"], r["n"]) for r in research.registry_counts(m).collect()} == {("done", None, 2), ("failed", None, 1), (None, "x", 2), (None, "y", 1)}


def test_oversold_groups_are_left_out(spark):
    rows = [("a", 1, "buy", "X", D(2024, 1, 1), 3.0, 10.0), ("a", 2, "sell", "X", D(2024, 1, 2), 2.0, 11.0), ("a", 3, "buy", "X", D(2024, 1, 2), 2.0, 12.0), ("a", 4, "sell", "X", D(2024, 1, 5), 2.0, 13.0),
            ("b", 5, "sell", "X", D(2024, 1, 1), 1.0, 10.0), ("b", 6, "buy", "X", D(2024, 1, 3), 5.0, 10.0)]
    tx = spark.createDataFrame(rows, "account_id string, event_id long, action string, symbol string, date date, quantity double, price double").withColumn("instrument_type", F.lit("Stock"))
    got = [(r["buy_id"], r["sell_id"], r["quantity"], r["gain"], r["holding_days"]) for r in ledger.fifo_match(tx).orderBy("sell_id", "buy_id").collect()]
    assert got == [(1, 2, 2.0, 2.0, 1), (1, 4, 1.0, 3.0, 4), (3, 4, 1.0, 1.0, 3)]
    assert [(r["event_id"], r["quantity"]) for r in ledger.open_lots(tx, ledger.fifo_match(tx)).collect()] == [(3, 1.0)]
    assert [(r["account_id"], r["short_by"]) for r in ledger.oversells(tx).collect()] == [("b", 1.0)]


def test_lists_of_words_and_links(spark):
    row = spark.range(1).select(text.normalize_text(F.lit("The Tata Holdings Group Inc, Ltd")).alias("a"), text.canonical_url(F.lit("http://x/y?ref=1&utm_name=2&_hsenc=3&gclsrc=4&id=5#z")).alias("b"),
                                text.company_query_name(F.lit("Acme Corp. Ltd")).alias("c"), text.company_query_name(F.lit("Acme Ltd. Limited")).alias("d")).first()
    assert tuple(row) == ("tata inc", "http://x/y?ref=1&id=5", "Acme", "Acme Ltd.")


def test_contracts_without_a_price(spark):
    rows = [("call", 100.0, k, 30, 0.2, 0.0, 0.0) for k in (0.0, -50.0, 100.0)]
    got = options.price_contracts(spark.createDataFrame(rows, "option_type string, spot double, strike double, days int, vol double, rate double, dividend double")).collect()
    assert [r["price"] is None for r in got] == [True, True, False] and 2.2 < got[2]["price"] < 2.4
    legs = options.template_legs(spark.createDataFrame([("S", 20.0, 50.0), ("T", 500.0, 50.0)], "symbol string, spot double, spacing double"))
    assert {r["symbol"] for r in options.valid_strategies(legs).select("symbol").distinct().collect()} == {"T"}


def test_odds_of_a_payoff(spark):
    leg = spark.createDataFrame([("s", 0, "buy", "call", 100.0, 1, 1, 100.0, 0.2, 0.0, 0.0, 365)], "strategy_id string, leg_id int, side string, option_type string, strike double, quantity int, lot_size int, spot double, vol double, rate double, dividend double, days int")
    priced = options.price_contracts(leg)
    out = options.payoff_summary(options.expiry_payoff(priced), priced).first()
    # the expected value of a fairly priced call is its price; above 1.5 times the spot the grid ends
    assert out["max_profit"] is None and abs(out["max_loss"] + 7.9656) < 1e-3 and out["breakevens"] == "107.9656"
    assert abs(out["profit_probability"] - 0.3140) < 0.003 and abs(out["expected_pnl"]) < 0.4


def test_placebo_and_sweep(spark, shaped):
    rebalances = spark.createDataFrame([(p, min(p + 40, 310)) for p in range(100, 300, 40)], "pos int, next_pos int").withColumn("date", F.lit(None).cast("date"))
    got = {(r["phase"], r["run_id"]): r for r in research.parameter_sweep(shaped, rebalances, {"lookback": [20, 60, 250], "top_n": [1, 2]}, 220, 230).collect()}
    assert len([k for k in got if k[0] == "selection"]) == 6 and len(got) == 7
    assert all((r["error"] is not None) == (r["lookback"] == 250) for (phase, _), r in got.items() if phase == "selection")
    best = max((r["sharpe"], r["run_id"]) for (phase, _), r in got.items() if phase == "selection" and r["sharpe"] is not None)
    assert got["test", next(k[1] for k in got if k[0] == "test")]["run_id"] in {r["run_id"] for r in got.values() if r["sharpe"] == best[0]}
    with pytest.raises(ValueError):
        research.parameter_sweep(shaped, rebalances, {"lookback": list(range(25)), "top_n": [1]}, 220, 230)
    with pytest.raises(ValueError):
        research.parameter_sweep(shaped, rebalances, {"lookback": [20], "top_n": [1]}, 220, 220)
    drawn = research.random_placebo(shaped.join(rebalances.select("pos"), "pos").select("pos", "symbol"), 2, trials=3)
    again = research.random_placebo(shaped.join(rebalances.select("pos"), "pos").select("pos", "symbol"), 2, trials=3)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect())) and drawn.count() == 3 * 5 * 2
    metrics = research.placebo_curves(shaped, rebalances, drawn, shaped.select("pos", "date").distinct(), 10.0).collect()
    assert {r["run_id"] for r in metrics} == {"0", "1", "2"} and all(r["final_equity"] > 0.5 for r in metrics)


def test_validation_origins(spark):
    decisions = spark.createDataFrame([(252,), (600,), (100,)], "pos int")
    got = {}
    for r in features.validation_origins(decisions).collect():
        got.setdefault(r["decision"], []).append(r["pos"])
    want = {d: list(range(max(d - 504 + 126, 126) + 40 + 21, d - 21, 21))[-6:] for d in (252, 600, 100)}
    assert got == {d: x for d, x in want.items() if x}


def test_ridge_against_direct_solution(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    rows = [(f"s{i}", D(2020, 1, 1) + dt.timedelta(days=t), t, *map(float, rnd.normal(size=2))) for t in range(300) for i in range(5)]
    f = spark.createDataFrame(rows, "symbol string, date date, pos int, a double, b double")
    y = f.select("symbol", "date", "pos", (0.3 * F.col("a") - 0.2 * F.col("b") + 0.1).alias("forward_return"))
    fit = features.ridge_windows(features.ridge_daily_stats(f, y, ("a", "b")), spark.createDataFrame([(290,)], "pos int"), ("a", "b")).first()
    used = np.array([r[3:] for r in rows if 126 <= r[2] <= 290 - 1 - 21])
    z = (used - used.mean(0)) / used.std(0)
    out = used @ [0.3, -0.2] + 0.1
    beta = np.linalg.solve(z.T @ z + 8.0 * np.eye(2), z.T @ (out - out.mean())) / used.std(0)
    assert fit["days"] == 143 and np.allclose(fit["beta"], beta) and np.isclose(fit["base"], out.mean())
    blocks = features.validation_blocks(f, y, spark.createDataFrame([(290,)], "pos int"), ("a", "b"))
    evidence = features.forecast_evidence(blocks, ("decision",)).collect()
    assert len(evidence) == 1 and evidence[0]["eligible"] and evidence[0]["confidence"] > 0.9


def test_downsample(spark):
    rows = [(i * 3, float((i * 37) % 101)) for i in range(500)]
    got = {(r["pos"], r["value"]) for r in equity.downsample_extrema(spark.createDataFrame(rows, "pos long, value double"), 20, 100).collect()}
    want = set()
    for b in range(20):
        own = [r for i, r in enumerate(rows) if i * 20 // 500 == b]
        want |= {min(own, key=lambda r: (r[1], r[0])), min(own, key=lambda r: (-r[1], r[0]))}
    assert got == want


def test_entity_match_lengths(spark):
    docs = spark.createDataFrame([(1, "Alpha Beta Gamma went to Delta"), (2, "alpha"), (3, ""), (4, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("alpha beta", "AB"), ("beta gamma", "BG"), ("delta", "D"), ("alpha", "A")], "alias string, symbol string")
    assert {r["doc_id"]: r["symbols"] for r in news.entity_match(docs, aliases).collect()} == {1: "AB,D", 2: "A"}
    assert news.entity_match(docs, aliases.limit(0)).count() == 0


def test_inverse_volatility(spark, shaped):
    chosen = shaped.where("pos = 200 and symbol <> 'BBB'").select("pos", "symbol")
    got = {r["symbol"]: r["weight"] for r in signals.inverse_vol_target(chosen, features.daily_returns(shaped), 0.1, 0.8, 26).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["AAA"] > got["CCC"]
