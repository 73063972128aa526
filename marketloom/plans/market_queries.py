"""Queries over price panels: preparation, features, signals, equity, research. Doubles are rounded on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import equity, features, panel, research, signals
from ..sources.lake import settled
from . import domain
from .registry import Registry

R = Registry()
S = domain.sql
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense(domain.prices_w(spark, sf_dir))


P = "p as (select *, (dense_rank() over (order by date) - 1)::int as pos from prices_w)"
RET = P + ", r as (select *, close / nullif(lag(close) over (partition by symbol order by pos), 0) - 1 as r from p)"
GRID = """cal as (select date, (row_number() over (order by date) - 1)::int as pos from (select distinct date from prices_d)),
g as (select s.symbol, c.date, c.pos, p.close from cal c cross join (select distinct symbol from prices_d) s left join prices_d p on p.symbol = s.symbol and p.date = c.date)"""
FILL = GRID + """, f as (select symbol, date, pos, last_value(close ignore nulls) over w as close, close is null and last_value(close ignore nulls) over w is not null as filled from g
  window w as (partition by symbol order by pos rows between 5 preceding and current row)),
c as (select symbol, min(case when close is not null then pos end) as first_pos, max(case when close is not null then pos end) as last_pos, count(close) as n from f group by 1)"""


@R.query(S("select symbol, count(*) as cells, count(close) as present, min(pos) as p0, max(pos) as p1 from g group by 1", "prices_d", more=GRID))
def b1_align_calendar(spark, sf_dir):
    return panel.align_calendar(domain.prices_d(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("cells"), F.count("close").alias("present"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))


@R.query(S("select symbol, date, pos, close, filled from f", "prices_d", more=FILL))
def b2_ffill_limited(spark, sf_dir):
    return panel.ffill_limited(panel.align_calendar(domain.prices_d(spark, sf_dir)))


@R.query(S("""select symbol, case when n = 0 or last_pos - first_pos + 1 > n then 'excluded' else 'kept' end as status,
  case when n = 0 then 'no data in range' when last_pos - first_pos + 1 > n then 'interior gap longer than the fill limit' end as reason, first_pos, last_pos, n from c""", "prices_d", more=FILL))
def b3_classify_gaps(spark, sf_dir):
    return panel.classify_gaps(panel.ffill_limited(panel.align_calendar(domain.prices_d(spark, sf_dir))))


@R.query(S("""select symbol, case when fp > p0 then fd end as eligible_from, case when lp < p1 then ld end as eligible_through from
  (select symbol, min(pos) filter (close is not null) as fp, max(pos) filter (close is not null) as lp, min(date) filter (close is not null) as fd, max(date) filter (close is not null) as ld, min(pos) as p0, max(pos) as p1 from g group by 1) where fp is not null""", "prices_d", more=GRID))
def b4_eligibility(spark, sf_dir):
    return panel.eligibility(panel.align_calendar(domain.prices_d(spark, sf_dir)))


@R.query(S("""select symbol, date, pos, case when e.pos < lo or e.pos > hi then null else close end as close, coalesce(e.pos < lo or e.pos > hi, true) as is_placeholder from
  (select *, min(case when close is not null then pos end) over (partition by symbol) as lo, max(case when close is not null then pos end) over (partition by symbol) as hi from g) e""", "prices_d", more=GRID))
def b5_listed_only(spark, sf_dir):
    return panel.listed_only(panel.fill_edges(panel.align_calendar(domain.prices_d(spark, sf_dir))))


@R.query(S("""select count(distinct date) as n_dates, count(distinct symbol) as n_symbols, min(date) as first_date, max(date) as last_date, count(*) filter (close is null) as missing_cells,
  count(*) filter (close <= 0) as nonpositive, count(*) filter (abs(r) > 0.25) as large_moves from (select *, close / lag(close) over (partition by symbol order by pos) - 1 as r from g)""", "prices_d", more=GRID))
def b6_validate_prices(spark, sf_dir):
    return panel.validate_prices(panel.align_calendar(domain.prices_d(spark, sf_dir)))


@R.query(S("""select u.symbol, case when coalesce(n, 0) = 0 then 'missing' else 'loaded' end as status, first_date, last_date, coalesce(n, 0) as n, date_diff('day', last_date, date '2000-01-01') as age_days
  from (select distinct symbol from universe) u left join (select symbol, min(date) as first_date, max(date) as last_date, count(close) as n from prices_d group by 1) c using (symbol)""", "prices_d", "universe"))
def b7_load_report(spark, sf_dir):
    return panel.load_report(domain.prices_d(spark, sf_dir), domain.universe(spark, sf_dir), "2000-01-01")


@R.query(S("select bit_xor(('0x' || left(md5(symbol || '|' || date::date || '|' || floor(close * 10000 + 0.37)::bigint), 15))::bigint) as hash, count(*) as n, round(sum(close), 2) as total from prices_d", "prices_d"))
def b8_panel_fingerprint(spark, sf_dir):
    return panel.fingerprint(domain.prices_d(spark, sf_dir))


@R.query(S("select symbol, round(volatility, 6) as volatility from (select symbol, stddev_samp(r) as volatility from (select *, row_number() over (partition by symbol order by pos desc) as k from r where r is not null) where k <= 126 group by 1) order by volatility desc, symbol limit 10", "prices_w", more=RET))
def b9_top_by_volatility(spark, sf_dir):
    return rounded(panel.top_by_volatility(weekly(spark, sf_dir), 10))


@R.query(S("select symbol, date, pos, close, round(r, 9) as r from r", "prices_w", more=RET))
def c1_daily_returns(spark, sf_dir):
    return rounded(features.daily_returns(weekly(spark, sf_dir)), 9)


def _raw_sql(name: str) -> str:
    kind, w = name.split("_")[0], int(name.split("_")[1][:-1])
    win = f"partition by symbol order by pos rows between {w - 1} preceding and current row"
    if kind == "momentum":
        return f"close / nullif(lag(close, {w}) over (partition by symbol order by pos), 0) - 1"
    if kind == "volatility":
        return f"case when count(r) over ({win}) = {w} then stddev_samp(r) over ({win}) end * sqrt(252.0)"
    agg = "avg" if kind == "trend" else "max"
    return f"case when count(close) over ({win}) = {w} then close / nullif({agg}(close) over ({win}), 0) - 1 end"


NOW = RET + ", now as (select symbol, date, pos, " + ", ".join(f"{_raw_sql(n)} as {n}" for n in features.FEATURES) + " from r)"
RAW = NOW + ", raw as (select symbol, date, pos, " + ", ".join(f"lag({n}) over (partition by symbol order by pos) as {n}" for n in features.FEATURES) + " from now)"
Z = RAW + ", z as (select symbol, date, pos, " + ", ".join(f"({n} - avg({n}) over (partition by date)) / nullif(stddev_pop({n}) over (partition by date), 0) as {n}" for n in features.FEATURES) + " from raw)"
PANEL = Z + ", fp as (select symbol, date, pos, " + ", ".join(f"coalesce({n}, 0.0) as {n}" for n in features.FEATURES) + f" from z where coalesce({', '.join(features.FEATURES)}) is not null)"
TARGET = ", y as (select symbol, date, pos, lead(close, 21) over (partition by symbol order by pos) / nullif(close, 0) - 1 as forward_return from p)"


def _some(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _pick(*names: str):
    def run(spark, sf_dir):
        return rounded(features.raw_features(weekly(spark, sf_dir)).select("symbol", "date", "pos", *names))

    return run


@R.query(S(f"select symbol, date, pos, {_some('momentum_21d', 'momentum_63d', 'momentum_126d')} from raw", "prices_w", more=RAW))
def c2_momentum(spark, sf_dir):
    return _pick("momentum_21d", "momentum_63d", "momentum_126d")(spark, sf_dir)


@R.query(S(f"select symbol, date, pos, {_some('volatility_21d', 'volatility_63d', 'volatility_126d')} from raw", "prices_w", more=RAW))
def c3_volatility(spark, sf_dir):
    return _pick("volatility_21d", "volatility_63d", "volatility_126d")(spark, sf_dir)


@R.query(S(f"select symbol, date, pos, {_some('trend_21d', 'trend_63d', 'trend_126d')} from raw", "prices_w", more=RAW))
def c4_trend(spark, sf_dir):
    return _pick("trend_21d", "trend_63d", "trend_126d")(spark, sf_dir)


@R.query(S(f"select symbol, date, pos, {_some('drawdown_126d')} from raw", "prices_w", more=RAW))
def c5_drawdown(spark, sf_dir):
    return _pick("drawdown_126d")(spark, sf_dir)


@R.query(S("select symbol, date, pos, round((close - avg(close) over (partition by date)) / nullif(stddev_pop(close) over (partition by date), 0), 6) as close from p", "prices_w", more=P))
def c6_xs_zscore(spark, sf_dir):
    return rounded(features.xs_zscore(weekly(spark, sf_dir), ("close",)))


@R.query(S(f"select symbol, date, pos, {', '.join(f'round({n}, 5) as {n}' for n in features.FEATURES)} from fp", "prices_w", more=PANEL))
def c7_feature_panel(spark, sf_dir):
    return rounded(features.feature_panel(weekly(spark, sf_dir)), 5)


@R.query(S("select symbol, date, pos, round(forward_return, 6) as forward_return from y", "prices_w", more=P + TARGET))
def c8_forward_return(spark, sf_dir):
    return rounded(features.forward_return(weekly(spark, sf_dir)))


TWO = ("momentum_21d", "trend_21d")


@R.query(S("""select date, pos, count(*) as n, round(sum(forward_return), 5) as s_y, round(sum(momentum_21d), 5) as s_0, round(sum(trend_21d), 5) as s_1, round(sum(momentum_21d * forward_return), 5) as xy_0, round(sum(trend_21d * forward_return), 5) as xy_1,
  round(sum(momentum_21d * momentum_21d), 5) as xx_0_0, round(sum(momentum_21d * trend_21d), 5) as xx_0_1, round(sum(trend_21d * trend_21d), 5) as xx_1_1 from fp join (select symbol, date, forward_return from y) y using (symbol, date) where forward_return is not null group by 1, 2""", "prices_w", more=PANEL + TARGET))
def c9_ridge_daily_stats(spark, sf_dir):
    w = weekly(spark, sf_dir)
    return rounded(features.ridge_daily_stats(features.feature_panel(w), features.forward_return(w), TWO).withColumn("s_0", F.col("s_0") + 0.0).withColumn("s_1", F.col("s_1") + 0.0), 5)


@R.query()
def c10_ridge_windows(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    f = settled(features.feature_panel(w))
    decisions = panel.calendar(w).where("pos >= 200 and pos % 21 = 0")
    fits = features.ridge_windows(features.ridge_daily_stats(f, features.forward_return(w)), decisions)
    return rounded(features.ridge_scores(f, fits))


@R.query(S("""select d.pos, count(*)::bigint as days, round(sum(s.n), 5) as n, round(sum(s_y), 5) as s_y, round(sum(s_0), 5) as s_0, round(sum(xy_1), 5) as xy_1, round(sum(xx_0_1), 5) as xx_0_1 from
  (select distinct pos from p where pos >= 150 and pos % 7 = 0) d join (select pos, count(*)::double as n, sum(forward_return) as s_y, sum(momentum_21d) as s_0, sum(trend_21d * forward_return) as xy_1, sum(momentum_21d * trend_21d) as xx_0_1
  from fp join (select symbol, date, forward_return from y) y using (symbol, date) where forward_return is not null group by 1) s on s.pos between greatest(126, d.pos - 504) and d.pos - 22 group by 1""", "prices_w", more=PANEL + TARGET))
def c10_ridge_sums(spark, sf_dir):
    """What each fit is made of: the sums over the days that it may use."""
    w = settled(weekly(spark, sf_dir))
    stats = features.ridge_daily_stats(features.feature_panel(w), features.forward_return(w), TWO)
    sums = features.window_sums(stats, features.ridge_spans(panel.calendar(w).where("pos >= 150 and pos % 7 = 0")), ["n", "s_y", "s_0", "xy_1", "xx_0_1"])
    return rounded(sums.select(F.col("decision").cast("int").alias("pos"), F.round("sums.days").cast("long").alias("days"), *[(F.col("sums")[c] + 0.0).alias(c) for c in ("n", "s_y", "s_0", "xy_1", "xx_0_1")]), 5)


COV = RET + """, d as (select distinct pos as decision from p where pos >= 21 and pos % 21 = 0), w as (select decision, symbol, pos, coalesce(r, 0.0) as r from r, d where pos < decision and pos >= decision - 252),
cv as (select a.decision, a.symbol as i, b.symbol as j, covar_samp(a.r, b.r) as s, count(*) as n from w a join w b on a.decision = b.decision and a.pos = b.pos and a.symbol <= b.symbol group by 1, 2, 3)"""


def _monthly_decisions(w: DataFrame) -> DataFrame:
    return panel.calendar(w).where("pos >= 21 and pos % 21 = 0")


@R.query(S("select decision, i, j, round(case when n < 20 then case when i = j then 0.04 else 0.0 end else s * 252 * (case when i = j then 1.0 else 0.75 end) + (case when i = j then 1e-6 else 0.0 end) end, 6) as cov from cv", "prices_w", more=COV))
def c11_shrinkage_covariance(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    return rounded(features.shrinkage_covariance(features.daily_returns(w), _monthly_decisions(w)))


@R.query(S("""select decision::bigint as decision, symbol, round(var_pop(r) * count(*) / (any_value(days) - 1) * 252 + 1e-6, 6) as variance from w join (select decision, count(distinct pos) as days from w group by 1) using (decision) group by 1, 2""", "prices_w", more=COV))
def c12_factor_covariance(spark, sf_dir):
    """Variance of each symbol under the factor model of each decision; common and specific parts make up the sample's own."""
    w = settled(weekly(spark, sf_dir))
    f = features.factor_covariance(features.daily_returns(w), _monthly_decisions(w))
    common = F.aggregate(F.zip_with("loadings", "factor_var", lambda l, v: l * l * v), F.lit(0.0), lambda a, x: a + x)
    return rounded(f.select("decision", "symbol", (common + F.col("specific")).alias("variance")))


@R.query(S("""select date, pos, round(market_return, 6) as market_return, round(market_volatility, 6) as market_volatility, case when n < 63 then 'insufficient-history' when market_return < -0.08 and market_volatility > 0.22 then 'risk-off'
  when market_return > 0.08 and market_volatility < 0.24 then 'risk-on' when market_volatility > 0.28 then 'high-volatility' else 'neutral' end as regime from
  (select date, pos, count(m) over w as n, exp(sum(ln(1 + m)) over w) - 1 as market_return, stddev_samp(m) over w * sqrt(252.0) as market_volatility from (select date, pos, avg(r) as m from r where r is not null group by 1, 2) window w as (order by pos rows between 63 preceding and 1 preceding))""", "prices_w", more=RET))
def c13_market_regime(spark, sf_dir):
    return rounded(features.market_regime(features.daily_returns(weekly(spark, sf_dir))))


EVIDENCE = P + """, rec as (select symbol, date, pred as prediction, act as actual, base as baseline from (select symbol, date, pos, close / lag(close, 4) over o - 1 as pred, lead(close, 4) over o / close - 1 as act, 0.001::double as base from p window o as (partition by symbol order by pos)) where pred is not null and act is not null),
rk as (select *, rank() over (partition by date order by prediction) + (count(*) over (partition by date, prediction) - 1) / 2.0 as rp, rank() over (partition by date order by actual) + (count(*) over (partition by date, actual) - 1) / 2.0 as ra from rec),
bl as (select date, sum((prediction - actual) ** 2) as e, sum((baseline - actual) ** 2) as b, count(*) as n, coalesce(corr(rp, ra), 0) as ic, count(*) filter (sign(prediction) = sign(actual)) as hits from rk group by 1),
ev as (select sqrt(sum(e) / sum(n)) as rmse, sqrt(sum(b) / sum(n)) as baseline_rmse, avg(case when e < b then 1.0 else 0.0 end) as win_rate, avg(ic) as mean_ic, sum(hits) / sum(n) as hit_rate, count(*) as blocks from bl)"""


@R.query(S("""select *, skill_ok as eligible, case when skill_ok then round(least(greatest(skill, 0.0), 1.0), 6) else 0.0 end as confidence from (select round(rmse, 6) as rmse, round(baseline_rmse, 6) as baseline_rmse, round(win_rate, 6) as win_rate, round(mean_ic, 6) as mean_ic, round(hit_rate, 6) as hit_rate, blocks,
  round(1 - rmse / baseline_rmse, 6) as skill, blocks >= 3 and 1 - rmse / baseline_rmse > 0 and win_rate > 0.5 and mean_ic > 0 as skill_ok from ev)""".replace("select *, skill_ok as eligible", "select rmse, baseline_rmse, win_rate, mean_ic, hit_rate, blocks, skill, skill_ok as eligible"), "prices_w", more=EVIDENCE))
def c15_forecast_evidence(spark, sf_dir):

    w = weekly(spark, sf_dir)
    pred, act = F.col("close") / F.lag("close", 4).over(panel.by_symbol()) - 1, F.lead("close", 4).over(panel.by_symbol()) / F.col("close") - 1
    rows = w.select("symbol", "date", "pos", pred.alias("prediction"), act.alias("actual"), F.lit(0.001).alias("baseline")).where("prediction is not null and actual is not null")
    return rounded(features.forecast_evidence(rows))


@R.query(S("select symbol, pos from (select symbol, case when min(pos) > 0 then min(pos) end as listed_pos from p group by 1), (select distinct pos from p where pos % 20 = 0) where listed_pos is null or listed_pos + 252 <= pos", "prices_w", more=P))
def c16_investable(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    listed = w.groupBy("symbol").agg(F.min("pos").alias("p")).select("symbol", F.when(F.col("p") > 0, F.col("p")).alias("listed_pos"))
    return features.investable(listed, panel.calendar(w).where("pos % 20 = 0"))


def _sma(n: int) -> str:
    w = f"partition by symbol order by pos rows between {n - 1} preceding and current row"
    return f"case when count(close) over ({w}) = {n} then avg(close) over ({w}) end"


SMA = P + f", s as (select symbol, date, pos, close, {_sma(10)} as a, {_sma(30)} as b from p)"


@R.query(S("select symbol, date, pos, round(case when a - b > 0 then a / b - 1 end, 6) as score from s", "prices_w", more=SMA))
def d1_sma_trend(spark, sf_dir):
    return rounded(signals.sma_trend(weekly(spark, sf_dir), 10, 30))


@R.query(S("""select symbol, date, pos, round(case when max(up) over (partition by symbol order by pos rows between 20 preceding and current row) = 1 and a - b > 0 then a / b - 1 end, 6) as score from
  (select *, case when a - b > 0 and lag(a - b) over (partition by symbol order by pos) <= 0 then 1 else 0 end as up from s)""", "prices_w", more=SMA))
def d2_sma_cross(spark, sf_dir):
    return rounded(signals.sma_cross(weekly(spark, sf_dir), 10, 30, 21))


@R.query("""with recursive """ + domain.SQL["prices_w"] + """, p as (select *, (dense_rank() over (order by date) - 1)::int as pos, (row_number() over (partition by symbol order by date) - 1)::int as t from prices_w),
ch as (select symbol, date, pos, t, greatest(close - lag(close) over o, 0) as g, greatest(lag(close) over o - close, 0) as l from p window o as (partition by symbol order by t)),
seed as (select symbol, 14 as t, avg(g) as up, avg(l) as down from ch where t between 1 and 14 group by 1 having count(*) = 14),
rec as (select symbol, t, up, down from seed union all select c.symbol, c.t, (r.up * 13 + c.g) / 14, (r.down * 13 + c.l) / 14 from rec r join ch c on c.symbol = r.symbol and c.t = r.t + 1),
x as (select symbol, t, case when up = 0 and down = 0 then 50.0 when down = 0 then 100.0 else 100 - 100 / (1 + up / down) end as rsi from rec)
select ch.symbol, date, pos, round(rsi, 6) as rsi, round(case when rsi < 45 then 100 - rsi end, 6) as score from ch left join x on ch.symbol = x.symbol and ch.t = x.t""")
def d3_rsi_wilder(spark, sf_dir):
    return rounded(signals.rsi_wilder(weekly(spark, sf_dir), 14, 45.0))


@R.query(S("select symbol, date, pos, round(case when m > 0 then m end, 6) as score from (select *, close / lag(close, 26) over (partition by symbol order by pos) - 1 as m from p)", "prices_w", more=P))
def d4_momentum(spark, sf_dir):
    return rounded(signals.momentum_score(weekly(spark, sf_dir), 26))


MOM = P + """, m0 as (select symbol, date, pos, close / lag(close, 26) over (partition by symbol order by pos) - 1 as m from p), m1 as (select symbol, date, pos, lag(case when m > 0 then m end) over (partition by symbol order by pos) as score from m0)"""


@R.query(S("select symbol, date, pos, round(score, 6) as score from m1", "prices_w", more=MOM))
def d5_lagged_score(spark, sf_dir):
    return rounded(signals.lagged_score(signals.momentum_score(weekly(spark, sf_dir), 26)))


def _cut(spark, sf_dir):
    w = weekly(spark, sf_dir)
    g = w.groupBy("symbol").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).crossJoin(F.broadcast(w.agg(F.max("pos").alias("top"))))
    return g.select("symbol", F.when(F.col("lo") > 0, F.col("lo")).alias("listed_pos"), F.when(F.col("hi") < F.col("top"), F.col("hi")).alias("cutoff_pos"))


@R.query(S("""select m1.symbol, date, pos, round(case when (cut is null or pos <= cut) and (listed is null or pos > listed + 30) then score end, 6) as score from m1 left join
  (select symbol, case when min(pos) > 0 then min(pos) end as listed, case when max(pos) < (select max(pos) from p) then max(pos) end as cut from p group by 1) e on m1.symbol = e.symbol""", "prices_w", more=MOM))
def d6_mask_scores(spark, sf_dir):
    scores = signals.lagged_score(signals.momentum_score(weekly(spark, sf_dir), 26))
    return rounded(signals.mask_scores(scores, _cut(spark, sf_dir), 30))


START, STEP = 60, 20
#: where a backtest ends: the last day on which as many symbols have a price as on the fullest one
ENDS = "ends as (select pos as last from (select pos, count(*) as n from p group by 1) order by n desc, pos desc limit 1)"
END = "(select last from ends)"
REB = ENDS + f""", rb as (select pos, least(pos + {STEP}, {END})::int as next_pos, date from (select distinct pos, date from p)
  where pos >= {START} and pos < {END} and (pos - {START}) % {STEP} = 0)"""


def _end(w: DataFrame) -> int:
    """The last day on which as many symbols have a price as on the fullest one."""
    fullest = w.groupBy("pos").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "pos")).alias("at")).first()["at"]
    return fullest["pos"] if fullest else START


def _rebalances(w: DataFrame) -> DataFrame:
    return signals.rebalance_dates(panel.calendar(w), START, _end(w), STEP)


def _whole(w: DataFrame) -> DataFrame:
    """Symbols with a price on every day of the backtest."""
    end = _end(w)
    return w.where(F.col("pos").between(START, end)).groupBy("symbol").count().where(F.col("count") == end - START + 1).select("symbol")


@R.query(S("select pos, date, next_pos from rb", "prices_w", more=P + ", " + REB))
def d8_rebalance_dates(spark, sf_dir):
    return _rebalances(settled(weekly(spark, sf_dir)))


# names are chosen among those with a price on every day of the backtest
FULL = f"full_ as (select symbol from p where pos between {START} and {END} group by 1 having count(*) = {END} - {START} + 1)"
TOP = MOM + ", " + REB + ", " + FULL + """, top as (select m1.pos, m1.symbol, score, row_number() over (partition by m1.pos order by score desc, m1.symbol) as k from m1 join rb on m1.pos = rb.pos join full_ using (symbol) where score is not null qualify k <= 5)"""


def _selected(w: DataFrame) -> DataFrame:
    scores = signals.lagged_score(signals.momentum_score(w, 26)).join(_whole(w), "symbol", "left_semi")
    return signals.select_top_n(scores, _rebalances(w), 5)


@R.query(S("select pos, symbol, round(score, 6) as score, k as rank from top", "prices_w", more=TOP))
def d7_select_top_n(spark, sf_dir):
    return rounded(_selected(settled(weekly(spark, sf_dir))).select("pos", "symbol", "score", "rank"))


@R.query(S("select pos, symbol, round(w, 6) as weight from (select pos, symbol, least(0.25, least(0.9, count(*) over (partition by pos) * 0.25) / count(*) over (partition by pos)) as w from top union all select pos, 'CASH', 1 - least(0.9, count(*) * 0.25) from top group by 1)", "prices_w", more=TOP))
def d10_equal_weight_target(spark, sf_dir):
    return rounded(signals.equal_weight_target(_selected(settled(weekly(spark, sf_dir))), 0.1, 0.25))


CAP = TOP + """, n1 as (select pos, symbol, score as raw, count(*) over (partition by pos) as n from top), n2 as (select *, least(0.9, n * 0.25) as total from n1),
n3 as (select *, row_number() over (partition by pos order by raw desc, symbol) - 1 as k, sum(raw) over (partition by pos order by raw desc, symbol rows between current row and unbounded following) as tail from n2),
n4 as (select *, (total - k * 0.25) * raw <= 0.25 * tail * (1 + 1e-12) as fits from n3), n5 as (select *, min(case when fits then k end) over (partition by pos) as pk from n4),
n6 as (select *, max(case when k = pk then tail end) over (partition by pos) as pt from n5)"""


@R.query(S("select pos, symbol, round(case when pk is null or k < pk then least(0.25, total) else least(0.25, greatest(total - pk * 0.25, 0) * raw / pt) end, 6) as weight from n6", "prices_w", more=CAP))
def d9_capped_weights(spark, sf_dir):
    chosen = _selected(settled(weekly(spark, sf_dir))).withColumnRenamed("score", "raw")
    from pyspark.sql import Window

    chosen = chosen.withColumn("n", F.count("*").over(Window.partitionBy("pos")))
    return rounded(signals.capped_weights(chosen, F.least(F.lit(0.9), F.col("n") * 0.25), F.lit(0.25)))


INVERSE = CAP.replace("n1 as (select pos, symbol, score as raw, count(*) over (partition by pos) as n from top)", """rr as (select *, close / nullif(lag(close) over (partition by symbol order by pos), 0) - 1 as r from p),
sv as (select symbol, pos, stddev_samp(r) over (partition by symbol order by pos rows between 26 preceding and 1 preceding) as sd from rr),
n1 as (select pos, symbol, case when sd > 0 then 1 / sd else 0.0 end as raw, count(*) over (partition by pos) as n from top join sv using (symbol, pos))""")


@R.query(S("""select pos, symbol, round(weight, 6) as weight from (select pos, symbol, weight from iw union all select pos, 'CASH', 1 - sum(weight) from iw group by 1)""", "prices_w",
           more=INVERSE + ", iw as (select pos, symbol, case when pk is null or k < pk then least(0.25, total) else least(0.25, greatest(total - pk * 0.25, 0) * raw / pt) end as weight from n6)"))
def d10_inverse_vol_target(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    return rounded(signals.inverse_vol_target(_selected(w), features.daily_returns(w), 0.1, 0.25, 26))


BPS = 10.0
RUNS = TOP + """, tg as (select 'equal' as run_id, pos, symbol, w as weight from (select pos, symbol, 0.9 / count(*) over (partition by pos) as w from top union all select pos, 'CASH', 0.1 from top group by 1)),
v as (select t.run_id, t.pos, d.pos as day_pos, t.symbol, t.weight * d.close / s.close as value from tg t join rb on t.pos = rb.pos join p s on s.symbol = t.symbol and s.pos = t.pos join p d on d.symbol = t.symbol and d.pos > t.pos and d.pos <= rb.next_pos
  union all select t.run_id, t.pos, unnest(range(t.pos + 1, rb.next_pos + 1)), t.symbol, t.weight from tg t join rb on t.pos = rb.pos where t.symbol = 'CASH'),
gr as (select run_id, pos, day_pos, sum(value) as growth from v group by 1, 2, 3), h as (select *, value / sum(value) over (partition by run_id, pos, day_pos) as weight from v),
old as (select h.run_id, rb.next_pos as pos, symbol, h.weight as old from h join rb on h.pos = rb.pos and h.day_pos = rb.next_pos where rb.next_pos in (select pos from tg) union all select run_id, min(pos), 'CASH', 1.0 from tg group by 1),
ch as (select run_id, pos, symbol, coalesce(t.weight, 0) as weight, coalesce(o.old, 0) as old from tg t full join old o using (run_id, pos, symbol))"""


def _run(spark, sf_dir):
    """Targets, rebalances, values, growth, drifted holdings and changes of an equal-weight run."""
    w = settled(weekly(spark, sf_dir))
    rebalances = _rebalances(w)
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("pos"))
    targets = signals.with_cash(_selected(w).select("pos", "symbol", (F.lit(0.9) / n).alias("weight"))).withColumn("run_id", F.lit("equal"))
    # what several steps read is computed once
    targets, rebalances = settled(targets), settled(rebalances)
    values = settled(equity.interval_values(targets, w, rebalances))
    held = equity.drifted_holdings(values)
    return w, rebalances, targets, values, equity.interval_growth(values), held, settled(equity.changes(targets, held, rebalances))


@R.query(S("select run_id, pos, day_pos::int as day_pos, round(growth, 6) as growth from gr", "prices_w", more=RUNS))
def e1_interval_growth(spark, sf_dir):
    return rounded(_run(spark, sf_dir)[4])


@R.query(S("select run_id, pos, day_pos::int as day_pos, symbol, round(weight, 6) as weight from h", "prices_w", more=RUNS))
def e2_drifted_holdings(spark, sf_dir):
    return rounded(_run(spark, sf_dir)[5])


# the cost is the fixed point of c = f * sum |w * (1 - c) - old|; iterated until it stands
COSTS = RUNS + """, it as (select c.run_id, c.pos, 0 as k, 0.0::double as cost from (select distinct run_id, pos from ch) c union all
  select a.run_id, a.pos, a.k + 1, (select 0.001 * sum(abs(weight * (1 - a.cost) - old)) from ch where ch.run_id = a.run_id and ch.pos = a.pos and symbol <> 'CASH') from it a where a.k < 12), co as (select run_id, pos, cost from it where k = 12)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@R.query(_recursive(S("select run_id, pos, round(cost, 9) as cost from co", "prices_w", more=COSTS)))
def e3_self_financing_cost(spark, sf_dir):
    return rounded(equity.self_financing_cost(_run(spark, sf_dir)[6], BPS), 9)


@R.query(S("select run_id, pos, round(sum(abs(weight - old)) / 2, 6) as turnover, round(sum(case when symbol <> 'CASH' then abs(weight - old) else 0 end), 6) as asset_turnover from ch group by 1, 2", "prices_w", more=RUNS))
def e4_turnover(spark, sf_dir):
    return rounded(equity.turnover(_run(spark, sf_dir)[6]))


CURVE = COSTS + """, en as (select gr.run_id, gr.pos, ln(growth) + ln(1 - cost) as net, ln(growth) as gross from gr join rb on gr.pos = rb.pos and day_pos = next_pos join co on gr.run_id = co.run_id and gr.pos = co.pos),
ba as (select run_id, pos, coalesce(sum(net) over w, 0) as net0, coalesce(sum(gross) over w, 0) as gross0 from en window w as (partition by run_id order by pos rows between unbounded preceding and 1 preceding)),
cu0 as (select gr.run_id, gr.pos, day_pos::int as day_pos, exp(net0) * (1 - cost) * growth as equity, exp(gross0) * growth as gross_equity from gr join co using (run_id, pos) join ba using (run_id, pos)),
cu as (select *, equity / coalesce(lag(equity) over (partition by run_id order by day_pos), 1) - 1 as ret from cu0)"""


def _curve(spark, sf_dir):
    w, rebalances, targets, values, growth, held, changed = _run(spark, sf_dir)
    costs = settled(equity.self_financing_cost(changed, BPS))
    return w, rebalances, targets, held, changed, costs, settled(equity.equity_curve(growth, costs, rebalances))


@R.query(_recursive(S('select run_id, pos, day_pos, round(equity, 6) as equity, round(gross_equity, 6) as gross_equity, round(ret, 6) as "return" from cu', "prices_w", more=CURVE)))
def e6_equity_curve(spark, sf_dir):
    return rounded(_curve(spark, sf_dir)[6])


LOG = CURVE + """, tu as (select run_id, pos, sum(abs(weight - old)) / 2 as turnover from ch group by 1, 2), nm as (select run_id, pos, string_agg(symbol, ',' order by symbol) as selected, count(*) as positions from tg where symbol <> 'CASH' and weight > 0 group by 1, 2),
iv as (select run_id, pos, arg_max(equity, day_pos) as e1 from cu group by 1, 2), lg as (select iv.*, coalesce(lag(e1) over (partition by run_id order by pos), 1) as e0 from iv)"""


@R.query(_recursive(S("select run_id, pos, pos - 1 as information_through, selected, coalesce(positions, 0) as positions, round(turnover, 6) as turnover, round(cost, 6) as cost, round(e0 * cost, 6) as cost_value, round(e1 / e0 - 1, 6) as period_return from lg join tu using (run_id, pos) join co using (run_id, pos) left join nm using (run_id, pos)", "prices_w", more=LOG)))
def e7_rebalance_log(spark, sf_dir):
    w, rebalances, targets, held, changed, costs, curve = _curve(spark, sf_dir)
    return rounded(equity.rebalance_log(targets, equity.turnover(changed), costs, curve))


@R.query(_recursive(S("""select run_id, round(pow(final, 365.25 / days) - 1, 6) as cagr, round(sd * sqrt(252.0), 6) as volatility, round(mean * 252 / (sd * sqrt(252.0)), 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(average_turnover, 6) as average_turnover, round(gross - final, 6) as cost_drag, round(fees, 6) as fees, round(final, 6) as final_equity from
  (select run_id, arg_max(equity, day_pos) as final, arg_max(gross_equity, day_pos) as gross, stddev_samp(ret) as sd, avg(ret) as mean, min(fall) as max_drawdown, date_diff('day', min(date), max(date)) as days from
    (select cu.*, dd.date, equity / greatest(max(equity) over (partition by run_id order by day_pos), 1) - 1 as fall from cu join (select distinct pos as day_pos, date from p) dd using (day_pos)) group by 1)
  join (select run_id, avg(turnover) as average_turnover, sum(e0 * cost) as fees from lg join tu using (run_id, pos) join co using (run_id, pos) group by 1) using (run_id)""", "prices_w", more=LOG)))
def e8_performance_metrics(spark, sf_dir):
    w, rebalances, targets, held, changed, costs, curve = _curve(spark, sf_dir)
    log = equity.rebalance_log(targets, equity.turnover(changed), costs, curve)
    return rounded(equity.performance_metrics(curve, log, panel.calendar(w)))


COMPARED = LOG.replace("tg as (", "tg1 as (", 1).replace("v as (select t.run_id", f"""tg as (select * from tg1 union all select 'late', pos, symbol, 0.9 / count(*) over (partition by pos) from top where k <= 3 and pos >= {START + 2 * STEP} union all select distinct 'late', pos, 'CASH', 0.1 from top where pos >= {START + 2 * STEP}),
v as (select t.run_id""", 1) + """, sd as (select day_pos from cu group by 1 having count(distinct run_id) = 2), se as (select min(day_pos) as a, max(day_pos) as b from sd),
cc as (select run_id, day_pos, equity / first_value(equity) over w as equity, gross_equity / first_value(gross_equity) over w as gross_equity, equity / lag(equity) over w - 1 as ret, first_value(equity) over w as base from cu join sd using (day_pos) window w as (partition by run_id order by day_pos))"""


@R.query(_recursive(S("""select run_id, round(pow(final, 365.25 / days) - 1, 6) as cagr, round(sd * sqrt(252.0), 6) as volatility, round(mean * 252 / (sd * sqrt(252.0)), 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(average_turnover, 6) as average_turnover, round(gross - final, 6) as cost_drag, round(fees, 6) as fees, round(final, 6) as final_equity, first_pos, last_pos from
  (select run_id, arg_max(equity, day_pos) as final, arg_max(gross_equity, day_pos) as gross, stddev_samp(ret) as sd, avg(ret) as mean, min(fall) as max_drawdown, date_diff('day', min(date), max(date)) as days, min(day_pos) as first_pos, max(day_pos) as last_pos, any_value(base) as base from
    (select cc.*, dd.date, equity / greatest(max(equity) over (partition by run_id order by day_pos), 1) - 1 as fall from cc join (select distinct pos as day_pos, date from p) dd using (day_pos)) group by 1)
  join (select run_id, avg(turnover) as average_turnover, sum(e0 * cost / bs.base) as fees from lg join tu using (run_id, pos) join co using (run_id, pos) join (select run_id, any_value(base) as base from cc group by 1) bs using (run_id), se where pos >= a and pos < b group by 1) using (run_id)""", "prices_w", more=COMPARED)))
def e10_strategy_comparison(spark, sf_dir):
    """Five names from the start on and three names that begin later, on the days that both have."""
    w = settled(weekly(spark, sf_dir))
    chosen, weight = settled(_selected(w)), F.lit(0.9) / F.count("*").over(Window.partitionBy("pos"))
    runs = [("equal", chosen), ("late", chosen.where((F.col("rank") <= 3) & (F.col("pos") >= START + 2 * STEP)))]
    targets = reduce(DataFrame.unionByName, [signals.with_cash(rows.select("pos", "symbol", weight.alias("weight"))).withColumn("run_id", F.lit(name)) for name, rows in runs])
    return rounded(research.strategy_comparison(targets, w, settled(_rebalances(w)), panel.calendar(w), BPS))


@R.query(S(f"select date, pos, round(avg(close / p0), 6) as benchmark from p join (select symbol, close as p0 from p where pos = {START}) using (symbol) where pos between {START} and {END} group by 1, 2", "prices_w", more=P + ", " + ENDS))
def e9_equal_weight_benchmark(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    return rounded(equity.equal_weight_benchmark(w, START, _end(w)))


@R.query(_recursive(S("select run_id, day_pos, round(equity / greatest(max(equity) over (partition by run_id order by day_pos), 1) - 1, 6) as drawdown from cu", "prices_w", more=CURVE)))
def e11_drawdown_series(spark, sf_dir):
    return rounded(equity.drawdown_series(_curve(spark, sf_dir)[6]))


@R.query(_recursive(S("""select run_id, symbol, round(sum(w * move * g), 6) as contribution from
  (select h.run_id, h.symbol, h.day_pos, coalesce(lag(h.weight) over (partition by h.run_id, h.pos, h.symbol order by h.day_pos), tg.weight) as w from h join tg on h.run_id = tg.run_id and h.pos = tg.pos and h.symbol = tg.symbol where h.symbol <> 'CASH') a
  join (select symbol, pos as day_pos, close / lag(close) over (partition by symbol order by pos) - 1 as move from p) using (symbol, day_pos)
  join (select run_id, day_pos, coalesce(lag(gross_equity) over (partition by run_id order by day_pos), 1) as g from cu) using (run_id, day_pos) group by 1, 2""", "prices_w", more=CURVE)))
def e12_return_contributions(spark, sf_dir):
    w, rebalances, targets, held, changed, costs, curve = _curve(spark, sf_dir)
    return rounded(equity.return_contributions(held, targets, w, curve))


@R.query(S("""select run_id, pos, round(sum(w * w), 6) as hhi, round(sum(w) filter (k <= 3), 6) as top_3, round(sum(w) filter (k <= 5), 6) as top_5 from
  (select run_id, pos, weight / sum(weight) over (partition by run_id, pos) as w, row_number() over (partition by run_id, pos order by weight desc, symbol) as k from tg where symbol <> 'CASH' and weight > 0) group by 1, 2""", "prices_w", more=RUNS))
def e13_concentration(spark, sf_dir):
    return rounded(equity.concentration(_run(spark, sf_dir)[2]))


@R.query("""select pos, value from (select unnest([lo, hi]) as pos from (select arg_min(pos, row(value, pos)) as lo, arg_min(pos, row(-value, pos)) as hi from (select event_id as pos, value, case when count(*) over () > 2000 then (row_number() over (order by event_id) - 1) * 1000 // count(*) over () else row_number() over (order by event_id) - 1 end as b from events) group by b)) join (select event_id as pos, value from events) using (pos) group by 1, 2""")
def e14_downsample_extrema(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value")
    return equity.downsample_extrema(e)


@R.query(_recursive(S("select run_id, day_pos, round(equity / lag(equity, 63) over (partition by run_id order by day_pos) - 1, 6) as rolling_return from cu", "prices_w", more=CURVE)))
def e15_rolling_return(spark, sf_dir):
    return rounded(equity.rolling_return(_curve(spark, sf_dir)[6]))


LAST = P + ", k as (select symbol, " + ", ".join(f"max(case when b = {w} then close end) as p{w}" for w in (0, *research.WINDOWS)) + " from (select *, row_number() over (partition by symbol order by date desc) - 1 as b from p) group by 1)"


@R.query(S("select symbol, round(p0, 6) as last, " + ", ".join(f"round(p0 / p{w} - 1, 6) as return_{w}d" for w in research.WINDOWS) + " from k", "prices_w", more=LAST))
def k1_trailing_returns(spark, sf_dir):
    return rounded(research.trailing_returns(weekly(spark, sf_dir)))


SUMMARY = RET + """, mk as (select *, case when r is not null then avg(r) over (partition by date) end as m, close / max(close) over (partition by symbol order by pos) - 1 as fall from r),
sm as (select symbol, arg_max(close, date) as latest, arg_min(close, date) as first, stddev_samp(r) * sqrt(252.0) as volatility, avg(r) as mean, min(fall) as max_drawdown, covar_samp(r, m) / var_samp(case when r is not null then m end) as beta from mk group by 1)"""


@R.query(S("select symbol, round(latest, 6) as latest, round(latest / first - 1, 6) as total_return, round(volatility, 6) as volatility, round(mean * 252 / volatility, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(beta, 6) as beta from sm", "prices_w", more=SUMMARY))
def k2_symbol_summary(spark, sf_dir):
    return rounded(research.symbol_summary(weekly(spark, sf_dir)))


STATE = P + f", ts as (select * from (select symbol, close, {_sma(50)} as a, {_sma(200)} as b, row_number() over (partition by symbol order by pos desc) as n from p) where n = 1)"


@R.query(S("""select symbol, close, round(a, 8) as sma_short, round(b, 8) as sma_long, case when b is not null then case when close >= b then 'above long average' else 'below long average' end
  when a is not null then case when close >= a then 'above short average' else 'below short average' end else 'unknown' end as trend from ts""", "prices_w", more=STATE))
def k3_trend_state(spark, sf_dir):
    s = research.trend_state(weekly(spark, sf_dir))
    return s.withColumn("sma_short", F.round("sma_short", 8)).withColumn("sma_long", F.round("sma_long", 8))


PEERS = ", pe as (select a.symbol, b.symbol as peer, row_number() over (partition by a.symbol order by b.symbol) as n from k a join k b on a.symbol <> b.symbol qualify n <= 5), pt as (select pe.symbol, quantile_cont(p0 / p126 - 1, 0.5) as peer_median, arg_max(peer, row(p0 / p126 - 1, peer)) as best_peer from pe join k on pe.peer = k.symbol group by 1)"


@R.query(S("select symbol, round(peer_median, 6) as peer_median, best_peer from pt", "prices_w", more=LAST + PEERS))
def k4_peer_table(spark, sf_dir):
    w = weekly(spark, sf_dir)
    return rounded(research.peer_table(w, research.default_peers(w)))


def _scaled(x: str, lo: float, hi: float) -> str:
    return f"coalesce(greatest(0.0, least(1.0, (({x}) - ({lo})) / ({hi} - ({lo})))) * 100, 50.0)"


SCORES = SUMMARY + LAST[len(P):] + PEERS + STATE[len(P):] + f""", sc as (select k.symbol, {_scaled('k.p0 / k.p126 - 1', -0.15, 0.30)} as momentum, {_scaled('coalesce(ts.close / ts.b - 1, k.p0 / k.p63 - 1)', -0.10, 0.20)} as trend,
  0.55 * (100 - {_scaled('sm.volatility', 0.10, 0.45)}) + 0.45 * {_scaled('sm.max_drawdown', -0.45, -0.08)} as risk, {_scaled('k.p0 / k.p126 - 1 - pt.peer_median', -0.15, 0.15)} as peer from k join sm using (symbol) join ts using (symbol) left join pt using (symbol))"""


@R.query(S("select symbol, round(momentum, 6) as momentum, round(trend, 6) as trend, round(risk, 6) as risk, round(peer, 6) as peer, round(0.35 * momentum + 0.25 * trend + 0.25 * risk + 0.15 * peer, 6) as overall from sc", "prices_w", more=SCORES))
def k5_research_scores(spark, sf_dir):
    w = weekly(spark, sf_dir)
    return rounded(research.research_scores(w, research.default_peers(w)))


@R.query(S("select symbol, round(quantile_cont(r, 0.1), 6) as low, round(quantile_cont(r, 0.5), 6) as middle, round(quantile_cont(r, 0.9), 6) as high, count(*) as n from (select symbol, close / lag(close, 52) over (partition by symbol order by pos) - 1 as r from p) where r is not null group by 1 having count(*) >= 20", "prices_w", more=P))
def k6_scenario_range(spark, sf_dir):
    return rounded(research.scenario_range(weekly(spark, sf_dir), 52))


@R.query(S("select trial, pos, symbol from (select trial, p.pos, symbol, row_number() over (partition by trial, p.pos order by md5('7|' || trial || '|' || p.pos || '|' || symbol), symbol) as k from p join rb on p.pos = rb.pos, (select unnest(range(20)) as trial)) where k <= 5", "prices_w", more=P + ", " + REB))
def k10_random_placebo(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    return research.random_placebo(w.join(F.broadcast(_rebalances(w).select("pos")), "pos").select("pos", "symbol"), 5)


@R.query()
def k10_placebo_metrics(spark, sf_dir):
    """The drawn names of every trial through the same cost path as any other run."""
    w = settled(weekly(spark, sf_dir))
    rebalances = settled(_rebalances(w))
    eligible = w.join(_whole(w), "symbol", "left_semi").join(rebalances.select("pos"), "pos").select("pos", "symbol")
    return rounded(research.placebo_curves(w, rebalances, research.random_placebo(eligible, 5), panel.calendar(w), BPS))


@R.query()
def k8_subperiods(spark, sf_dir):
    """Five names over four stretches of the backtest, each a backtest of its own in one job."""
    w = settled(weekly(spark, sf_dir))
    targets = signals.with_cash(_selected(w).select("pos", "symbol", (F.lit(0.9) / F.count("*").over(Window.partitionBy("pos"))).alias("weight"))).withColumn("run_id", F.lit("equal"))
    return rounded(research.subperiod_metrics(targets, w, settled(_rebalances(w)), panel.calendar(w), BPS, 4, 60))


@R.query()
def k8_perturbed_settings(spark, sf_dir):
    """A crossing rule and the settings around it."""
    w = settled(weekly(spark, sf_dir))
    own, rebalances = settled(w.join(_whole(w), "symbol", "left_semi")), settled(_rebalances(w))
    runs = settled(research.perturbed_settings(spark, "sma_cross", {"fast": 5, "slow": 20, "hold": 20}, 5))
    return rounded(runs.select("run_id", "fast", "slow", "hold", "error").join(research.backtests(research.rule_runs(own, rebalances, runs), own, rebalances, panel.calendar(w), BPS), "run_id", "left"))


# scores of all rules, each by its own windows over the whole panel
RULED = SMA + f""", {REB}, kn as (select s.symbol, rb.pos, s.a, s.b from s join (select symbol, pos, lead(pos) over (partition by symbol order by pos) as np from p) n using (symbol, pos) join rb on rb.pos = s.pos + 1),
ru as (select 'trend' as run_id, pos, symbol, case when a - b > 0 then a / b - 1 end as score from kn union all
  select 'momentum', rb.pos, m.symbol, case when m.g > 0 then m.g end from (select symbol, pos, close / lag(close, 26) over (partition by symbol order by pos) - 1 as g from p) m join rb on rb.pos = m.pos + 1 union all
  select 'cross', rb.pos, c.symbol, case when a - b > 0 and up = 1 then a / b - 1 end from (select symbol, pos, a, b, max(u) over (partition by symbol order by pos rows between 9 preceding and current row) as up from
    (select *, case when a - b > 0 and lag(a - b) over (partition by symbol order by pos) <= 0 then 1 else 0 end as u from s)) c join rb on rb.pos = c.pos + 1)"""


@R.query(S("select run_id, pos, symbol, round(score, 6) as score from ru where score is not null", "prices_w", more=RULED))
def k9_rule_scores(spark, sf_dir):
    """Three rules with windows of their own, scored at every rebalance in one job."""
    w = settled(weekly(spark, sf_dir))
    runs = research.settings_table(spark, [{"run_id": "trend", "rule": "sma_trend", "fast": 10, "slow": 30, "top_n": 5}, {"run_id": "cross", "rule": "sma_cross", "fast": 10, "slow": 30, "hold": 10, "top_n": 5}, {"run_id": "momentum", "rule": "momentum", "lookback": 26, "top_n": 5}])
    return rounded(research.rule_scores(w, _rebalances(w), settled(runs)))


@R.query()
def k9_parameter_sweep(spark, sf_dir):
    """Look-back by number of names: all runs over the first half, the best over the rest."""
    w = settled(weekly(spark, sf_dir))
    middle = START + (_end(w) - START) // 2 // STEP * STEP
    return rounded(research.parameter_sweep(w.join(_whole(w), "symbol", "left_semi"), _rebalances(w), {"lookback": [13, 26, 52], "top_n": [3, 5]}, middle, middle + STEP, BPS))


@R.query()
def k12_verdict(spark, sf_dir):
    """The run of five names by momentum under all five checks, and what they say together."""
    w = settled(weekly(spark, sf_dir))
    targets = signals.with_cash(_selected(w).select("pos", "symbol", (F.lit(0.9) / F.count("*").over(Window.partitionBy("pos"))).alias("weight"))).withColumn("run_id", F.lit("equal"))
    own = settled(w.join(_whole(w), "symbol", "left_semi"))
    evidence = settled(research.run_evidence(targets, own, settled(_rebalances(w)), panel.calendar(w), BPS, 5, least=60))
    return rounded(evidence.join(research.verdict(evidence), "run_id"))


@R.query("""select o_orderstatus as status, null as kind, count(*) as n from orders group by 1 union all select null, o_orderpriority, count(*) from orders group by 2""")
def k12_registry_counts(spark, sf_dir):
    """Orders as a registry of manifests: their states, and their priorities as kinds."""
    orders = domain.table(spark, sf_dir, "orders")
    return research.registry_counts(orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")))


def _forecasts(spark, sf_dir):
    w = settled(weekly(spark, sf_dir))
    f, y = settled(features.feature_panel(w)), features.forward_return(w)
    return w, f, y, panel.calendar(w).where("pos >= 240 and pos % 21 = 0")


@R.query()
def c14_validation_blocks(spark, sf_dir):
    w, f, y, decisions = _forecasts(spark, sf_dir)
    return rounded(features.validation_blocks(f, y, decisions))


@R.query()
def c17_forecast_outcomes(spark, sf_dir):
    w, f, y, decisions = _forecasts(spark, sf_dir)
    evidence = features.forecast_evidence(features.validation_blocks(f, y, decisions), ("decision",))
    scores = features.ridge_scores(f, features.ridge_windows(features.ridge_daily_stats(f, y), decisions))
    covariance = features.shrinkage_covariance(features.daily_returns(w), decisions)
    listed = w.groupBy("symbol").agg(F.min("pos").alias("p")).select("symbol", F.when(F.col("p") > 0, F.col("p")).alias("listed_pos"))
    return rounded(features.forecast_outcomes(scores, evidence, y, covariance, features.investable(listed, decisions), _end(w)))


@R.query()
def k11_block_bootstrap_sharpe(spark, sf_dir):
    curve = _curve(spark, sf_dir)[6]
    return rounded(research.block_bootstrap_sharpe(curve.select("run_id", (F.col("day_pos") - START - 1).alias("i"), F.col("return").alias("r"))))


CUT = RUNS + """, cf as (select symbol, min(pos) + 290 as cutoff from p where symbol < 'Brand#3' group by 1), lv as (select v.*, greatest(cutoff, pos + 1) as stop_pos, coalesce(day_pos >= greatest(cutoff, pos + 1), false) as sold from v left join cf using (symbol)),
lp as (select *, max(case when day_pos = stop_pos then value end) over (partition by run_id, pos, symbol) as proceeds from lv)"""


@R.query(S("""select run_id, pos, day_pos::int as day_pos, symbol, round(sum(value), 6) as value, round(sum(fees), 8) as fees from (select run_id, pos, day_pos, symbol, value, 0.0 as fees from lp where not sold
  union all select run_id, pos, day_pos, 'CASH', proceeds * 0.999, proceeds * 0.001 from lp where sold) group by 1, 2, 3, 4""", "prices_w", more=CUT))
def e5_liquidate_at_cutoff(spark, sf_dir):
    w, _, _, values, *_ = _run(spark, sf_dir)
    ends = w.where("symbol < 'Brand#3'").groupBy("symbol").agg((F.min("pos") + 290).alias("cutoff_pos"))
    out = equity.liquidate_at_cutoff(values, ends, BPS)
    return out.withColumn("value", F.round("value", 6)).withColumn("fees", F.round("fees", 8))


LIMITS = {"max_weight": 0.19, "min_cash": 0.1, "max_volatility": 0.9, "max_turnover": 0.5, "max_sector": 0.4}
CHECKS = COV.replace("d as (select distinct pos as decision from p where pos >= 21 and pos % 21 = 0)", f"{ENDS}, d as (select last as decision from ends)") + f""", w3 as (select symbol, 0.9 / count(*) over () as weight from p where pos = {END}), wt as (select symbol, weight from w3 union all select 'CASH', 0.1)"""


@R.query(S("""select 'x' as run_id, "check", round(value, 6) as value, lim::double as "limit", passed from (
  select 'weight sum' as "check", sum(weight) as value, 1.0 as lim, abs(sum(weight) - 1) <= 1e-6 as passed from wt union all select 'long only', min(weight), 0.0, min(weight) >= -1e-8 from w3
  union all select 'largest position', max(weight), 0.19, max(weight) <= 0.19 + 1e-6 from w3 union all select 'cash reserve', 0.1, 0.1, true
  union all select 'volatility', v, 0.9, v <= 0.9 + 1e-6 from (select sqrt(sum(a.weight * b.weight * (case when n < 20 then case when i = j then 0.04 else 0 end else s * 252 * (case when i = j then 1.0 else 0.75 end) + (case when i = j then 1e-6 else 0 end) end) * (case when i = j then 1 else 2 end))) as v
    from cv join w3 a on a.symbol = i join w3 b on b.symbol = j)
  union all select 'one-way turnover', 0.9, 0.5, false union all select 'sector exposure', max(s), 0.4, max(s) <= 0.4 + 1e-6 from (select right(symbol, 1) as k, sum(weight) as s from w3 group by 1))""", "prices_w", more=CHECKS))
def e16_limit_checks(spark, sf_dir):
    from ..operators import proposals

    w = settled(weekly(spark, sf_dir))
    end = _end(w)
    cov = features.shrinkage_covariance(features.daily_returns(w), spark.createDataFrame([(end,)], "pos int"))
    names = w.where(F.col("pos") == end).select(F.lit("x").alias("run_id"), "symbol", (F.lit(0.9) / F.count("*").over(Window.partitionBy("pos"))).alias("weight"))
    cash = spark.createDataFrame([("x", "CASH", 0.1)], "run_id string, symbol string, weight double")
    now = spark.createDataFrame([("x", "CASH", 1.0)], "run_id string, symbol string, weight double")
    sectors = w.select("symbol").distinct().withColumn("sector", F.right("symbol", F.lit(1)))
    return rounded(proposals.limit_checks(names.unionByName(cash), cov, now, sectors, LIMITS))


@R.query(_recursive(S("""select bps::int as cost_bps, round(final, 6) as final_equity from (select bps, exp(sum(ln(g) + ln(1 - c))) as final from
  (select k.bps, k.pos, k.cost as c, e.growth as g from kc k join (select gr.pos, growth from gr join rb on gr.pos = rb.pos and day_pos = next_pos) e on e.pos = k.pos) group by 1)""", "prices_w", more=RUNS + """,
kt as (select b.bps, c.pos, 0 as n, 0.0::double as cost from (select distinct pos from ch) c, (select unnest([10, 20, 30]) as bps) b union all select bps, pos, n + 1, (select bps / 10000.0 * sum(abs(weight * (1 - a.cost) - old)) from ch where ch.pos = a.pos and symbol <> 'CASH') from kt a where n < 12),
kc as (select bps, pos, cost from kt where n = 12)""")))
def k7_cost_stress(spark, sf_dir):
    """The same targets at one, two and three times the costs; growth is computed once for all."""
    w, rebalances, targets, values, growth, held, changed = _run(spark, sf_dir)
    out = None
    for times in (1, 2, 3):
        curve = equity.equity_curve(growth, equity.self_financing_cost(changed, BPS * times), rebalances)
        row = curve.groupBy(F.lit(int(BPS * times)).alias("cost_bps")).agg(F.max_by("equity", "day_pos").alias("final_equity"))
        out = row if out is None else out.unionByName(row)
    return rounded(out)
