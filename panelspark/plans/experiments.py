"""Queries over recursive indicators, turbulence, simulations, metrics, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import metrics as mt
from panelspark.operators import simulate as sim
from panelspark.operators import splits as sp
from panelspark.operators.recursive import recursive_indicators
from panelspark.operators.turbulence import turbulence as turb
from panelspark.operators.weekly import weekly_log_returns
from panelspark.plans.base import BARS, CAL, WEEKLY, bars, chain, day, num, sql_num, weekly
from panelspark.session import cut_lineage
from panelspark.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


_EMA = """, n AS (SELECT ticker, date, high, low, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS mv,
 greatest(high - low, abs(high - lag(close) OVER (PARTITION BY ticker ORDER BY date)), abs(low - lag(close) OVER (PARTITION BY ticker ORDER BY date))) AS tr FROM bars),
r AS (SELECT ticker, rn, date, close, close AS e20, close AS e12, close AS e26, CASE WHEN mv IS NULL THEN NULL ELSE greatest(mv, 0) END AS u, CASE WHEN mv IS NULL THEN NULL ELSE greatest(-mv, 0) END AS d, tr AS atr FROM n WHERE rn = 1
 UNION ALL SELECT n.ticker, n.rn, n.date, n.close,
  CASE WHEN n.close IS NULL THEN r.e20 WHEN r.e20 IS NULL THEN n.close ELSE r.e20 + 2 / 21.0::DOUBLE * (n.close - r.e20) END,
  CASE WHEN n.close IS NULL THEN r.e12 WHEN r.e12 IS NULL THEN n.close ELSE r.e12 + 2 / 13.0::DOUBLE * (n.close - r.e12) END,
  CASE WHEN n.close IS NULL THEN r.e26 WHEN r.e26 IS NULL THEN n.close ELSE r.e26 + 2 / 27.0::DOUBLE * (n.close - r.e26) END,
  CASE WHEN n.mv IS NULL THEN r.u WHEN r.u IS NULL THEN greatest(n.mv, 0) ELSE r.u + 1 / 14.0::DOUBLE * (greatest(n.mv, 0) - r.u) END,
  CASE WHEN n.mv IS NULL THEN r.d WHEN r.d IS NULL THEN greatest(-n.mv, 0) ELSE r.d + 1 / 14.0::DOUBLE * (greatest(-n.mv, 0) - r.d) END,
  CASE WHEN n.tr IS NULL THEN r.atr WHEN r.atr IS NULL THEN n.tr ELSE r.atr + 1 / 14.0::DOUBLE * (n.tr - r.atr) END
 FROM r JOIN n ON n.ticker = r.ticker AND n.rn = r.rn + 1)"""


@query("WITH RECURSIVE " + BARS + _EMA + f" SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('e20', 'ema')}, {sql_num('e12 - e26', 'macd')}, {sql_num('CASE WHEN u + d > 1e-12 THEN 100 * (u / (u + d)) END', 'rsi')}, {sql_num('atr', 'atr')}, {sql_num('CASE WHEN close > 0 THEN atr / close END', 'atr_pct')} FROM r")
def ema_macd_rsi_atr(spark, d):
    x = recursive_indicators(bars(spark, d))
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return x.select("ticker", day("date"), *[num(nan(c), c) for c in ("ema", "macd", "rsi", "atr", "atr_pct")])


_SIGNAL = """, q AS (SELECT ticker, rn, date, e12 - e26 AS m FROM r),
g AS (SELECT ticker, rn, date, m, m AS s FROM q WHERE rn = 1 UNION ALL SELECT q.ticker, q.rn, q.date, q.m, CASE WHEN q.m IS NULL THEN g.s WHEN g.s IS NULL THEN q.m ELSE g.s + 0.2::DOUBLE * (q.m - g.s) END FROM g JOIN q ON q.ticker = g.ticker AND q.rn = g.rn + 1)"""


@query("WITH RECURSIVE " + BARS + _EMA + _SIGNAL + f" SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('s', 'macd_signal')}, {sql_num('m - s', 'macd_hist')} FROM g")
def macd_signal(spark, d):
    x = recursive_indicators(bars(spark, d))
    return x.select("ticker", day("date"), *[num(F.when(~F.isnan(c), F.col(c)), c) for c in ("macd_signal", "macd_hist")])


_MOVES = """, n AS (SELECT ticker, date, row_number() OVER w AS rn, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
 greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
k AS (SELECT ticker, date, rn, tr, CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM n),
r AS (SELECT ticker, date, rn, p, m, tr AS t FROM k WHERE rn = 1
 UNION ALL SELECT k.ticker, k.date, k.rn, CASE WHEN k.p IS NULL THEN r.p WHEN r.p IS NULL THEN k.p ELSE r.p + 1 / 30.0::DOUBLE * (k.p - r.p) END,
  CASE WHEN k.m IS NULL THEN r.m WHEN r.m IS NULL THEN k.m ELSE r.m + 1 / 30.0::DOUBLE * (k.m - r.m) END, CASE WHEN k.tr IS NULL THEN r.t WHEN r.t IS NULL THEN k.tr ELSE r.t + 1 / 30.0::DOUBLE * (k.tr - r.t) END
 FROM r JOIN k ON k.ticker = r.ticker AND k.rn = r.rn + 1)"""


@query("WITH RECURSIVE " + BARS + _MOVES + f" SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('CASE WHEN p / nullif(t, 0) + m / nullif(t, 0) > 0 THEN 100 * abs(p / t - m / t) / (p / t + m / t) END', 'dx', 4)} FROM r")
def directional_index(spark, d):
    x = recursive_indicators(bars(spark, d))
    return x.select("ticker", day("date"), num(F.when(~F.isnan("dx"), F.col("dx")), "dx", 4))


@query()
def turbulence(spark, d):
    return turb(bars(spark, d)).select(day("date"), num("turbulence", "turbulence", 4))


@query()
def turbulence_older_form(spark, d):
    return turb(bars(spark, d), skip_first=2, older=True).select(day("date"), num("turbulence", "turbulence", 4))


# Weekly returns of a ticker stand as the steps of an episode.
STEPS = """
steps AS (SELECT w.ticker AS episode, w.week, CASE WHEN p.close > 0 AND w.close > 0 THEN ln(w.close / p.close) END AS lr, w.volume, w.close, w.turbulence FROM weekly w
  ASOF LEFT JOIN (SELECT ticker, ts, close FROM bars WHERE close IS NOT NULL) p ON w.ticker = p.ticker AND w.w_start >= p.ts)"""
PERF = """
cum AS (SELECT *, sum(coalesce(lr, 0)) OVER (PARTITION BY episode ORDER BY week ROWS UNBOUNDED PRECEDING) AS c FROM steps),
peak AS (SELECT *, greatest(max(c) OVER (PARTITION BY episode ORDER BY week ROWS UNBOUNDED PRECEDING), 0) AS pk FROM cum),
perf AS (SELECT episode, count(*) AS n_steps, sum(coalesce(lr, 0)) AS log_return, exp(sum(coalesce(lr, 0))) AS nav_multiple, CASE WHEN count(*) >= 2 AND stddev_pop(coalesce(lr, 0)) > 1e-15 THEN avg(coalesce(lr, 0)) / stddev_pop(coalesce(lr, 0)) * sqrt(52) ELSE 0 END AS sharpe,
  min(exp(c - pk) - 1) AS max_drawdown FROM peak GROUP BY episode)"""
_BASE = (BARS, CAL, WEEKLY, STEPS)


def steps(spark, d):
    x = weekly_log_returns(weekly(spark, d), bars(spark, d))
    return x.select(F.col("ticker").alias("episode"), "week", F.col("log_ret_1w").alias("lr"), "volume", "close", "turbulence")


def perf(spark, d):
    return mt.episode_totals(steps(spark, d), episode="episode", order="week", log_return="lr")


@query(chain(*_BASE, PERF) + f" SELECT episode, n_steps, {sql_num('log_return', 'log_return')}, {sql_num('nav_multiple', 'nav_multiple')}, {sql_num('sharpe', 'sharpe')}, {sql_num('max_drawdown', 'max_drawdown')}, {sql_num('nav_multiple * 1e6', 'final_value', 2)} FROM perf")
def episode_totals(spark, d):
    p = perf(spark, d)
    return p.select("episode", "n_steps", *[num(c, c) for c in ("log_return", "nav_multiple", "sharpe", "max_drawdown")], num("final_value", "final_value", 2))


_SUM = ", ".join(f"{sql_num(f'avg({c})', c + '_mean')}, {sql_num(f'quantile_cont({c}, 0.5)', c + '_median')}, {sql_num(f'coalesce(stddev_samp({c}), 0)', c + '_std')}, {sql_num(f'min({c})', c + '_min')}, {sql_num(f'max({c})', c + '_max')}" for c in mt.EPISODE_COLUMNS)


@query(chain(*_BASE, PERF) + f" SELECT count(*) AS n, {_SUM}, coalesce(bool_or(nav_multiple <= 0.1), false) AS any_ruin, coalesce(bool_or(nav_multiple >= 10), false) AS any_explosion FROM perf")
def episode_summary(spark, d):
    s = mt.episode_summary(perf(spark, d))
    return s.select("n", *[num(c, c) for c in s.columns if c not in ("n", "any_ruin", "any_explosion")], "any_ruin", "any_explosion")


_GEN = ", ".join([sql_num(f"avg({c}) FILTER (role = 'test') - avg({c}) FILTER (role = 'train')", f"delta_{c}") for c in mt.EPISODE_COLUMNS] + [sql_num(f"quantile_cont(nav_multiple, {p}) FILTER (role = '{r}')", f"nav_{r}_p{int(p * 100)}") for r in ("train", "test") for p in (0.1, 0.5, 0.9)])


@query(chain(*_BASE, PERF) + f", m AS (SELECT *, CASE WHEN ascii(episode) % 2 = 0 THEN 'train' ELSE 'test' END AS role FROM perf) SELECT {_GEN}, avg(nav_multiple) FILTER (role = 'test') - avg(nav_multiple) FILTER (role = 'train') < -0.05 AS nav_degrades, avg(sharpe) FILTER (role = 'test') - avg(sharpe) FILTER (role = 'train') < -0.2 AS sharpe_degrades, avg(max_drawdown) FILTER (role = 'test') - avg(max_drawdown) FILTER (role = 'train') < -0.05 AS mdd_degrades FROM m")
def generalization(spark, d):
    g = mt.generalization(perf(spark, d).withColumn("role", F.when(F.ascii("episode") % 2 == 0, "train").otherwise("test")), "role")
    flags = ("nav_degrades", "sharpe_degrades", "mdd_degrades")
    return g.select(*[num(c, c) for c in g.columns if c not in flags], *flags)


@query(chain(*_BASE) + f""", x AS (SELECT episode, CASE WHEN lr IS NOT NULL AND turbulence IS NOT NULL THEN lr END AS a, CASE WHEN lr IS NOT NULL AND turbulence IS NOT NULL THEN turbulence END AS b, CASE WHEN lr IS NOT NULL AND volume IS NOT NULL THEN lr END AS a2, CASE WHEN lr IS NOT NULL AND volume IS NOT NULL THEN volume END AS b2 FROM steps)
SELECT episode, {sql_num('CASE WHEN count(a) >= 3 AND stddev_samp(a) > 1e-12 AND stddev_samp(b) > 1e-12 THEN corr(a, b) END', 'corr_turbulence')}, {sql_num('CASE WHEN count(a2) >= 3 AND stddev_samp(a2) > 1e-12 AND stddev_samp(b2) > 1e-12 THEN corr(a2, b2) END', 'corr_volume')} FROM x GROUP BY episode""")
def risk_corr(spark, d):
    g = mt.guarded_corr(steps(spark, d), "lr", ["turbulence", "volume"], by=["episode"])
    return g.select("episode", num("corr_turbulence", "corr_turbulence"), num("corr_volume", "corr_volume"))


# Shares of traded capital of a week stand as portfolio weights; a year is an episode.
WEIGHTS = """
cap AS (SELECT week, substr(week, 1, 4) AS year, ticker, coalesce(close, 0) * coalesce(volume, 0) AS c FROM weekly),
allw AS (SELECT w.week, w.year, t.ticker FROM (SELECT DISTINCT week, year FROM cap) w CROSS JOIN (SELECT DISTINCT ticker FROM cap) t),
wt AS (SELECT a.week, a.year, a.ticker, coalesce(c.c, 0) / nullif(sum(coalesce(c.c, 0)) OVER (PARTITION BY a.week), 0) AS w FROM allw a LEFT JOIN cap c ON a.week = c.week AND a.ticker = c.ticker),
trade AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY ticker, year ORDER BY week)) AS dw FROM wt),
tw AS (SELECT week, year, sum(dw) / 2 AS turnover, sum(w * w) AS hhi, max(w) AS w_max, sum(abs(w)) AS w_l1, CAST(count(*) FILTER (w <> 0) AS INTEGER) AS w_nonzero FROM trade GROUP BY week, year)"""


def weights(spark, d):
    w = weekly(spark, d).select("week", "ticker", (F.coalesce("close", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))).alias("c"))
    # every week for every ticker: the weeks of a calendar are one array
    weeks = w.agg(F.collect_set("week")).scalar()
    grid = w.select("ticker").distinct().withColumn("weeks", weeks).select("ticker", F.explode("weeks").alias("week"))
    full = grid.join(w, ["week", "ticker"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    g = full.groupBy("week").agg(F.array_sort(F.collect_list(F.struct("ticker", "c"))).alias("a"), F.sum("c").alias("s"))
    x = g.select("week", F.substring("week", 1, 4).alias("year"), F.transform("a", lambda i: i["c"] / F.nullif(F.col("s"), F.lit(0.0))).alias("w"))
    return mt.turnover(mt.weight_scalars(x, "w"), "w", episode="year", order="week")


@query(chain(BARS, CAL, WEEKLY, WEIGHTS) + f" SELECT week, {sql_num('turnover', 'turnover')}, {sql_num('hhi', 'hhi')}, {sql_num('w_max', 'w_max')}, {sql_num('w_l1', 'w_l1', 4)}, w_nonzero FROM tw")
def turnover_hhi(spark, d):
    return weights(spark, d).select("week", num("turnover", "turnover"), num("hhi", "hhi"), num("w_max", "w_max"), num("w_l1", "w_l1", 4), "w_nonzero")


@query(chain(BARS, CAL, WEEKLY, WEIGHTS) + " SELECT " + ", ".join(f"{sql_num(f'avg({c})', c + '_mean')}, {sql_num(f'quantile_cont({c}, 0.5)', c + '_median')}, {sql_num(f'quantile_cont({c}, 0.9)', c + '_p90')}, {sql_num(f'max({c})', c + '_max')}" for c in ("turnover", "hhi")) + f", {sql_num('max(w_max)', 'max_single_weight')} FROM tw")
def trading_summary(spark, d):
    s = mt.trading_summary(weights(spark, d))
    return s.select(*[num(c, c) for c in s.columns])


_TR = ", ".join(f"{sql_num(f'arg_min({c}, date) FILTER ({c} IS NOT NULL)', c + '_first', 4)}, {sql_num(f'arg_max({c}, date) FILTER ({c} IS NOT NULL)', c + '_last', 4)}, {sql_num(f'min({c})', c + '_min', 4)}, {sql_num(f'max({c})', c + '_max', 4)}" for c in ("m_close", "m_turb"))


@query(chain(BARS) + f", t AS (SELECT date, avg(close) AS m_close, avg(turbulence) AS m_turb FROM bars GROUP BY date) SELECT {_TR}, coalesce(bool_or(m_turb > 40), false) AS kl_high FROM t")
def training_summary(spark, d):
    t = bars(spark, d).groupBy("date").agg(F.avg("close").alias("m_close"), F.avg("turbulence").alias("m_turb"))
    s = mt.training_summary(t, "date", ["m_close", "m_turb"], kl="m_turb", kl_limit=40.0)
    return s.select(*[num(c, c, 4) for c in s.columns if c != "kl_high"], "kl_high")


@query(chain(BARS) + f" SELECT {sql_num('coalesce(max(abs(log_ret)), 1)', 'log_ret')}, {sql_num('coalesce(max(abs(turbulence)), 1)', 'turbulence')} FROM bars")
def max_abs_scales(spark, d):
    return mt.max_abs(bars(spark, d), ["log_ret", "turbulence"]).select(num("log_ret", "log_ret"), num("turbulence", "turbulence"))


@query(f"""WITH r AS (SELECT c_custkey AS run_id, c_acctbal AS nav, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS cost, CAST(count(o_orderkey) AS DOUBLE) AS trades FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT run_id, coalesce(nav, 0)::DOUBLE * 1.0::DOUBLE + coalesce(trades, 0)::DOUBLE * 2.5::DOUBLE + coalesce(cost, 0)::DOUBLE * (-0.001)::DOUBLE AS score FROM r) SELECT run_id, {sql_num('score', 'score', 3)}, CAST(row_number() OVER (ORDER BY score DESC, run_id) AS INTEGER) AS rank FROM s""")
def run_ranking(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderkey").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cost"), F.count("o_orderkey").cast("double").alias("trades"))
    r = table(spark, d, "customer", "c_custkey", "c_acctbal").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").cast("double").alias("nav"), "cost", "trades")
    s = mt.score_runs(r, {"nav": 1.0, "trades": 2.5, "cost": -0.001})
    return s.select("run_id", num("score", "score", 3), "rank")


def split_sql(ratio: float, folds: int) -> str:
    return f"""WITH d AS (SELECT DISTINCT date FROM daily_panel), k AS (SELECT count(*) FILTER (date < DATE '2016-01-04') AS a, count(*) FILTER (date <= DATE '2023-12-29') - 1 AS b, count(*) FILTER (date <= DATE '2024-06-28') - 1 AS e FROM d),
t AS (SELECT *, least(greatest(1, CAST(round_even((b - a + 1) * {ratio}, 0) AS BIGINT)), b - a) AS n FROM k),
o AS (SELECT -1 AS fold, 'train' AS role, a AS f, a + n - 1 AS l, a, e, n FROM t UNION ALL SELECT -1, 'test', a + n, b, a, e, n FROM t),
fit AS (SELECT *, least({folds}, greatest(0, (n - 150) // 30)) AS k FROM t), i AS (SELECT *, CAST(unnest(range(k)) AS BIGINT) AS fold FROM fit), v AS (SELECT *, a + n - 1 - (k - fold) * 30 + 1 AS s FROM i),
p AS (SELECT fold, role, f, l, e FROM o UNION ALL SELECT fold, 'train', a, s - 1, e FROM v WHERE s - a >= 150 UNION ALL SELECT fold, 'val', s, s + 29, e FROM v WHERE s - a >= 150)
SELECT CAST(fold AS INTEGER) AS fold, role, CAST(greatest(0, f - 32) AS INTEGER) AS episode_start, CAST(least(l + 1, e) AS INTEGER) AS episode_end, CAST(f AS INTEGER) AS first_action, CAST(l AS INTEGER) AS last_action FROM p"""


@query(split_sql(0.8, 4))
def splits_folds(spark, d):
    return sp.split_plan(table(spark, d, "daily_panel", "date"), day="date", first="2016-01-04", last="2023-12-29", terminal="2024-06-28", train_ratio=0.8, n_folds=4)


def weekly_panel(spark, d):
    """Weeks in which all of the universe's assets have a price: the six part types of the
    star schema give a market without gaps."""
    p = table(spark, d, "part", "p_partkey", "p_type")
    x = table(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))
    w = x.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("week"), F.col("p_type").alias("asset")).agg(F.avg((F.col("l_extendedprice") / F.col("l_quantity")).cast("double")).alias("price"), F.avg("l_quantity").cast("double").alias("risk"))
    return sim.panel_arrays(w, period="week", entity="asset", price="price", risk="risk", exposure="risk")


def sweep(spark, d):
    grid = sp.expand_grid(spark, {"policy": ["equal_weight", "inverse_vol", "momentum", "random", "min_variance"], "seed": [0, 1], "min_cash": [0.0, 0.1]})
    return sim.simulate(weekly_panel(spark, d), grid, period="week", rules=sim.Rules(beta=0.1, gamma=0.05))


# The fold over weeks as a recursion: cash and shares of the assets in order of name.
_ROLLOUT = f"""WITH RECURSIVE x AS (SELECT date_trunc('week', l_shipdate) AS week, p_type AS asset, avg(CAST(l_extendedprice / l_quantity AS DOUBLE)) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT CAST(count(DISTINCT asset) AS BIGINT) AS n FROM x),
g AS (SELECT CAST(row_number() OVER (ORDER BY week) AS BIGINT) AS t, list(price ORDER BY asset) AS p FROM x GROUP BY week HAVING count(*) = (SELECT n FROM k)),
r AS (SELECT CAST(1 AS BIGINT) AS t, 1e6::DOUBLE AS cash, list_transform(range((SELECT n FROM k)), lambda i: 0.0::DOUBLE) AS sh, 1e6::DOUBLE AS nav, 0.0::DOUBLE AS lr, 0.0::DOUBLE AS cost
 UNION ALL SELECT t + 1, cash1 - list_sum(want) * sc * 1.0005::DOUBLE, sh2, nav2, ln(nav2 / nav), gross * 0.0005::DOUBLE + list_sum(want) * sc * 0.0005::DOUBLE FROM (
 SELECT *, cash1 - list_sum(want) * sc * 1.0005::DOUBLE + list_dot_product(sh2, p1) AS nav2 FROM (
 SELECT *, list_transform(range(1, len(p0) + 1), lambda i: (hold1[i] + want[i] * sc) / p0[i]) AS sh2 FROM (
 SELECT *, CASE WHEN list_sum(want) > 0 THEN least(1, greatest(0, cash1 - v1 / (len(p0) + 1)) / (list_sum(want) * 1.0005::DOUBLE)) ELSE 0 END AS sc FROM (
 SELECT *, list_transform(hold1, lambda h: greatest(v1 / (len(p0) + 1) - h, 0)) AS want FROM (
 SELECT *, cash1 + list_sum(hold1) AS v1 FROM (
 SELECT *, cash + list_sum(ex) * 0.9995::DOUBLE AS cash1, list_sum(ex) AS gross, list_transform(range(1, len(p0) + 1), lambda i: hold[i] - ex[i]) AS hold1 FROM (
 SELECT *, list_transform(hold, lambda h: greatest(h - v / (len(p0) + 1), 0)) AS ex FROM (
 SELECT r.*, a.p AS p0, b.p AS p1, cash + list_dot_product(sh, a.p) AS v, list_transform(range(1, len(a.p) + 1), lambda i: sh[i] * a.p[i]) AS hold FROM r JOIN g a ON a.t = r.t JOIN g b ON b.t = r.t + 1)))))))))
SELECT 'ew' AS run_id, CAST(t - 2 AS INTEGER) AS step, {sql_num('ln(nav / 1e6)', 'log_nav')}, {sql_num('lr', 'log_return')}, {sql_num('cost / nav', 'cost_share', 8)}, {sql_num('lr', 'reward')} FROM r WHERE t > 1"""


@query(_ROLLOUT)
def equal_weight_rollout(spark, d):
    runs = spark.createDataFrame([("ew", "equal_weight", 0)], "run_id string, policy string, seed int")
    s = sim.simulate(weekly_panel(spark, d), runs, period="week")
    return s.select("run_id", "step", num(F.log(F.col("nav") / 1e6), "log_nav"), num("log_return", "log_return"), num(F.col("trade_cost") / F.col("nav"), "cost_share", 8), num("reward", "reward"))


@query()
def sweep_ranked(spark, d):
    s = sweep(spark, d).withColumn("trades", F.size(F.filter("trade_shares", lambda x: x != 0)))
    p = mt.episode_totals(s, episode="run_id", order="step", log_return="log_return", trades="trades", cost="trade_cost")
    r = mt.score_runs(p, {"log_return": 1.0, "sharpe": 0.5, "max_drawdown": 1.0})
    return r.select("run_id", "n_steps", num("log_return", "log_return"), num("sharpe", "sharpe"), num("max_drawdown", "max_drawdown"), "trade_count", num("score", "score"), "rank")


@query()
def run_nav_check(spark, d):
    s = cut_lineage(sweep(spark, d))
    p = s.groupBy("run_id").agg((F.max_by("nav", "step") / F.min_by("pre_value", "step")).alias("nav_multiple"))
    return mt.nav_check(s, p, episode="run_id", log_return="log_return").select("run_id", num(F.log("nav_multiple"), "log_multiple"), "consistent")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
