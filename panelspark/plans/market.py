"""Queries over daily bars: weekly panel, indicators, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import indicators as ind
from panelspark.operators import weekly as wk
from panelspark.operators.timejoin import assign_windows
from panelspark.plans.base import BARS, CAL, WEEKLY, bars, calendar, chain, day, num, sql_num, weekly
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


_W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_O = "OVER (PARTITION BY ticker ORDER BY date)"


def w(n: int) -> str:
    return _W.format(n=n - 1)


@query(chain(BARS, CAL, WEEKLY) + f"SELECT ticker, week, {sql_num('open', 'open')}, {sql_num('high', 'high')}, {sql_num('low', 'low')}, {sql_num('close', 'close')}, {sql_num('volume', 'volume', 2)}, CAST(n_days AS BIGINT) AS n_days, {sql_num('turbulence', 'turbulence')} FROM weekly")
def weekly_ohlcv(spark, d):
    x = weekly(spark, d)
    return x.select("ticker", "week", num("open", "open"), num("high", "high"), num("low", "low"), num("close", "close"), num("volume", "volume", 2), "n_days", num("turbulence", "turbulence"))


@query(chain(BARS, CAL, WEEKLY) + f"""SELECT w.ticker, w.week, {sql_num('p.close', 'prev_close')}, {sql_num('CASE WHEN p.close > 0 AND w.close > 0 THEN ln(w.close / p.close) END', 'log_ret_1w')}
FROM weekly w ASOF LEFT JOIN (SELECT ticker, ts, close FROM bars WHERE close IS NOT NULL) p ON w.ticker = p.ticker AND w.w_start >= p.ts""")
def weekly_log_return(spark, d):
    x = wk.weekly_log_returns(weekly(spark, d), bars(spark, d))
    return x.select("ticker", "week", num("prev_close", "prev_close"), num("log_ret_1w", "log_ret_1w"))


@query(chain(BARS, CAL, WEEKLY) + f"SELECT ticker, week, {sql_num('arg_max_null(ti_rsi_14, ts)', 'ti_rsi_14')}, {sql_num('arg_max_null(ti_price_zscore, ts)', 'ti_price_zscore')}, {sql_num('arg_max_null(turbulence, ts)', 'turbulence')} FROM inweek GROUP BY ticker, week")
def weekly_snapshot(spark, d):
    cols = ["ti_rsi_14", "ti_price_zscore", "turbulence"]
    inweek = assign_windows(bars(spark, d), calendar(spark, d), ts="ts", start="w_start", end="w_end")
    return wk.snapshots(inweek, cols).select("ticker", "week", *[num(c, c) for c in cols])


@query(chain(BARS) + f"SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(count(*) {w(100000)} AS BIGINT) AS n_prior, count(*) {w(100000)} >= 60 AS gate FROM bars")
def history_gate(spark, d):
    return wk.history_gate(bars(spark, d)).select("ticker", day("date"), "n_prior", "gate")


@query(chain(BARS) + """, weeks AS (SELECT CAST(date_trunc('week', date) AS DATE) AS monday, max(date) AS last_session FROM bars GROUP BY 1)
SELECT * FROM (SELECT CAST(monday AS VARCHAR) AS monday, CAST(last_session AS VARCHAR) AS last_session, CAST(lag(last_session) OVER (ORDER BY monday) AS VARCHAR) AS prev_session FROM weeks) WHERE prev_session IS NOT NULL""")
def session_calendar(spark, d):
    return wk.session_calendar(bars(spark, d)).select(day("monday"), day("last_session"), day("prev_session"))


@query(chain(BARS) + f""", r AS (SELECT ticker, date, close, ln(CASE WHEN close > 0 THEN close END) - lag(ln(CASE WHEN close > 0 THEN close END)) {_O} AS ret_log, close / nullif(lag(close) {_O}, 0) - 1 AS ret_pct FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('ret_log', 'ret_log')}, {sql_num('ret_pct', 'ret_pct')}, {sql_num(f'stddev_samp(ret_log) {w(20)}', 'realized_vol')} FROM r""")
def log_returns_vol(spark, d):
    return ind.returns(bars(spark, d)).select("ticker", day("date"), *[num(c, c) for c in ("ret_log", "ret_pct", "realized_vol")])


@query(chain(BARS) + f""", a AS (SELECT *, 100 * (close - min(low) {w(14)}) / nullif(max(high) {w(14)} - min(low) {w(14)}, 0) AS raw, -100 * (max(high) {w(14)} - close) / nullif(max(high) {w(14)} - min(low) {w(14)}, 0) AS willr FROM bars),
b AS (SELECT *, avg(raw) {w(3)} AS stoch_k FROM a)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('stoch_k', 'stoch_k')}, {sql_num(f'avg(stoch_k) {w(3)}', 'stoch_d')}, {sql_num('willr', 'willr')} FROM b""")
def stoch_willr(spark, d):
    return ind.stochastic(bars(spark, d)).select("ticker", day("date"), *[num(c, c) for c in ("stoch_k", "stoch_d", "willr")])


@query(chain(BARS) + f""", a AS (SELECT ticker, date, close, avg(close) {w(20)} AS m, stddev_pop(close) {w(20)} AS s FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('m - 2 * s', 'bb_low')}, {sql_num('m', 'bb_mid')}, {sql_num('m + 2 * s', 'bb_high')}, {sql_num('CASE WHEN s > 1e-9 THEN 4 * s / nullif(m, 0) ELSE 0 END', 'bb_width')}, {sql_num('CASE WHEN s > 1e-9 THEN (close - m + 2 * s) / (4 * s) END', 'bb_pos')} FROM a""")
def bollinger(spark, d):
    x = ind.bollinger(bars(spark, d))
    flat = (F.col("bb_high") - F.col("bb_low")) <= 4e-9  # rounding dust of a flat series
    x = x.withColumn("bb_width", F.when(flat | F.col("bb_mid").isNull(), 0.0).otherwise(F.col("bb_width"))).withColumn("bb_pos", F.when(~flat, F.col("bb_pos")))
    return x.select("ticker", day("date"), *[num(c, c) for c in ("bb_low", "bb_mid", "bb_high", "bb_width", "bb_pos")])


@query(chain(BARS) + f""", a AS (SELECT *, avg(volume) {w(20)} AS vm, stddev_samp(volume) {w(20)} AS vs, avg(close) {w(20)} AS pm, stddev_samp(close) {w(20)} AS ps FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('vm', 'vol_ma', 2)}, {sql_num('CASE WHEN vs > 1e-6 THEN (volume - vm) / vs END', 'vol_z')}, {sql_num('volume / nullif(vm, 0)', 'vol_ratio')}, {sql_num('pm', 'price_ma')}, {sql_num('CASE WHEN ps > 1e-9 THEN (close - pm) / ps END', 'price_z')} FROM a""")
def volume_price_stats(spark, d):
    x = ind.volume_price_stats(bars(spark, d))
    dust = lambda c, t, e: F.when(F.stddev_samp(c).over(ind.frame(20)) > e, F.col(t))
    x = x.withColumn("vol_z", dust("volume", "vol_z", 1e-6)).withColumn("price_z", dust("close", "price_z", 1e-9))
    return x.select("ticker", day("date"), num("vol_ma", "vol_ma", 2), num("vol_z", "vol_z"), num("vol_ratio", "vol_ratio"), num("price_ma", "price_ma"), num("price_z", "price_z"))


@query(chain(BARS) + f""", a AS (SELECT *, close - lag(close) {_O} AS mv FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num(f'sum(coalesce(sign(mv) * volume, 0)) {w(100000)}', 'obv', 2)}, {sql_num(f'avg(coalesce(CAST(mv > 0 AS INT), 0)) {w(5)}', 'up_day_ratio')} FROM a""")
def obv_updays(spark, d):
    return ind.obv_updays(bars(spark, d)).select("ticker", day("date"), num("obv", "obv", 2), num("up_day_ratio", "up_day_ratio"))


@query(chain(BARS) + f""", a AS (SELECT ticker, date, count(close) {w(20)} AS n, stddev_pop(close) {w(20)} AS s, avg(close) {w(20)} AS m, list(close) {w(20)} AS l FROM bars),
b AS (SELECT *, CASE WHEN n > 3 AND s > 1e-12 THEN list_sum(list_transform(list_filter(l, lambda v: v IS NOT NULL), lambda v: pow(v - m, 4))) / n / pow(s, 4) - 3 END AS g FROM a)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)', 'kurt', 4)} FROM b""")
def rolling_kurtosis(spark, d):
    return ind.kurtosis(bars(spark, d)).select("ticker", day("date"), num("kurt", "kurt", 4))


@query(chain(BARS) + f""", a AS (SELECT *, max(close) {w(100000)} AS run_max, sum(coalesce(log_ret, 0)) {w(100000)} AS cum_log FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('run_max', 'run_max')}, {sql_num('(run_max - close) / nullif(run_max, 0)', 'drawdown')}, {sql_num('cum_log', 'cum_log')}, {sql_num('exp(cum_log) - 1', 'cum_ret')} FROM a""")
def drawdown_cumreturn(spark, d):
    return ind.drawdown(bars(spark, d)).select("ticker", day("date"), *[num(c, c) for c in ("run_max", "drawdown", "cum_log", "cum_ret")])


@query(chain(BARS) + f""", a AS (SELECT ticker, date, (close - avg(close) {w(26)}) / (stddev_pop(close) {w(26)} + 1e-12) AS z, stddev_pop(close) {w(26)} AS s FROM bars),
b AS (SELECT *, CASE WHEN s > 1e-9 THEN z WHEN z IS NULL THEN NULL ELSE 0 END AS zz FROM a), c AS (SELECT *, list(coalesce(zz, 0)) {w(8)} AS h FROM b)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('zz', 'z')}, {sql_num('CASE WHEN len(h) = 8 THEN h[1] ELSE 0 END', 'z_first')}, {sql_num('CASE WHEN len(h) = 8 THEN list_sum(h) ELSE 0 END', 'z_sum')} FROM c""")
def znorm_history(spark, d):
    x = ind.norm_history(bars(spark, d).withColumn("close", F.col("close")))
    dev = F.stddev_pop("close").over(ind.frame(26))
    x = x.withColumn("z", F.when(dev > 1e-9, F.col("z")).when(F.col("z").isNotNull(), 0.0))
    past = F.collect_list(F.coalesce("z", F.lit(0.0))).over(ind.frame(8))
    x = x.withColumn("z_hist", F.when(F.size(past) == 8, past).otherwise(F.array_repeat(F.lit(0.0), 8)))
    return x.select("ticker", day("date"), num("z", "z"), num(F.col("z_hist")[0], "z_first"), num(F.aggregate("z_hist", F.lit(0.0), lambda a, b: a + b), "z_sum"))


@query(chain(BARS) + f""", a AS (SELECT ticker, date, close, count(close) {w(20)} AS n, quantile_cont(close, 0.5) {w(20)} AS m, quantile_cont(close, 0.75) {w(20)} - quantile_cont(close, 0.25) {w(20)} AS q FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('CASE WHEN n = 20 THEN (close - m) / nullif(q, 0) END', 'robust')} FROM a""")
def robust_rolling_scale(spark, d):
    return ind.robust_scale(bars(spark, d)).select("ticker", day("date"), num("robust", "robust"))


@query(chain(BARS) + f""", a AS (SELECT ticker, date, count(log_ret) {w(26)} AS n, list(CASE WHEN log_ret < 0 THEN log_ret END) {w(26)} AS l0, stddev_pop(CASE WHEN log_ret < 0 THEN log_ret END) {w(26)} AS dd, quantile_cont(CASE WHEN log_ret < 0 THEN log_ret END, 0.2) {w(26)} AS cut FROM bars),
b AS (SELECT *, list_filter(l0, lambda v: v IS NOT NULL) AS l FROM a)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num('CASE WHEN len(l) >= 2 THEN dd ELSE 0 END', 'downside_dev')}, {sql_num('CASE WHEN n = 26 AND len(l) > 0 THEN -list_avg(list_filter(l, lambda v: v <= cut)) ELSE 0 END', 'cvar')}, {sql_num('coalesce(len(l) / nullif(n, 0), 0)', 'loss_freq')} FROM b""")
def rolling_risk_metrics(spark, d):
    return ind.risk_window(bars(spark, d)).select("ticker", day("date"), *[num(c, c) for c in ("downside_dev", "cvar", "loss_freq")])


_K = "OVER (PARTITION BY ticker ORDER BY week ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(chain(BARS, CAL, WEEKLY) + f""", a AS (SELECT *, CAST(close > lag(close) OVER (PARTITION BY ticker ORDER BY week) AS DOUBLE) AS up FROM weekly)
SELECT ticker, week, {', '.join(f"{sql_num(f'avg({c}) {_K}', c + '_mean', 4)}, {sql_num(f'max({c}) {_K}', c + '_max', 4)}, {sql_num(f'CASE WHEN count({c}) {_K} >= 2 THEN last_value({c} IGNORE NULLS) {_K} - first_value({c} IGNORE NULLS) {_K} END', c + '_delta', 4)}" for c in ('close', 'turbulence'))},
{sql_num(f'coalesce(avg(up) {_K}, 0)', 'up_ratio')}, CAST(count(*) {_K} AS BIGINT) AS n_hist FROM a""")
def window_stats_lookback(spark, d):
    x = ind.lookback_stats(weekly(spark, d), ["close", "turbulence"])
    return x.select("ticker", "week", *[num(f"{c}_{t}", f"{c}_{t}", 4) for c in ("close", "turbulence") for t in ("mean", "max", "delta")], num("up_ratio", "up_ratio"), "n_hist")


@query("""WITH f AS (SELECT form_type, CAST(filing_date + CAST((12 - dayofweek(filing_date)) % 7 AS INTEGER) AS DATE) AS week FROM sec WHERE filing_date IS NOT NULL AND form_type IS NOT NULL),
c AS (SELECT form_type, week, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT k.form_type, CAST(unnest(generate_series((SELECT min(week) FROM c), (SELECT max(week) FROM c), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT DISTINCT form_type FROM c) k)
SELECT g.form_type, CAST(g.week AS VARCHAR) AS week, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c ON c.form_type = g.form_type AND c.week = g.week""")
def wfri_counts_dense(spark, d):
    return wk.friday_counts(table(spark, d, "sec", "filing_date", "form_type"), day="filing_date", key="form_type").select("form_type", day("week"), "n")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
