"""Queries over point-in-time joins and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import panel as pn
from panelspark.operators import timejoin as tj
from panelspark.plans.base import BARS, CAL, WEEKLY, bars, calendar, chain, day, num, sql_num, weekly
from panelspark.sources.tables import table, ticker_key

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


DAY = 86400
CALLS = """
calls AS (SELECT DISTINCT nullif(upper(trim(ticker)), '') AS ticker, doc_id, CAST(floor(epoch_us(event_ts_utc) / 1000000) AS BIGINT) AS ts FROM ec WHERE event_ts_utc IS NOT NULL)"""
FILINGS = """
filings AS (SELECT DISTINCT nullif(upper(trim(ticker)), '') AS ticker, doc_id, form_type, CAST(epoch(CAST(filing_date AS TIMESTAMP)) AS BIGINT) AS ts FROM sec WHERE filing_date IS NOT NULL)"""
TICKERS = "tickers AS (SELECT DISTINCT ticker FROM bars)"


def calls(spark, d):
    ec = table(spark, d, "ec", "ticker", "event_ts_utc", "doc_id").where("event_ts_utc IS NOT NULL")
    return ec.select(ticker_key().alias("ticker"), "doc_id", tj.epoch("event_ts_utc").alias("ts")).distinct()


def filings(spark, d):
    s = table(spark, d, "sec", "ticker", "filing_date", "doc_id", "form_type").where("filing_date IS NOT NULL")
    return s.select(ticker_key().alias("ticker"), "doc_id", "form_type", (F.unix_date("filing_date").cast("long") * DAY).alias("ts")).distinct()


def panel_keys(spark, d):
    return pn.base_panel(calendar(spark, d), bars(spark, d).select("ticker"))


@query(chain(BARS, CAL, TICKERS) + "SELECT t.ticker, c.week, c.w_start, c.w_end FROM tickers t CROSS JOIN cal c")
def full_panel_crossjoin(spark, d):
    return panel_keys(spark, d).select("ticker", "week", "w_start", "w_end")


def _asof_sql(facts: str, rows: str, days: int, extra: str = "") -> str:
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY doc_id DESC) AS rn FROM {rows}),
got AS (SELECT t.ticker, c.week, c.w_end, CASE WHEN c.w_end - r.ts <= {days * DAY} THEN r.doc_id END AS doc_id, CASE WHEN c.w_end - r.ts <= {days * DAY} THEN r.ts END AS at_s
  FROM (tickers t CROSS JOIN cal c) ASOF LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON t.ticker = r.ticker AND c.w_end >= r.ts)"""


@query(chain(BARS, CAL, TICKERS, CALLS) + _asof_sql("calls", "calls", 240) + " SELECT ticker, week, coalesce(doc_id, '') AS ec_doc, CAST(at_s AS DOUBLE) AS ec_ts FROM got")
def asof_calls(spark, d):
    got = tj.asof_backward(panel_keys(spark, d), calls(spark, d), by=["ticker"], left_ts="w_end", right_ts="ts", values=["doc_id"], tolerance_s=240 * DAY)
    return got.select("ticker", "week", F.coalesce("doc_id", F.lit("")).alias("ec_doc"), F.col("asof_ts").cast("double").alias("ec_ts"))


@query(chain(BARS, CAL, TICKERS, FILINGS) + _asof_sql("filings", "filings", 240) + " SELECT ticker, week, coalesce(doc_id, '') AS sec_doc, floor((w_end - at_s) / 86400) AS days_since FROM got")
def asof_filings_defaults(spark, d):
    got = tj.asof_backward(panel_keys(spark, d), filings(spark, d), by=["ticker"], left_ts="w_end", right_ts="ts", values=["doc_id"], tolerance_s=240 * DAY)
    return got.select("ticker", "week", F.coalesce("doc_id", F.lit("")).alias("sec_doc"), F.floor((F.col("w_end") - F.col("asof_ts")) / DAY).cast("double").alias("days_since"))


@query("""WITH e AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events),
c AS (SELECT event_id, user_id, s FROM e WHERE event_type = 'click'),
r AS (SELECT user_id, s, max(event_id) AS err FROM e WHERE event_type = 'error' GROUP BY ALL)
SELECT c.event_id, CAST(r.err AS DOUBLE) AS error_id, CAST(r.s AS DOUBLE) AS error_s FROM c ASOF LEFT JOIN r ON c.user_id = r.user_id AND c.s >= r.s""")
def asof_latest_event(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").withColumn("s", tj.epoch("ts"))
    got = tj.asof_backward(e.where("event_type = 'click'").select("event_id", "user_id", "s"), e.where("event_type = 'error'").select("user_id", "s", F.col("event_id").alias("error_id")), by=["user_id"], left_ts="s", right_ts="s", values=["error_id"], block_s=3 * DAY)
    return got.select("event_id", F.col("error_id").cast("double").alias("error_id"), F.col("asof_ts").cast("double").alias("error_s"))


@query(chain(BARS, CAL, TICKERS, CALLS) + _asof_sql("calls", "calls", 540) + " SELECT ticker, week, doc_id, CASE WHEN at_s IS NOT NULL THEN w_end - at_s <= 100 * 86400 ELSE false END AS within_narrow FROM got")
def lookback_fallback(spark, d):
    got = tj.lookback_pick(panel_keys(spark, d), calls(spark, d), by=["ticker"], left_ts="w_end", right_ts="ts", values=["doc_id"], narrow_s=100 * DAY, wide_s=540 * DAY)
    return got.select("ticker", "week", "doc_id", F.coalesce("within_narrow", F.lit(False)).alias("within_narrow"))


def _kind_sql(name: str, form: str, days: int) -> str:
    return f""", {name} AS (SELECT t.ticker, c.week, CASE WHEN c.w_end - r.ts <= {days * DAY} THEN r.doc_id END AS doc_id
  FROM (tickers t CROSS JOIN cal c) ASOF LEFT JOIN (SELECT ticker, ts, max(doc_id) AS doc_id FROM filings WHERE form_type = '{form}' GROUP BY ALL) r ON t.ticker = r.ticker AND c.w_end >= r.ts)"""


@query(chain(BARS, CAL, TICKERS, FILINGS) + _kind_sql("q", "10-Q", 140) + _kind_sql("k", "10-K", 400) + " SELECT q.ticker, q.week, q.doc_id AS q_doc, k.doc_id AS k_doc, CAST((q.doc_id IS NOT NULL)::INT + (k.doc_id IS NOT NULL)::INT AS INTEGER) AS n_picks FROM q JOIN k USING (ticker, week)")
def latest_per_form_array(spark, d):
    got = tj.latest_per_kind(panel_keys(spark, d), filings(spark, d), by=["ticker"], left_ts="w_end", right_ts="ts", kind="form_type", kinds={"10-Q": 140 * DAY, "10-K": 400 * DAY}, values=["doc_id"])
    pick = lambda k: F.try_element_at(F.filter("picks", lambda p: p["kind"] == k), F.lit(1))["doc_id"]
    return got.select("ticker", "week", pick("10-Q").alias("q_doc"), pick("10-K").alias("k_doc"), F.size("picks").alias("n_picks"))


@query("""WITH c AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, event_id, CASE WHEN event_type = 'signup' THEN 'add' ELSE 'remove' END AS action FROM events WHERE event_type IN ('signup', 'error')),
cut AS (SELECT CAST(epoch(TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) AS at_s),
last AS (SELECT user_id, arg_max(action, row(s, event_id)) AS a FROM c GROUP BY user_id),
now AS (SELECT user_id FROM last WHERE a = 'add'),
later AS (SELECT user_id, arg_min(action, row(s, event_id)) AS f FROM c WHERE s > (SELECT at_s FROM cut) GROUP BY user_id)
SELECT coalesce(n.user_id, l.user_id) AS user_id FROM now n FULL JOIN later l ON n.user_id = l.user_id WHERE CASE WHEN l.f IS NULL THEN n.user_id IS NOT NULL ELSE l.f <> 'add' END""")
def membership_rollback(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type IN ('signup', 'error')")
    c = e.select("user_id", "event_id", tj.epoch("ts").alias("s"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("action"))
    now = c.groupBy("user_id").agg(F.max_by("action", F.struct("s", "event_id")).alias("a")).where("a = 'add'")
    return tj.membership_on(now, c, member="user_id", ts="s", action="action", at=1705276800, tie="event_id")


@query(chain(BARS) + """, u AS (SELECT list(DISTINCT ticker) AS everyone FROM bars), g AS (SELECT date, list(DISTINCT ticker) AS have FROM bars GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, CAST(len(have) AS INTEGER) AS n_present, len(have) = len(everyone) AS complete, coalesce(array_to_string(list_sort(list_filter(everyone, lambda t: NOT list_contains(have, t))), ','), '') AS missing FROM g, u""")
def coverage_report(spark, d):
    b = bars(spark, d)
    got = pn.coverage(b, period="date", entity="ticker", universe=b.select("ticker"))
    return got.select(day("date"), "n_present", "complete", F.array_join("missing", ",").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1")
def dedup_keep_last(spark, d):
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    return pn.keep_last(x, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.desc("l_quantity")]).drop("l_shipdate")


@query(chain(BARS) + ", i AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_idx FROM (SELECT DISTINCT date FROM bars)) SELECT ticker, CAST(date AS VARCHAR) AS date, day_idx FROM bars JOIN i USING (date) WHERE day_idx BETWEEN 100 AND 400")
def dense_day_idx(spark, d):
    return pn.dense_index(bars(spark, d).select("ticker", "date"), "date").where(F.col("day_idx").between(100, 400)).select("ticker", day("date"), "day_idx")


@query(chain(BARS) + """, x AS (SELECT a.close AS a, b.close AS b, a.volume AS c, b.volume + CASE WHEN b.volume > 1000000 THEN 1 ELSE 0 END AS e FROM bars a JOIN bars b USING (ticker, date))
SELECT count(*) AS n_common, CAST(sum(CASE WHEN (a IS NULL AND b IS NULL) OR abs(a - b) <= 1e-12 + 1e-9 * abs(b) THEN 0 ELSE 1 END) AS BIGINT) AS diff_close,
CAST(sum(CASE WHEN (c IS NULL AND e IS NULL) OR abs(c - e) <= 1e-12 + 1e-9 * abs(e) THEN 0 ELSE 1 END) AS BIGINT) AS diff_volume FROM x""")
def overlap_check(spark, d):
    a = bars(spark, d).select("ticker", "date", "close", "volume")
    return pn.overlap_check(a, a.withColumn("volume", F.col("volume") + F.when(F.col("volume") > 1e6, 1.0).otherwise(0.0)), ["ticker", "date"], ["close", "volume"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, d):
    done = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return pn.resume_keys(table(spark, d, "orders", "o_orderkey"), done, ["o_orderkey"])


@query(chain(BARS) + f""", q AS (SELECT ticker, quantile_cont(close, 0.5) AS m, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS s FROM bars WHERE date < DATE '2020-01-01' GROUP BY ticker)
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, {sql_num('(close - m) / CASE WHEN s = 0 THEN 1 ELSE s END', 'scaled')} FROM bars b LEFT JOIN q ON b.ticker = q.ticker""")
def group_scaler(spark, d):
    b = bars(spark, d)
    return pn.group_scale(b.where("date < DATE '2020-01-01'"), b, by="ticker", value="close").select("ticker", day("date"), num("scaled", "scaled"))


@query(chain(BARS) + f""", r AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY close ASC NULLS FIRST, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num(pn.normal_quantile_sql('r / (n + 1)'), 'gauss')} FROM r""")
def gauss_rank(spark, d):
    return pn.gauss_rank(bars(spark, d), period="date", entity="ticker", value="close").select("ticker", day("date"), num("gauss", "gauss"))


_PX = "CASE WHEN close = 0 THEN 1 ELSE adj / close END"


@query(chain(BARS) + f", p AS (SELECT *, close * 0.5 AS adj FROM bars) SELECT ticker, CAST(date AS VARCHAR) AS date, {', '.join(sql_num(f'{c} * {_PX}', c, 3) for c in ('open', 'high', 'low'))}, {sql_num('adj', 'close', 3)}, {sql_num('volume', 'volume', 1)} FROM p")
def adj_prices(spark, d):
    x = pn.adjust_prices(bars(spark, d).withColumn("adj_close", F.col("close") * 0.5))
    return x.select("ticker", day("date"), *[num(F.col(c) + 0.0, c, 3) for c in ("open", "high", "low", "close")], num("volume", "volume", 1))


@query(chain(BARS) + ", g AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(log_ret) > 0) SELECT ticker, CAST(date AS VARCHAR) AS date, coalesce(log_ret, 0) * 0.5 AS log_ret, 0.0::DOUBLE AS turbulence FROM bars WHERE ticker IN (SELECT ticker FROM g)")
def drop_unlabeled_mask(spark, d):
    x = pn.drop_unlabeled(bars(spark, d), "ticker", "log_ret")
    return pn.mask_features(x, {"log_ret": 0.5, "turbulence": 0.0, "close": 1.0}).select("ticker", day("date"), "log_ret", "turbulence")


@query(chain(BARS, CAL, TICKERS, CALLS, FILINGS, WEEKLY) + """, pe AS (SELECT t.ticker, c.week, c.w_end, r.ts AS ec FROM (tickers t CROSS JOIN cal c) ASOF LEFT JOIN (SELECT DISTINCT ticker, ts FROM calls) r ON t.ticker = r.ticker AND c.w_end >= r.ts),
ps AS (SELECT pe.*, r.ts AS se FROM pe ASOF LEFT JOIN (SELECT DISTINCT ticker, ts FROM filings) r ON pe.ticker = r.ticker AND pe.w_end >= r.ts),
m AS (SELECT ps.*, w.close - w.open AS s1, w.turbulence - 20 AS s2 FROM ps LEFT JOIN weekly w ON ps.ticker = w.ticker AND ps.week = w.week)
SELECT ticker, week, CAST(floor((w_end - ec) / 86400) AS DOUBLE) AS days_since_ec, CAST(floor((w_end - se) / 86400) AS DOUBLE) AS days_since_sec, CAST((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT AS INTEGER) AS n_sources,
(coalesce(s1 > 0, false) OR coalesce(s2 > 0, false)) AND (coalesce(s1 < 0, false) OR coalesce(s2 < 0, false)) AS sign_disagreement FROM m""")
def cross_source_features(spark, d):
    p = tj.asof_backward(panel_keys(spark, d), calls(spark, d), by=["ticker"], left_ts="w_end", right_ts="ts", values=["doc_id"], prefix="ec_")
    p = tj.asof_backward(p, filings(spark, d), by=["ticker"], left_ts="w_end", right_ts="ts", values=["doc_id"], prefix="sec_")
    s = weekly(spark, d).select("ticker", "week", (F.col("close") - F.col("open")).alias("s1"), (F.col("turbulence") - 20).alias("s2"))
    x = pn.source_features(p.join(s, ["ticker", "week"], "left"), at="w_end", event_times={"ec": "ec_asof_ts", "sec": "sec_asof_ts"}, signals=["s1", "s2"])
    return x.select("ticker", "week", F.col("days_since_ec").cast("double").alias("days_since_ec"), F.col("days_since_sec").cast("double").alias("days_since_sec"), "n_sources", "sign_disagreement")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
