"""Queries over whole pipelines, observations and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import observe as ob
from panelspark.operators import pipeline as pl
from panelspark.operators import selection as sel
from panelspark.operators.timejoin import assign_windows, epoch
from panelspark.operators.weekly import weekly_log_returns
from panelspark.plans.base import BARS, CAL, WEEKLY, bars, calendar, chain, day, num, sql_num, weekly
from panelspark.plans.experiments import WEIGHTS, weights
from panelspark.session import cut_lineage
from panelspark.sources.tables import news_times, table, ticker_key

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def w(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(chain(BARS) + f""", a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), b AS (SELECT *, avg(tp) {w(30)} AS m, list(tp) {w(30)} AS l FROM a),
c AS (SELECT *, list_avg(list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: abs(x - m))) AS mad FROM b)
SELECT ticker, CAST(date AS VARCHAR) AS date, {sql_num(f'avg(close) {w(30)}', 'sma_short')}, {sql_num(f'avg(close) {w(60)}', 'sma_long')}, {sql_num(f'avg(close) {w(20)} + 2 * stddev_samp(close) {w(20)}', 'boll_ub')}, {sql_num(f'avg(close) {w(20)} - 2 * stddev_samp(close) {w(20)}', 'boll_lb')}, {sql_num('CASE WHEN mad > 1e-12 THEN (tp - m) / (0.015::DOUBLE * mad) END', 'cci', 4)} FROM c""")
def older_indicators(spark, d):
    x = ob.older_indicators(bars(spark, d))
    return x.select("ticker", day("date"), *[num(c, c) for c in ("sma_short", "sma_long", "boll_ub", "boll_lb")], num("cci", "cci", 4))


@query(chain(BARS) + f""", f AS (SELECT *, CAST(date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS DATE) AS week FROM bars)
SELECT ticker, CAST(week AS VARCHAR) AS week, {sql_num('arg_min(open, date) FILTER (open IS NOT NULL)', 'open')}, {sql_num('max(high)', 'high')}, {sql_num('min(low)', 'low')}, {sql_num('arg_max(close, date) FILTER (close IS NOT NULL)', 'close')}, {sql_num('sum(volume)', 'volume', 1)} FROM f GROUP BY ticker, week""")
def resample_friday(spark, d):
    x = ob.resample_friday(bars(spark, d))
    return x.select("ticker", day("week"), *[num(c, c) for c in ("open", "high", "low", "close")], num("volume", "volume", 1))


@query("SELECT l_suppkey, " + ", ".join(f"coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity END), 0)::DOUBLE AS {f}" for f in "ANR") + " FROM lineitem GROUP BY l_suppkey")
def pivot_flags(spark, d):
    x = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").cast("double").alias("q"))
    return ob.pivot_wide(x, period="l_suppkey", entity="l_returnflag", value="q", entities=["A", "N", "R"]).fillna(0.0)


@query(chain(BARS, CAL, WEEKLY) + f""", h AS (SELECT ticker, week, list(close) OVER k AS l, first_value(week) OVER k AS first_week, count(*) OVER k AS n FROM weekly WINDOW k AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT ticker, week, first_week, CAST(n AS INTEGER) AS n, {sql_num('list_sum(l)', 'close_sum', 4)} FROM h""")
def lookback_history(spark, d):
    x = ob.history_rows(weekly(spark, d), ["close"], by="ticker", order="week")
    total = F.aggregate(F.filter(F.transform("history", lambda h: h["close"]), lambda c: c.isNotNull()), F.lit(0.0), lambda a, c: a + c)
    known = F.size(F.filter("history", lambda h: h["close"].isNotNull())) > 0
    return x.select("ticker", "week", F.element_at("history", 1)["week"].alias("first_week"), F.size("history").alias("n"), num(F.when(known, total), "close_sum", 4))


@query(chain(BARS) + "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_null, CAST(coalesce(count(*) FILTER (isnan({c})), 0) AS BIGINT) AS {c}_nan, CAST(coalesce(count(*) FILTER (isinf({c})), 0) AS BIGINT) AS {c}_inf" for c in ("close", "log_ret")) + " FROM daily_panel")
def numeric_check(spark, d):
    return ob.numeric_check(table(spark, d, "daily_panel", "close", "log_ret"), ["close", "log_ret"])


_KEYS = {"ec": "ticker", "sec": "ticker", "documents": "ticker"}


@query("WITH u AS (SELECT nullif(upper(trim(ticker)), '') AS k FROM ec UNION SELECT nullif(upper(trim(ticker)), '') FROM sec UNION SELECT nullif(upper(trim(ticker)), '') FROM documents) SELECT k FROM u WHERE k IS NOT NULL")
def ticker_union(spark, d):
    return ob.key_union([table(spark, d, t, c).select(ticker_key(c).alias("k")) for t, c in _KEYS.items()], "k")


@query("""WITH a AS (SELECT DISTINCT nullif(upper(trim(ticker)), '') AS k FROM documents), b AS (SELECT DISTINCT nullif(upper(trim(ticker)), '') AS k FROM ec)
SELECT k, k IN (SELECT k FROM b WHERE k IS NOT NULL) AS common FROM a WHERE k IS NOT NULL""")
def ticker_difference(spark, d):
    a, b = (table(spark, d, t, "ticker").select(ticker_key().alias("k")).where("k IS NOT NULL") for t in ("documents", "ec"))
    return ob.union_named([ob.key_intersection(a, b, ["k"]).withColumn("common", F.lit(True)), ob.key_difference(a, b, ["k"]).withColumn("common", F.lit(False))])


@query("SELECT n_name, CAST((row_number() OVER (ORDER BY n_name) - 1) // 7 AS INTEGER) AS chunk FROM nation")
def chunked_list(spark, d):
    return sel.numbered_chunks(table(spark, d, "nation", "n_name"), "n_name", 7)


@query(chain(BARS, CAL, WEEKLY, WEIGHTS) + f", r AS (SELECT week, w, row_number() OVER (PARTITION BY week ORDER BY w DESC) AS k FROM trade WHERE w IS NOT NULL) SELECT week, {sql_num('sum(w)', 'top3')} FROM r WHERE k <= 3 GROUP BY week")
def top_weights(spark, d):
    x = weights(spark, d).where("w[0] IS NOT NULL").withColumn("t", sel.top_by_size("w", 3))
    return x.select("week", num(F.aggregate("t", F.lit(0.0), lambda a, v: a + v), "top3"))


@query(chain(BARS, CAL, WEEKLY, WEIGHTS) + f", c AS (SELECT quantile_cont(w, 0.99) AS cap FROM trade WHERE w > 0) SELECT week, CAST(row_number() OVER (PARTITION BY week ORDER BY ticker) - 1 AS INTEGER) AS position, {sql_num('w', 'weight')}, {sql_num('least(w, cap)', 'shade')} FROM trade, c")
def weight_heatmap(spark, d):
    x = ob.heatmap(cut_lineage(weights(spark, d).select("week", "w")), "w")
    return x.select("week", F.col("position").alias("position"), num("weight", "weight"), num("shade", "shade"))


@query(chain(BARS) + "SELECT ticker, " + ", ".join(f"round_even({e}, 4) AS {n}" for e, n in (("max(close)", "top"), ("min(low)", "bottom"))) + " FROM bars GROUP BY ticker")
def rounded_summary(spark, d):
    return ob.rounded(bars(spark, d).groupBy("ticker").agg(F.max("close").alias("top"), F.min("low").alias("bottom")))


@query()
def observations(spark, d):
    x = weekly_log_returns(weekly(spark, d), bars(spark, d))
    o = ob.observations(x, period="week", entity="ticker", technical=["close", "volume"], ranked=["close"], text=["log_ret_1w"], market=["turbulence"])
    return o.select("week", F.size("entities").alias("n_entities"), F.size(F.flatten("trading")).alias("n_trading"), num(F.aggregate(F.flatten("valuation"), F.lit(0.0), lambda a, v: a + v), "valuation_sum", 4), num(F.col("market")[0], "market", 4))


@query()
def synthetic_panel(spark, d):
    return ob.synthetic_panel(spark, periods=60, entities=["A", "B", "C"], technical=["t1"]).select("day_idx", "ticker", num("close", "close"), num("t1", "t1"))


def _articles(spark, d):
    """News of each calendar week with a score; times by the normaliser, repeated rows once."""
    n = news_times(spark, d, "ticker", "doc_id", "text", "source_tier").select(ticker_key().alias("ticker"), "doc_id", "text", "source_tier", F.col("published_s").alias("ts")).where("ticker IS NOT NULL AND ts IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"])
    n = assign_windows(n, calendar(spark, d), ts="ts", start="w_start", end="w_end", closed_left=True).where(F.length("text") >= 40)
    score = sel.score_v2(tier=F.col("source_tier"), n_chars=F.length("text"), ts=F.col("ts"), end=F.col("w_end"))
    return n.withColumn("score", score).withColumn("day", F.floor(F.col("ts") / 86400))


def news_signals(spark, d):
    ctx = pl.weekly_context(_articles(spark, d), week="week", ticker="ticker", ts="ts", day="day", item="doc_id", text="text", score="score")
    return pl.analysed(ctx, ["week", "ticker"], "context", "news")


@query()
def weekly_news_signals(spark, d):
    x = news_signals(spark, d)
    return x.select("week", "ticker", num("news_signal", "news_signal", 3), num("news_risk_score", "news_risk_score", 3), num("news_confidence", "news_confidence", 3), "news_rationale")


def _doc_signals(spark, d, name, texts, ts, prefix):
    """Signals of whole documents: all text columns of a row are read as one text, a line apart,
    so a document is blank only when each of them is."""
    t = table(spark, d, name, "ticker", "doc_id", *texts, ts).dropDuplicates(["doc_id"])
    at = epoch(ts) if name == "ec" else F.unix_date(ts).cast("long") * 86400
    rows = t.select(ticker_key().alias("ticker"), "doc_id", F.concat_ws("\n\n", *texts).alias("x"), at.alias("ts")).where("ts IS NOT NULL AND ticker IS NOT NULL")
    return rows.select("ticker", "doc_id", "ts").join(pl.analysed(rows, ["doc_id"], "x", prefix), "doc_id").drop(f"{prefix}_rationale")


def filing_signals(spark, d):
    return _doc_signals(spark, d, "sec", ["management_discussion", "risk_factors"], "filing_date", "sec")


def tier1(spark, d):
    calls = _doc_signals(spark, d, "ec", ["text"], "event_ts_utc", "ec")
    wk = weekly(spark, d)
    tech = pl.technical_rows(ob.history_rows(wk, ["close", "volume"], by="ticker", order="week"), keys=["week", "ticker"], columns=["close", "volume"])
    return pl.tier1_panel(calendar(spark, d), bars(spark, d).select("ticker"), calls=calls, filings=filing_signals(spark, d), news=news_signals(spark, d), technical=tech)


_SOURCES = ["ec", "sec", "news", "tech"]


@query()
def tier1_panel(spark, d):
    x = tier1(spark, d)
    return x.select("week", "ticker", *[num(f"{s}_signal", f"{s}_signal", 3) for s in _SOURCES], F.col("days_since_ec").cast("double").alias("days_since_ec"), F.col("days_since_sec").cast("double").alias("days_since_sec"), "n_sources", "sign_disagreement")


@query()
def tier2_panel(spark, d):
    x = pl.tier2_panel(cut_lineage(tier1(spark, d)), _SOURCES)
    return x.select("week", "ticker", *[num(f"{r}_signal", f"{r}_signal", 3) for r in ("business", "risk", "skeptic", "judge")])


def _tone(words) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)}" for w in words)


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t, text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) = '' AS blank FROM documents), c AS (SELECT doc_id, blank, CAST(coalesce({_tone(pl.UP)}, 0) AS BIGINT) AS u, CAST(coalesce({_tone(pl.DOWN)}, 0) AS BIGINT) AS n FROM d),
v AS (SELECT *, CASE WHEN u + n > 0 THEN 10 * (u - n) / (u + n)::DOUBLE ELSE 0 END AS s FROM c)
SELECT doc_id, {sql_num('CASE WHEN blank THEN 0 ELSE least(10, round_even(s + 1, 3)) END', 'bull_signal', 3)}, {sql_num('CASE WHEN blank THEN 0 ELSE greatest(-10, round_even(s - 1, 3)) END', 'bear_signal', 3)},
CASE WHEN blank THEN 'NO_MEANINGFUL_NEWS' ELSE u || ' up, ' || n || ' down' END AS bull_rationale, CASE WHEN blank THEN 'NO_MEANINGFUL_NEWS' ELSE u || ' up, ' || n || ' down' END AS bear_rationale FROM v""")
def bull_bear(spark, d):
    t = table(spark, d, "documents", "doc_id", "text")
    x = pl.two_sided(t, ["doc_id"], "text")
    return x.select("doc_id", num("bull_signal", "bull_signal", 3), num("bear_signal", "bear_signal", 3), "bull_rationale", "bear_rationale")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S


