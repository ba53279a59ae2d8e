"""Queries of problem 7: rolling totals over trailing periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.rolling import trailing_totals
from panelspark.sources.tables import table, ticker_key

VALUES, PERIODS = ["close", "log_ret", "turbulence"], [7, 30]


def steady(c: str) -> Column:
    """Six decimals for comparisons; the odd offset keeps exact halves off the edge."""
    return F.floor(F.col(c) * 1e6 + 0.3137) / 1e6


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = table(spark, sf_dir, "daily_panel", "ticker", "date", "close_ts_utc", *VALUES).withColumn("ticker", ticker_key())
    return trailing_totals(panel, entity="ticker", day="date", version="close_ts_utc", anchor="close", values=VALUES, periods=PERIODS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).where("close_n_7 = 0").select("ticker", F.col("day").cast("string").alias("cal_day"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _totals(spark, sf_dir)
    return t.select("ticker", F.col("day").cast("string").alias("cal_day"), *[(steady(c) if "_n_" not in c else F.col(c)).alias(c) for c in t.columns[2:]])


def queries() -> dict:
    return {"p7_found": p7_found, "p7_totals": p7_totals}


_PANEL = """
WITH ranked AS (
  SELECT upper(trim(ticker)) AS ticker, date,
         CASE WHEN NOT isnan(close) THEN close END AS close, CASE WHEN NOT isnan(log_ret) THEN log_ret END AS log_ret,
         CASE WHEN NOT isnan(turbulence) THEN turbulence END AS turbulence,
         row_number() OVER (PARTITION BY upper(trim(ticker)), date ORDER BY close_ts_utc DESC, close DESC NULLS LAST, log_ret DESC NULLS LAST) AS rn
  FROM daily_panel),
bars AS (SELECT ticker, date, close, log_ret, turbulence FROM ranked WHERE rn = 1),
span AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars WHERE close IS NOT NULL GROUP BY ticker),
days AS (SELECT ticker, a, CAST(unnest(generate_series(a - 29, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
dense AS (SELECT d.ticker, d.a, d.day, b.close, b.log_ret, b.turbulence FROM days d LEFT JOIN bars b ON b.ticker = d.ticker AND b.date = d.day),
"""


def oracle_sql() -> dict[str, str]:
    cols = []
    for v in VALUES:
        for p in PERIODS:
            w = f"OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
            cols += [f"floor(sum({v}) {w} * 1e6 + 0.3137) / 1e6 AS {v}_sum_{p}", f"floor(avg({v}) {w} * 1e6 + 0.3137) / 1e6 AS {v}_avg_{p}", f"CAST(count({v}) {w} AS BIGINT) AS {v}_n_{p}"]
    rolled = _PANEL + "rolled AS (SELECT ticker, a, day, " + ", ".join(cols) + " FROM dense)\n"
    names = ", ".join(c.split(" AS ")[-1] for c in cols)
    return {
        "p7_found": rolled + "SELECT ticker, CAST(day AS VARCHAR) AS cal_day FROM rolled WHERE day >= a AND close_n_7 = 0",
        "p7_totals": rolled + f"SELECT ticker, CAST(day AS VARCHAR) AS cal_day, {names} FROM rolled WHERE day >= a",
    }
