"""Views and helpers that the query modules share, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.rolling import latest_rows
from panelspark.operators.timejoin import assign_windows, epoch
from panelspark.sources.tables import table

BAR_VALUES = ["open", "high", "low", "close", "volume", "log_ret", "ti_rsi_14", "ti_price_zscore", "turbulence"]


def num(c: str | Column, name: str, digits: int = 6) -> Column:
    """A computed double for comparison: cut to ``digits`` decimals; the odd offset keeps
    exact halves off the edge."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.floor(col * 10.0**digits + 0.3137).cast("double") / 10.0**digits).alias(name)


def sql_num(expr: str, name: str, digits: int = 6) -> str:
    return f"CAST(floor(({expr}) * 1e{digits} + 0.3137) AS DOUBLE) / 1e{digits} AS {name}"


def day(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("string").alias(name or c)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean row per ticker and session: corrections applied, NaN null, ``ts`` in seconds."""
    p = table(spark, sf_dir, "daily_panel", "ticker", "date", "close_ts_utc", *BAR_VALUES)
    p = p.withColumn("ts", epoch("close_ts_utc"))
    return latest_rows(p, ["ticker", "date"], [*BAR_VALUES, "ts"], "close_ts_utc")


_NAN = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in BAR_VALUES)
BARS = f"""
bars0 AS (SELECT ticker, date, CAST(floor(epoch_us(close_ts_utc) / 1000000) AS BIGINT) AS ts, close_ts_utc, {_NAN} FROM daily_panel),
bars AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY close_ts_utc DESC, close DESC NULLS LAST) AS rn FROM bars0) WHERE rn = 1)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trading weeks with their windows in seconds; ``week`` is the New York close day."""
    c = table(spark, sf_dir, "calendar", "prev_close_utc", "curr_close_utc").distinct()
    sec = lambda x: F.unix_seconds(F.to_timestamp(x))
    return c.select(F.substring("curr_close_utc", 1, 10).alias("week"), sec("prev_close_utc").alias("w_start"), sec("curr_close_utc").alias("w_end"))


CAL = """
cal AS (SELECT DISTINCT substr(curr_close_utc, 1, 10) AS week, CAST(epoch(CAST(prev_close_utc AS TIMESTAMPTZ)) AS BIGINT) AS w_start,
        CAST(epoch(CAST(curr_close_utc AS TIMESTAMPTZ)) AS BIGINT) AS w_end FROM calendar)"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per ticker over the calendar windows (prev close, this close]."""
    from panelspark.operators.weekly import weekly_bars

    return weekly_bars(assign_windows(bars(spark, sf_dir), calendar(spark, sf_dir), ts="ts", start="w_start", end="w_end"))


WEEKLY = """
inweek AS (SELECT b.*, c.week, c.w_start, c.w_end FROM bars b JOIN cal c ON b.ts > c.w_start AND b.ts <= c.w_end),
weekly AS (SELECT ticker, week, any_value(w_start) AS w_start, any_value(w_end) AS w_end, arg_min(open, ts) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) FILTER (close IS NOT NULL) AS close, sum(volume) AS volume, count(*) AS n_days, arg_max(turbulence, ts) FILTER (turbulence IS NOT NULL) AS turbulence
  FROM inweek GROUP BY ticker, week)"""


def chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)
