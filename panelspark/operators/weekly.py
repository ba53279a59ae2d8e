"""Weekly bars, snapshots and the panel's history gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.timejoin import asof_backward


def weekly_bars(inweek: DataFrame) -> DataFrame:
    """A1: first open, highest high, lowest low, last close, total volume, days, last turbulence.

    Nulls are skipped; a week without any value of a column has null there.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return inweek.groupBy("ticker", "week").agg(
        F.first("w_start").alias("w_start"), F.first("w_end").alias("w_end"), first("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        last("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_days"), last("turbulence"),
    )


def weekly_log_returns(weeks: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds prev_close, the last close at or before the week's start (from daily bars, so
    gaps and gated weeks don't matter), and log_ret_1w."""
    out = asof_backward(weeks, bars.where("close IS NOT NULL").select("ticker", "ts", "close"), by=["ticker"], left_ts="w_start", right_ts="ts", values=["close"], prefix="prev_")
    ok = (F.col("prev_close") > 0) & (F.col("close") > 0)
    return out.withColumn("log_ret_1w", F.when(ok, F.log(F.col("close") / F.col("prev_close"))))


def snapshots(inweek: DataFrame, columns: list[str]) -> DataFrame:
    """A2: the columns of each ticker's last bar in the week, nulls included."""
    m = inweek.groupBy("ticker", "week").agg(F.max_by(F.struct(*columns), "ts").alias("s"))
    return m.select("ticker", "week", *[F.col(f"s.{c}").alias(c) for c in columns])


def history_gate(bars: DataFrame, min_days: int = 60) -> DataFrame:
    """Bars with ``n_prior``, the number of the ticker's bars up to and including each."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("n_prior", F.count(F.lit(1)).over(w)).withColumn("gate", F.col("n_prior") >= min_days)


def session_calendar(bars: DataFrame) -> DataFrame:
    """Last session of each Monday week and the one before; the first week is dropped."""
    days = bars.select("date").distinct()
    weeks = days.groupBy(F.date_trunc("week", "date").cast("date").alias("monday")).agg(F.max("date").alias("last_session"))
    # one row a week: a window without partition over a calendar, never over the facts
    out = weeks.withColumn("prev_session", F.lag("last_session").over(Window.orderBy("monday")))
    return out.where("prev_session IS NOT NULL")


def friday_counts(events: DataFrame, *, day: str, key: str) -> DataFrame:
    """Counts per key and week ending on Friday, zeros for the weeks between."""
    binned = events.where(F.col(day).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.next_day(F.date_sub(F.col(day), 1), "FR").alias("week"))
    counts = binned.groupBy("k", "week").agg(F.count("*").alias("n"))
    span = counts.agg(F.sequence(F.min("week"), F.max("week"), F.expr("INTERVAL 7 DAYS"))).scalar()
    grid = counts.select("k").distinct().withColumn("weeks", span).select("k", F.explode("weeks").alias("week"))
    return grid.join(counts, ["k", "week"], "left").select(F.col("k").alias(key), "week", F.coalesce("n", F.lit(0)).alias("n"))
