"""Rolling indicators of daily bars as window expressions.

Every function takes clean bars (one row per ticker and date, NaN already null) and adds
columns. Frames are rows of one ticker ordered by date; a ticker has one row a day at most, so
a window partition is bounded by the calendar. All share one partitioning and ordering: one
shuffle and one sort serve any number of them. Zero denominators give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def ordered():
    """Rows of a ticker by date; a function, as a window needs a running session."""
    return Window.partitionBy("ticker").orderBy("date")


def frame(n: int):
    """The last n rows including the current one."""
    return ordered().rowsBetween(-(n - 1), 0)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def positive_log(c: str) -> Column:
    return F.log(F.when(F.col(c) > 0, F.col(c)))


def returns(df: DataFrame, vol: int = 20) -> DataFrame:
    """Log return, simple return, rolling sample deviation of log returns."""
    d = df.withColumn("ret_log", positive_log("close") - F.lag(positive_log("close")).over(ordered()))
    d = d.withColumn("ret_pct", ratio(F.col("close"), F.lag("close").over(ordered())) - 1)
    return d.withColumn("realized_vol", F.stddev_samp("ret_log").over(frame(vol)))


def stochastic(df: DataFrame, k: int = 14, d: int = 3, smooth: int = 3, willr: int = 14) -> DataFrame:
    """Smoothed %K, %D and Williams %R."""
    low, high = F.min("low").over(frame(k)), F.max("high").over(frame(k))
    out = df.withColumn("_raw", 100 * ratio(F.col("close") - low, high - low))
    out = out.withColumn("stoch_k", F.avg("_raw").over(frame(smooth)))
    out = out.withColumn("stoch_d", F.avg("stoch_k").over(frame(d)))
    low, high = F.min("low").over(frame(willr)), F.max("high").over(frame(willr))
    return out.withColumn("willr", -100 * ratio(high - F.col("close"), high - low)).drop("_raw")


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Bands of the mean plus and minus ``width`` population deviations."""
    mid, dev = F.avg("close").over(frame(n)), F.stddev_pop("close").over(frame(n))
    out = df.withColumn("bb_mid", mid).withColumn("bb_low", mid - width * dev).withColumn("bb_high", mid + width * dev)
    span = F.col("bb_high") - F.col("bb_low")
    return out.withColumn("bb_width", ratio(span, F.col("bb_mid"))).withColumn("bb_pos", ratio(F.col("close") - F.col("bb_low"), span))


def volume_price_stats(df: DataFrame, n: int = 20) -> DataFrame:
    """Means, z-scores and ratio of volume and price."""
    out = df
    for c, tag in (("volume", "vol"), ("close", "price")):
        mean, dev = F.avg(c).over(frame(n)), F.stddev_samp(c).over(frame(n))
        out = out.withColumn(f"{tag}_ma", mean).withColumn(f"{tag}_z", ratio(F.col(c) - mean, dev))
    return out.withColumn("vol_ratio", ratio(F.col("volume"), F.col("vol_ma")))


def obv_updays(df: DataFrame, n: int = 5) -> DataFrame:
    """On-balance volume (0 on the first row) and share of rising days."""
    move = F.col("close") - F.lag("close").over(ordered())
    out = df.withColumn("_signed", F.coalesce(F.signum(move) * F.col("volume"), F.lit(0.0))).withColumn("_up", F.coalesce((move > 0).cast("double"), F.lit(0.0)))
    out = out.withColumn("obv", F.sum("_signed").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("up_day_ratio", F.avg("_up").over(frame(n))).drop("_signed", "_up")


def kurtosis(df: DataFrame, value: str = "close", n: int = 20) -> DataFrame:
    """Bias-corrected excess kurtosis of the last n values; null below four values or
    without spread."""
    w = frame(n)
    cnt, g2, dev = F.count(value).over(w).cast("double"), F.kurtosis(value).over(w), F.stddev_pop(value).over(w)
    fixed = (cnt - 1) / ((cnt - 2) * (cnt - 3)) * ((cnt + 1) * g2 + 6)
    return df.withColumn("kurt", F.when((cnt > 3) & (dev > 1e-12), fixed))


def drawdown(df: DataFrame, value: str = "close") -> DataFrame:
    """Running maximum, drawdown from it, and growth since the first row."""
    out = df.withColumn("run_max", F.max(value).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("drawdown", ratio(F.col("run_max") - F.col(value), F.col("run_max")))
    out = out.withColumn("cum_log", F.sum(F.coalesce(F.col("log_ret"), F.lit(0.0))).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("cum_ret", F.exp("cum_log") - 1)


def norm_history(df: DataFrame, value: str = "close", window: int = 26, history: int = 8) -> DataFrame:
    """Z-score over the last ``window`` rows (population deviation + 1e-12) and its
    last ``history`` values as an array, zeros until there are that many."""
    w = frame(window)
    out = df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-12))
    past = F.collect_list(F.coalesce("z", F.lit(0.0))).over(frame(history))
    return out.withColumn("z_hist", F.when(F.size(past) == history, past).otherwise(F.array_repeat(F.lit(0.0), history)))


def robust_scale(df: DataFrame, value: str = "close", window: int = 20) -> DataFrame:
    """(x - median) / interquartile range over full windows, else null."""
    w = frame(window)
    q = lambda p: F.percentile(value, F.lit(p)).over(w)
    full = F.count(value).over(w) == window
    return df.withColumn("robust", F.when(full, ratio(F.col(value) - q(0.5), q(0.75) - q(0.25))))


def risk_window(df: DataFrame, value: str = "log_ret", window: int = 26, tail: float = 0.2) -> DataFrame:
    """Downside deviation (two negatives at least, else 0), mean size of the worst ``tail`` of
    the negatives (full windows only, else 0) and share of losses, over the last rows."""
    w = frame(window)
    neg = F.when(F.col(value) < 0, F.col(value))
    out = df.withColumn("_neg", neg)
    out = out.withColumn("_list", F.collect_list("_neg").over(w)).withColumn("_n", F.count(value).over(w)).withColumn("_cut", F.percentile("_neg", F.lit(tail)).over(w))
    out = out.withColumn("downside_dev", F.when(F.size("_list") >= 2, F.stddev_pop("_neg").over(w)).otherwise(F.lit(0.0)))
    tails = F.expr("filter(_list, x -> x <= _cut)")
    mean = F.aggregate(tails, F.lit(0.0), lambda a, x: a + x) / F.size(tails)
    out = out.withColumn("cvar", F.when((F.col("_n") == window) & (F.size("_list") > 0), -mean).otherwise(F.lit(0.0)))
    return out.withColumn("loss_freq", F.coalesce(ratio(F.size("_list").cast("double"), F.col("_n").cast("double")), F.lit(0.0))).drop("_neg", "_list", "_n", "_cut")


def lookback_stats(df: DataFrame, values: list[str], k: int = 6, by: str = "ticker", order: str = "week") -> DataFrame:
    """Per row over its last k rows: mean, max, change from first to last value
    (null below two values) and the share of rising rows."""
    w = Window.partitionBy(by).orderBy(order)
    back = w.rowsBetween(-(k - 1), 0)
    out = df
    for v in values:
        first, last = F.first(v, ignorenulls=True).over(back), F.last(v, ignorenulls=True).over(back)
        out = out.withColumn(f"{v}_mean", F.avg(v).over(back)).withColumn(f"{v}_max", F.max(v).over(back)).withColumn(f"{v}_delta", F.when(F.count(v).over(back) >= 2, last - first))
    v = values[0]
    out = out.withColumn("_up", (F.col(v) > F.lag(v).over(w)).cast("double"))
    return out.withColumn("up_ratio", F.coalesce(F.avg("_up").over(back), F.lit(0.0))).withColumn("n_hist", F.count(F.lit(1)).over(back)).drop("_up")
