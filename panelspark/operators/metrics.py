"""Episode, trading and run metrics. Every summary is one pass of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE_COLUMNS = ("nav_multiple", "log_return", "sharpe", "max_drawdown")


def pct(c: str | Column, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def episode_totals(steps: DataFrame, *, episode: str, order: str, log_return: str, trades: str | None = None, cost: str | None = None, initial: float = 1e6) -> DataFrame:
    """Per episode its steps, final value, NAV multiple, annualised Sharpe
    (52 steps a year, population deviation, 0 when flat or single), deepest drawdown (at
    most 0, the start counts), and trades. Null returns count as 0."""
    r = F.coalesce(F.col(log_return), F.lit(0.0))
    w = Window.partitionBy(episode).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = steps.withColumn("_r", r).withColumn("_cum", F.sum(r).over(w))
    d = d.withColumn("_peak", F.greatest(F.max("_cum").over(w), F.lit(0.0)))
    dev = F.stddev_pop("_r")
    g = d.groupBy(episode).agg(
        F.count("*").alias("n_steps"), F.sum("_r").alias("log_return"), F.avg("_r").alias("_m"), dev.alias("_s"), F.min(F.exp(F.col("_cum") - F.col("_peak")) - 1).alias("max_drawdown"),
        *([F.sum(F.col(trades)).alias("trade_count")] if trades else []), *([F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("total_cost")] if cost else []),
    )
    sharpe = F.when((F.col("n_steps") >= 2) & (F.col("_s") > 1e-15), F.col("_m") / F.col("_s") * (52**0.5)).otherwise(0.0)
    return g.withColumn("nav_multiple", F.exp("log_return")).withColumn("final_value", initial * F.exp("log_return")).withColumn("sharpe", sharpe).drop("_m", "_s")


def episode_summary(perf: DataFrame, columns: tuple[str, ...] = EPISODE_COLUMNS) -> DataFrame:
    """A10: one row: count, mean, median, sample deviation (0 for one), min and max of each
    column, and flags for blown-up episodes (multiple <= 0.1 or >= 10)."""
    out = [F.count("*").alias("n")]
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), pct(c, 0.5).alias(f"{c}_median"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return perf.agg(*out, F.coalesce(F.bool_or(F.col("nav_multiple") <= 0.1), F.lit(False)).alias("any_ruin"), F.coalesce(F.bool_or(F.col("nav_multiple") >= 10), F.lit(False)).alias("any_explosion"))


def weight_scalars(df: DataFrame, weights: str) -> DataFrame:
    """Sum of absolute values, number of non-zeros, concentration and largest weight."""
    fold = lambda f: F.aggregate(weights, F.lit(0.0), lambda a, x: a + f(x))
    return df.withColumn("w_l1", fold(F.abs)).withColumn("w_nonzero", F.size(F.filter(weights, lambda x: x != 0))).withColumn("hhi", fold(lambda x: x * x)).withColumn("w_max", F.array_max(weights))


def turnover(df: DataFrame, weights: str, *, episode: str, order: str) -> DataFrame:
    """Half the absolute change of weights since the episode's last step; null on its
    first step and after a step without weights."""
    w = Window.partitionBy(episode).orderBy(order)
    return df.withColumn("_prev", F.lag(weights).over(w)).withColumn("turnover", 0.5 * F.aggregate(F.zip_with("_prev", weights, lambda a, b: F.abs(b - a)), F.lit(0.0), lambda a, x: a + x)).drop("_prev")


def trading_summary(df: DataFrame) -> DataFrame:
    """Mean, median, 90 % quantile and maximum of turnover and concentration."""
    out = []
    for c in ("turnover", "hhi"):
        out += [F.avg(c).alias(f"{c}_mean"), pct(c, 0.5).alias(f"{c}_median"), pct(c, 0.9).alias(f"{c}_p90"), F.max(c).alias(f"{c}_max")]
    return df.agg(*out, F.max("w_max").alias("max_single_weight"))


def training_summary(df: DataFrame, order: str, columns: list[str], kl: str | None = None, kl_limit: float = 0.05) -> DataFrame:
    """First, last, least and largest non-null value of each training metric by step."""
    out = []
    for c in columns:
        step = F.when(F.col(c).isNotNull(), F.col(order))
        out += [F.min_by(c, step).alias(f"{c}_first"), F.max_by(c, step).alias(f"{c}_last"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    if kl:
        out.append(F.coalesce(F.bool_or(F.col(kl) > kl_limit), F.lit(False)).alias("kl_high"))
    return df.agg(*out)


def generalization(perf: DataFrame, role: str) -> DataFrame:
    """Test minus train means, quantiles of both, and degradation flags, in one pass over
    rows marked train or test. Drawdowns are negative, so a lower mean is worse."""
    side = lambda c, r: F.when(F.col(role) == r, F.col(c))
    out = [(F.avg(side(c, "test")) - F.avg(side(c, "train"))).alias(f"delta_{c}") for c in EPISODE_COLUMNS]
    out += [pct(side("nav_multiple", r), p).alias(f"nav_{r}_p{int(p * 100)}") for r in ("train", "test") for p in (0.1, 0.5, 0.9)]
    d = perf.agg(*out)
    return d.withColumn("nav_degrades", F.col("delta_nav_multiple") < -0.05).withColumn("sharpe_degrades", F.col("delta_sharpe") < -0.2).withColumn("mdd_degrades", F.col("delta_max_drawdown") < -0.05)


def guarded_corr(df: DataFrame, base: str, others: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation over rows where both are there; null below three rows or
    without spread (sample deviation <= 1e-12)."""
    out = []
    for c in others:
        both = F.col(base).isNotNull() & F.col(c).isNotNull()
        x, y = F.when(both, F.col(base)), F.when(both, F.col(c))
        ok = (F.count_if(both) >= 3) & (F.stddev_samp(x) > 1e-12) & (F.stddev_samp(y) > 1e-12)
        spread = F.stddev_samp(x) * F.stddev_samp(y)  # F.corr itself fails on a constant side under ANSI
        out.append(F.when(ok, F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0))).alias(f"corr_{c}"))
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def max_abs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Largest absolute value of each column, 1.0 when there is none."""
    return df.agg(*[F.coalesce(F.max(F.abs(F.col(c))), F.lit(1.0)).alias(c) for c in columns])


#: Ranges into which a ranking is cut.
RANGES = 64


def score_runs(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted score (missing counts 0) and rank, ties by run_id.

    One row a run. Scores are cut into ranges at approximate quantiles; a run's rank is its
    rank in its range plus the runs in the ranges above, so no task sorts all runs.
    """
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * v for c, v in weights.items()), F.lit(0.0))
    scored = df.withColumn("score", total)
    cuts = sorted(set(scored.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)])).first()[0] or []))  # at most RANGES numbers
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda x: F.col("score") < x)) if cuts else F.lit(0)
    scored = scored.withColumn("_range", above)
    counts = {r["_range"]: r["count"] for r in scored.groupBy("_range").count().collect()}  # at most RANGES rows
    before = {k: sum(n for j, n in counts.items() if j < k) for k in counts}
    start = F.coalesce(*[F.when(F.col("_range") == k, F.lit(n)) for k, n in before.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), "run_id"))
    return scored.withColumn("rank", (start + rank).cast("int")).drop("_range")


def nav_check(steps: DataFrame, perf: DataFrame, *, episode: str, log_return: str, tolerance: float = 1e-6) -> DataFrame:
    """Relative difference between an episode's multiple and the one its steps imply."""
    s = steps.groupBy(episode).agg(F.exp(F.sum(F.coalesce(F.col(log_return), F.lit(0.0)))).alias("steps_multiple"))
    d = perf.join(s, episode).withColumn("nav_gap", F.abs(F.col("nav_multiple") - F.col("steps_multiple")) / F.greatest(F.abs("steps_multiple"), F.lit(1e-12)))
    return d.withColumn("consistent", F.col("nav_gap") <= tolerance)
