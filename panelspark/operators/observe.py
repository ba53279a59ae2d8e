"""Observations, their checks, and a synthetic panel; older indicator set; reshapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.indicators import frame
from panelspark.operators.panel import gauss_rank


def observations(df: DataFrame, *, period: str, entity: str, technical: list[str], ranked: list[str], text: list[str], market: list[str], window: int = 26, history: int = 8, clip: float = 5.0) -> DataFrame:
    """Per period the arrays a policy sees.

    ``technical`` columns are z-scores of the entity's last ``window`` periods with their
    last ``history`` values (zeros until there are as many), ``ranked`` ones Gaussian ranks
    of the period, ``text`` ones as given (null 0), all clipped to +-clip; entities stand
    in order of name. ``market`` columns are one value a period. Only periods after the
    warm-up of window + history - 2 come out.
    """
    w = Window.partitionBy(entity).orderBy(period)
    back, past = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(history - 1), 0)
    cut = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce(c, F.lit(0.0))))
    d = df.withColumn("_no", F.row_number().over(w))
    for c in technical:
        d = d.withColumn(f"_z_{c}", cut((F.col(c) - F.avg(c).over(back)) / (F.stddev_pop(c).over(back) + 1e-12)))
        d = d.withColumn(f"_h_{c}", F.collect_list(f"_z_{c}").over(past))
    for c in ranked:
        d = gauss_rank(d, period=period, entity=entity, value=c, out=f"_g_{c}")
    hist = F.flatten(F.array(*[F.concat(F.array_repeat(F.lit(0.0), history - F.size(f"_h_{c}")), F.col(f"_h_{c}")) for c in technical]))
    one = F.struct(F.col(entity).alias("e"), hist.alias("trading"), F.array(*[cut(F.col(f"_g_{c}")) for c in ranked], *[cut(F.col(c).cast("double")) for c in text]).alias("valuation"))
    g = d.where(F.col("_no") > window + history - 2).groupBy(period).agg(F.array_sort(F.collect_list(one)).alias("o"), *[F.max(c).cast("double").alias(c) for c in market])
    return g.select(period, F.transform("o", lambda x: x["e"]).alias("entities"), F.transform("o", lambda x: x["trading"]).alias("trading"), F.transform("o", lambda x: x["valuation"]).alias("valuation"), F.array(*[cut(F.col(c)) for c in market]).alias("market"))


def numeric_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the numbers of nulls, NaNs and infinities, in one pass."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out += [F.count_if(x.isNull()).alias(f"{c}_null"), F.count_if(F.isnan(x)).alias(f"{c}_nan"), F.count_if(x.isin(float("inf"), float("-inf"))).alias(f"{c}_inf")]
    return df.agg(*out)


def synthetic_panel(spark: SparkSession, *, periods: int, entities: list[str], technical: list[str], seed: int = 0) -> DataFrame:
    """(day_idx, ticker, close, columns...): random walks; the same seed gives the same
    panel on any cluster, because every number is a hash of its place."""
    grid = spark.range(periods).withColumn("ticker", F.explode(F.array(*[F.lit(e) for e in entities])))
    u = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id", "ticker"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda tag: F.sqrt(-2 * F.log(u(tag + "a"))) * F.cos(2 * 3.141592653589793 * u(tag + "b"))
    w = Window.partitionBy("ticker").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    d = grid.withColumn("close", 50 * F.exp(F.sum(normal("p") * 0.02).over(w)))
    return d.select(F.col("id").cast("int").alias("day_idx"), "ticker", "close", *[normal(c).alias(c) for c in technical])


def older_indicators(df: DataFrame, short: int = 30, long: int = 60) -> DataFrame:
    """Simple averages, bands of 20 days, and the commodity channel index: distance of
    the typical price from its mean over 0.015 times its mean absolute deviation."""
    out = df.withColumn("sma_short", F.avg("close").over(frame(short))).withColumn("sma_long", F.avg("close").over(frame(long)))
    mid, dev = F.avg("close").over(frame(20)), F.stddev_samp("close").over(frame(20))
    out = out.withColumn("boll_ub", mid + 2 * dev).withColumn("boll_lb", mid - 2 * dev)
    out = out.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumn("_m", F.avg("_tp").over(frame(short))).withColumn("_l", F.collect_list("_tp").over(frame(short)))
    mad = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / F.nullif(F.size("_l"), F.lit(0))
    return out.withColumn("cci", F.when(mad > 1e-12, (F.col("_tp") - F.col("_m")) / (0.015 * mad))).drop("_tp", "_m", "_l")


def pivot_wide(df: DataFrame, *, period: str, entity: str, value: str, entities: list[str]) -> DataFrame:
    """One column per entity of a fixed list, so no pass is needed to find them."""
    return df.groupBy(period).pivot(entity, entities).agg(F.first(value, ignorenulls=True))


def resample_friday(df: DataFrame, *, day: str = "date") -> DataFrame:
    """Weekly bars of Saturday-to-Friday weeks labelled by the Friday."""
    w = df.withColumn("week", F.next_day(F.date_sub(day, 1), "FR"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(day))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(day))).alias(c)
    return w.groupBy("ticker", "week").agg(first("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close"), F.sum("volume").alias("volume"))


def history_rows(df: DataFrame, columns: list[str], *, by: str, order: str, k: int = 6) -> DataFrame:
    """``history``: the entity's last k rows, oldest first, as an array of structs."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(k - 1), 0)
    return df.withColumn("history", F.collect_list(F.struct(order, *columns)).over(w))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every double, also inside arrays, rounded half-even; NaN and infinities null."""
    def fix(c: Column, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), F.bround(c, digits))
        if kind.startswith("array<"):
            return F.transform(c, lambda x: fix(x, kind[6:-1]))
        return c

    return df.select(*[fix(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes])


def union_named(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns are matched by name and filled with null where one lacks them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_union(frames: list[DataFrame], column: str) -> DataFrame:
    """Distinct keys over all frames."""
    return reduce(lambda a, b: a.union(b), [f.select(column) for f in frames]).where(F.col(column).isNotNull()).distinct()


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U3."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U4, J12."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def heatmap(df: DataFrame, weights: str, share: float = 0.99) -> DataFrame:
    """(row columns..., position, weight, shade): weights cut at a percentile of all
    positive ones, a scalar subquery."""
    long = df.select(*[c for c in df.columns if c != weights], F.posexplode(weights).alias("position", "weight"))
    cap = long.where("weight > 0").agg(F.percentile("weight", F.lit(share))).scalar()
    return long.withColumn("shade", F.least(F.col("weight"), cap))


