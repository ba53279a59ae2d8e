"""Rolling totals over trailing calendar periods, days without activity included.

Method: block decomposition. The days of an entity are cut into blocks as long as the
period. Prefix sums run from the start of each block and suffix sums to its end; the total
of the trailing period at day i is the prefix at i plus the suffix of the block before at
i - period + 1. Each day costs two additions whatever the period, and nothing is ever
subtracted, so no digits cancel. Everything is window functions after one shuffle by entity;
an entity has at most one row a day, so the size of a task is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], values: list[str], version: str) -> DataFrame:
    """One row per key: the one of the latest version. Of equal versions the larger values
    win. NaN becomes null. Runs before the shuffle as a partial aggregate."""
    number = lambda c: F.when(~F.isnan(c), F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
    packed = F.struct(*[number(c).alias(c) for c in values])
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_v"), packed.alias("_r"))).alias("_m"))
    return best.select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in values])


def trailing_totals(df: DataFrame, *, entity: str, day: str, version: str, anchor: str, values: list[str], periods: list[int]) -> DataFrame:
    """(entity, day, <value>_sum_<p>, <value>_avg_<p>, <value>_n_<p>...) for every calendar day.

    Days run from the entity's first to its last day with an ``anchor`` value; values
    outside that span still count in totals that reach back to them. NaN counts as null;
    a total or average without values is null, its count 0. Of rows with the same entity
    and day the latest ``version`` holds, exact duplicates count once. Rows without
    entity or day are left out; an entity without anchor gives no rows. Other columns are
    ignored.
    """
    src = df.select(F.col(entity).alias("e"), F.col(day).alias("day"), F.col(version).alias("ver"), *[F.col(v) for v in dict.fromkeys([anchor, *values])]).where("e IS NOT NULL AND day IS NOT NULL")
    vals = list(dict.fromkeys([anchor, *values]))
    bars = latest_rows(src, ["e", "day"], vals, "ver").repartition("e")
    whole, order = Window.partitionBy("e"), Window.partitionBy("e").orderBy("day")
    bars = bars.withColumn("next", F.lead("day").over(order)).withColumn("prev", F.lag("day").over(order))
    bars = bars.withColumn("first", F.min(F.when(F.col(anchor).isNotNull(), F.col("day"))).over(whole)).withColumn("last", F.max(F.when(F.col(anchor).isNotNull(), F.col("day"))).over(whole)).where("first IS NOT NULL")
    pad = max(periods) - 1
    begin = F.when(F.col("prev").isNull(), F.date_sub("day", pad)).otherwise(F.col("day"))
    until = F.when(F.col("next").isNull(), F.greatest("day", "last")).otherwise(F.date_sub("next", 1))
    days = bars.withColumn("d", F.explode(F.sequence(begin, until)))
    days = days.select("e", F.col("d").alias("day"), "first", "last", *[F.when(F.col("d") == F.col("day"), F.col(v)).alias(v) for v in values])
    number = F.unix_date("day")
    for p in periods:
        days = days.withColumn(f"_b{p}", F.floor(number / p).cast("int"))
    add = {}
    for p in periods:
        up = Window.partitionBy("e", f"_b{p}").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("e", f"_b{p}").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
        for v in values:
            for tag, w in (("p", up), ("s", down)):
                add[f"_{tag}_{v}_{p}"] = F.sum(v).over(w)
                add[f"_{tag}n_{v}_{p}"] = F.count(v).over(w)
    days = days.select("*", *[c.alias(k) for k, c in add.items()])
    out = []
    for p in periods:
        closed = F.pmod(number, F.lit(p)) == p - 1  # the block is the period: its prefix is all
        for v in values:
            before = lambda c: F.when(closed, None).otherwise(F.lag(c, p - 1).over(order))
            head, tail = F.col(f"_p_{v}_{p}"), before(f"_s_{v}_{p}")
            total = F.when(head.isNull(), tail).when(tail.isNull(), head).otherwise(head + tail)
            n = F.col(f"_pn_{v}_{p}") + F.coalesce(before(f"_sn_{v}_{p}"), F.lit(0))
            out += [total.alias(f"{v}_sum_{p}"), (total / F.nullif(n, F.lit(0))).alias(f"{v}_avg_{p}"), n.alias(f"{v}_n_{p}")]
    res = days.select(F.col("e").alias(entity), F.col("day"), "first", "last", *out)
    return res.where(F.col("day").between(F.col("first"), F.col("last"))).drop("first", "last")
