"""Source tiers, article scores and budgeted selections.

Selections that walk a list are order-dependent, so every walk has a full tie order. Before a
walk a group is cut to what the walk could possibly reach, by an exact argument given at each
operator; this bounds the group whatever the input holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import ship_package


def source_tiers(df: DataFrame, source: str = "source") -> DataFrame:
    """(source, n, source_tier, source_score): terciles of sources by row count.

    Ordered by count descending and name; the first third is A (3), then B (2), C (1).
    Ranked over one row per source, never over the articles.
    """
    counts = df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    t = F.ntile(3).over(Window.orderBy(F.desc("n"), "source"))
    out = counts.withColumn("_t", t)
    return out.select("source", "n", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("_t")).alias("source_tier"), (4 - F.col("_t")).alias("source_score"))


def attach_tiers(df: DataFrame, tiers: DataFrame, source: str = "source") -> DataFrame:
    """Articles with tier and score of their source; a null or unknown source is C (1)."""
    t = tiers.select(F.col("source").alias("_s"), "source_tier", "source_score")
    out = df.drop("source_tier", "source_score").join(t, F.col(source) == F.col("_s"), "left").drop("_s")
    return out.withColumn("source_tier", F.coalesce("source_tier", F.lit("C"))).withColumn("source_score", F.coalesce("source_score", F.lit(1)))


def source_whitelist(df: DataFrame, share: float = 0.15, source: str = "source") -> DataFrame:
    """The floor(share * n_sources) largest sources, ties by name."""
    counts = df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "source")
    ranked = counts.withColumn("rank", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    return ranked.where(F.col("rank") <= F.floor(F.col("_all") * share)).select("source", "n", "rank")


def whitelist_context(df: DataFrame, whitelist: DataFrame, *, group: list[str], ts: str, item: str, most: int) -> DataFrame:
    """Per group the newest whitelisted articles first, then the newest others, at most
    ``most``. Ties go to the smaller item."""
    w = Window.partitionBy(*group).orderBy(F.desc("listed"), F.desc(ts), item)
    white = whitelist.select(F.col("source").alias("_s"), F.lit(True).alias("_w"))
    out = df.join(white, df["source"] == F.col("_s"), "left").withColumn("listed", F.coalesce("_w", F.lit(False))).drop("_s", "_w")
    return out.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def score_v1(df: DataFrame, *, group: list[str], ts: str, end: str, length: str, src_score: str, weights: tuple[float, float, float] = (0.5, 0.2, 0.3), half_life_days: float = 7.0) -> DataFrame:
    """T4: adds ``rec`` and ``score`` = recency half-life + min-max length + source score / 3.
    Rows with a null group column are left out."""
    age = F.greatest(F.col(end) - F.col(ts), F.lit(0)) / 86400.0
    n = F.coalesce(F.col(length).cast("double"), F.lit(0.0))
    # the range comes from a partial aggregate and a join, so a hot group fills no task
    span_of = df.groupBy(*group).agg(F.min(n).alias("_lo"), F.max(n).alias("_hi"))
    d = df.join(span_of, group).withColumn("rec", F.exp(-math.log(2) * age / half_life_days))
    span = F.when(F.col("_hi") <= F.col("_lo") + 1e-12, F.lit(1.0)).otherwise((n - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    src = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(src_score).cast("double"), F.lit(1.0)) / 3))
    return d.withColumn("score", weights[0] * F.col("rec") + weights[1] * span + weights[2] * src).drop("_lo", "_hi")


def score_v2(*, tier: Column, n_chars: Column, ts: Column, end: Column, half_life_hours: float = 72.0, length_ref: int = 256) -> Column:
    """Tier weight + 0.5 * capped length + half-life recency (0 without time)."""
    tw = F.when(tier == "A", 1.0).when(tier == "B", 0.8).otherwise(0.6)
    length = F.least(F.coalesce(n_chars, F.lit(0)) / float(length_ref), F.lit(2.0))
    rec = F.coalesce(F.pow(F.lit(0.5), F.greatest(end - ts, F.lit(0)) / (half_life_hours * 3600)), F.lit(0.0))
    return tw + 0.5 * length + rec


def cap_select(df: DataFrame, *, group: list[str], source: str, day: str, item: str, order: list[str], per_source: int, per_day: int) -> DataFrame:
    """T5: (group..., picked): a walk in falling ``order`` (ties by item) that skips an item
    whose source or day is full; skipped items fill nothing.

    ``picked`` is the array of chosen items with rank, source, day and the order columns.
    An item below the best min(caps) of its own (source, day) can't be chosen: each one
    above it was chosen or met a full cap. So a group is cut to these first, by a ranking
    that runs before the group is gathered. The walk is a fold inside the JVM.
    """
    src = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")
    d = df.select(*group, src, F.col(day).cast("string").alias("day"), *order, F.col(item).alias("item"))
    falling = [F.desc(c) for c in order] + [F.asc("item")]
    cell = Window.partitionBy(*group, "source", "day").orderBy(*falling)
    d = d.withColumn("_r", F.row_number().over(cell)).where(F.col("_r") <= min(per_source, per_day))
    fields = F.struct("source", "day", *order, "item")
    walk = F.array_sort(F.collect_list(fields), lambda a, b: _compare(a, b, order))
    g = d.groupBy(*group).agg(walk.alias("walk"))
    kind = g.schema["walk"].dataType.simpleString()
    room = lambda acc, x, f, cap: F.size(F.filter(acc, lambda p: p[f] == x[f])) < cap
    fold = F.aggregate("walk", F.array().cast(kind), lambda acc, x: F.when(room(acc, x, "source", per_source) & room(acc, x, "day", per_day), F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(*group, fold.alias("picked"))


def _compare(a: Column, b: Column, order: list[str]) -> Column:
    c = F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)
    for f in reversed(order):
        c = F.when(a[f] > b[f], -1).when(a[f] < b[f], 1).otherwise(c)
    return c


def dynamic_top(picked: DataFrame, *, group: list[str], n_min: int = 3, n_max: int = 12, tau: float = 10.0, min_score: float = 0.3) -> DataFrame:
    """(group..., rank, item, score): the number kept grows with the number of candidates
    and saturates; below ``n_min`` good ones the best ``n_min`` come without threshold.
    Rounding is half-even."""
    c = F.size("picked")
    n = F.greatest(F.lit(n_min), F.least(F.lit(n_max), F.bround(n_min + (n_max - n_min) * (1 - F.exp(-c / F.lit(tau)))).cast("int")))
    good = F.filter("picked", lambda p: p["score"] >= min_score)
    kept = F.when(F.size(good) < n_min, F.slice("picked", 1, n_min)).otherwise(F.slice(good, F.lit(1), n))
    out = picked.select(*group, F.posexplode(kept).alias("rank", "p"))
    return out.select(*group, (F.col("rank") + 1).alias("rank"), F.col("p.item").alias("item"), F.col("p.score").alias("score"))


def budget_walk(part: pd.DataFrame, per_day: int, most: int, max_chars: int) -> list[object]:
    """Items chosen by the two-phase walk over one group: best per day in order of days, then
    the best of the rest. An item that overflows the budget is skipped; the first always fits."""
    chosen: list[object] = []
    used = 0
    rows = list(part[["day", "score", "ts", "item", "cost"]].itertuples(index=False))
    days = sorted({r.day for r in rows})
    taken: set[object] = set()
    best = lambda rs: sorted(rs, key=lambda r: (-r.score, -r.ts, r.item))
    for d in days:
        if used >= max_chars or len(chosen) >= most:
            break
        n = 0
        for r in best([r for r in rows if r.day == d]):
            if n >= per_day or len(chosen) >= most:
                break
            if used and used + r.cost > max_chars:
                continue
            chosen.append(r.item)
            taken.add(r.item)
            used += r.cost
            n += 1
    for r in best([r for r in rows if r.item not in taken]):
        if used >= max_chars or len(chosen) >= most:
            break
        if used and used + r.cost > max_chars:
            continue
        chosen.append(r.item)
        used += r.cost
    return chosen


def budgeted_context(df: DataFrame, *, group: list[str], day: str, score: str, ts: str, item: str, n_chars: str, per_day: int = 3, most: int = 20, max_chars: int = 12000, per_article: int | None = None) -> DataFrame:
    """(group..., item, pick_no) of the articles a weekly context holds, by time.
    per_article: length beyond which an article costs no more, for contexts that cut it there.

    Of articles of one day and one (capped) length only the best ``most`` can be chosen:
    when a better one of equal length was skipped for lack of room, room only shrank
    since. This cut bounds a group at days x lengths x ``most`` before it is gathered.
    """
    ship_package(df.sparkSession)
    d = df.select(*group, F.col(day).cast("string").alias("day"), F.col(score).cast("double").alias("score"), F.col(ts).cast("long").alias("ts"), F.col(item).alias("item"), (F.least(F.col(n_chars), F.lit(per_article)) if per_article else F.col(n_chars)).cast("long").alias("cost")).dropna()
    # above the budget all lengths are alike: such an item can only be the first
    w = Window.partitionBy(*group, "day", F.least("cost", F.lit(max_chars + 1))).orderBy(F.desc("score"), F.desc("ts"), "item")
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = budget_walk(part, per_day, most, max_chars)
        got = part[part["item"].isin(names)].sort_values(["ts", "item"])
        return pd.DataFrame({**{g: got[g] for g in group}, "item": got["item"], "pick_no": range(1, len(got) + 1)})

    head = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return d.groupBy(*group).applyInPandas(run, f"{head}, item {df.schema[item].dataType.simpleString()}, pick_no int")


def numbered_chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """``chunk`` = running groups of ``size`` by order, over a small list."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))


def top_by_size(weights: str, k: int) -> Column:
    """The k entries of an array of largest absolute value, largest first."""
    return F.slice(F.array_sort(F.col(weights), lambda a, b: F.when(F.abs(a) > F.abs(b), -1).when(F.abs(a) < F.abs(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))), 1, k)


# ------------------------------------------------------------ universe selection


def liquidity(df: DataFrame, *, entity: str, close: str, volume: str) -> DataFrame:
    """Mean traded capital per entity."""
    return df.groupBy(entity).agg(F.avg(F.col(close) * F.col(volume)).alias("capital"))


def liquid_enough(df: DataFrame, value: str = "capital", share: float = 0.2) -> DataFrame:
    """Rows at or above the ``share`` percentile, a scalar subquery."""
    cut = df.agg(F.percentile(value, F.lit(share))).scalar()
    return df.where(F.col(value) >= cut)


def sector_allocation(df: DataFrame, *, entity: str, sector: str, capital: str, size: int) -> DataFrame:
    """``size`` entities, seats by sector in proportion to its members (largest remainder,
    ties by sector name), filled by capital. Seats are counted on one row per sector."""
    whole = Window.partitionBy(F.lit(1))
    seats = df.groupBy(sector).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(whole))
    seats = seats.withColumn("_ideal", F.col("_n") * size / F.col("_all")).withColumn("_floor", F.floor("_ideal"))
    seats = seats.withColumn("_left", size - F.sum("_floor").over(whole)).withColumn("_r", F.row_number().over(whole.orderBy(F.desc(F.col("_ideal") - F.col("_floor")), sector)))
    seats = seats.select(sector, (F.col("_floor") + (F.col("_r") <= F.col("_left")).cast("int")).alias("seats"))
    w = Window.partitionBy(sector).orderBy(F.desc(capital), entity)
    return df.join(seats, sector).withColumn("seat", F.row_number().over(w)).where(F.col("seat") <= F.col("seats"))


def top_diversified(df: DataFrame, *, entity: str, sector: str, capital: str, top_n: int, size: int) -> DataFrame:
    """The ``top_n`` by capital, then the best of each sector not yet there, then the
    best of the rest, up to ``size``; ``pick`` numbers them. Ties by entity.

    Only entities that could be chosen are ranked together: the first ``size`` overall and
    the first of each sector, found by partial top-k and per-sector ranking.
    """
    best = Window.partitionBy(sector).orderBy(F.desc(capital), entity)
    heads = df.withColumn("_s", F.row_number().over(best)).where("_s = 1").drop("_s")
    firsts = df.orderBy(F.desc(capital), entity).limit(size)
    pool = firsts.unionByName(heads).distinct()
    w = Window.orderBy(F.desc(capital), entity)
    pool = pool.withColumn("_r", F.row_number().over(w)).withColumn("_top", F.col("_r") <= top_n)
    pool = pool.withColumn("_seen", F.max(F.col("_top")).over(Window.partitionBy(sector))).withColumn("_first", F.row_number().over(Window.partitionBy(sector, "_top").orderBy("_r")))
    phase = F.when(F.col("_top"), 0).when(~F.col("_seen") & (F.col("_first") == 1), 1).otherwise(2)
    out = pool.withColumn("phase", phase).withColumn("pick", F.row_number().over(Window.orderBy("phase", "_r")))
    return out.where(F.col("pick") <= size).drop("_r", "_top", "_seen", "_first")


def with_benchmark(df: DataFrame, entity: str, name: str = "SPY") -> DataFrame:
    """One more row for the benchmark, other columns null."""
    extra = df.sparkSession.createDataFrame([(name,)], f"`{entity}` string")
    return df.unionByName(extra, allowMissingColumns=True)
