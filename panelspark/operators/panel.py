"""Complete (entity, week) panels: coverage, keys, merges and cross-source features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The same frame, or one error that names every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def base_panel(weeks: DataFrame, entities: DataFrame) -> DataFrame:
    """Every week for every entity. The weeks are a calendar, small by nature: they are one
    array, which each entity unfolds where it is."""
    calendar = weeks.agg(F.collect_set(F.struct(*weeks.columns))).scalar()
    return entities.distinct().withColumn("_weeks", calendar).select(*entities.columns, F.inline("_weeks"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (descending tiebreaks included)."""
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*keys, *rest)


def attach(panel: DataFrame, facts: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join on the keys; misses and nulls get typed defaults. Facts must be
    unique by key. Columns of ``panel`` with the same name are replaced."""
    cols = list(defaults)
    out = panel.drop(*[c for c in cols if c not in on]).join(facts.select(*on, *cols), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(facts.schema[c].dataType)) for c, v in defaults.items()})


def merge_back(panel: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """The panel with the columns of ``facts`` joined on the keys; of columns that both have
    the facts' are kept. Facts must be unique by key; rows without a match get null."""
    new = [c for c in facts.columns if c not in on]
    return panel.drop(*new).join(facts, on, "left")


def market_fill(df: DataFrame, *, day: str, columns: list[str]) -> DataFrame:
    """Series that belong to the market as a whole, one value a day, carried forward over
    days without one and joined to every row. A day's value is its largest; days before the
    first value get null. The carrying runs over the distinct days, which the calendar bounds."""
    days = df.where(F.col(day).isNotNull()).groupBy(day).agg(*[F.max(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in columns])
    order = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(day, *[F.last(c, ignorenulls=True).over(order).alias(c) for c in columns])
    return merge_back(df, days, [day])


def coverage(df: DataFrame, *, period: str, entity: str, universe: DataFrame) -> DataFrame:
    """Per period the number of universe members present, those missing, and
    whether all are there. universe: one column, a list the caller keeps small."""
    u = universe.select(F.col(universe.columns[0]).alias(entity)).distinct()
    # the universe is one array, a scalar subquery: its size is the caller's list
    everyone = u.agg(F.array_sort(F.collect_set(entity))).scalar()
    got = df.join(u, entity, "left_semi").groupBy(period).agg(F.collect_set(entity).alias("_have"))
    got = df.select(period).distinct().join(got, period, "left").withColumn("_all", everyone)
    missing = F.array_except("_all", F.coalesce("_have", F.array().cast("array<string>")))
    return got.select(period, (F.size("_all") - F.size(missing)).alias("n_present"), F.array_sort(missing).alias("missing"), (F.size(missing) == 0).alias("complete"))


def dense_index(df: DataFrame, period: str, out: str = "day_idx") -> DataFrame:
    """0, 1, 2, ... by period. The index is made on the distinct periods and joined
    back, so the facts are never sorted in one task."""
    idx = df.select(period).distinct().where(F.col(period).isNotNull()).withColumn(out, F.row_number().over(Window.orderBy(period)) - 1)
    return df.join(idx, period, "left")


def drop_unlabeled(df: DataFrame, entity: str, value: str) -> DataFrame:
    """P10: without entities whose value is null in every row."""
    good = df.where(F.col(value).isNotNull()).select(entity).distinct()
    return df.join(good, entity, "left_semi")


def mask_features(df: DataFrame, scale: dict[str, float]) -> DataFrame:
    """Factor 0 gives 0.0, factor 1 leaves a column as it is, others scale it with
    nulls as 0."""
    made = {c: F.lit(0.0) if f == 0 else F.coalesce(F.col(c), F.lit(0.0)) * f for c, f in scale.items() if f != 1}
    return df.withColumns(made)


def overlap_check(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Rows with the same key in both and, per column, how many disagree.

    Numbers agree when |a - b| <= atol + rtol |b|, everything else when equal; null agrees
    with null only. NaN counts as null.
    """
    kinds = dict(a.dtypes)
    x, y = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]), b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = x.join(y, keys)

    def differs(c: str) -> Column:
        p, q = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if kinds[c] in ("double", "float"):
            p, q = F.nanvl(p, F.lit(None)), F.nanvl(q, F.lit(None))
            near = F.coalesce(F.abs(p - q) <= atol + rtol * F.abs(q), p.isNull() & q.isNull())
            return ~near
        return ~p.eqNullSafe(q)

    return both.agg(F.count("*").alias("n_common"), *[F.coalesce(F.sum(differs(c).cast("long")), F.lit(0)).alias(f"diff_{c}") for c in columns])


def merge_agreeing(market: DataFrame, extra: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Market rows with the other side's new columns. Shared columns must agree (strict
    raises with the counts); the market's values are kept either way. Both sides must be
    unique by key."""
    shared = [c for c in extra.columns if c in market.columns and c not in keys]
    if strict and shared:
        bad = {k: v for k, v in overlap_check(market, extra, keys, shared).first().asDict().items() if k.startswith("diff_") and v}
        if bad:
            raise ValueError(f"columns disagree: {bad}")
    return market.join(extra.drop(*shared), keys, "left")


def source_features(df: DataFrame, *, at: str, event_times: dict[str, str], signals: list[str]) -> DataFrame:
    """Whole days since each event (floor), number of sources with a signal, and whether
    signals disagree in sign.

    Sources count by non-null signals, which is the documented intent; counting after
    zeros were filled in would always give all of them.
    """
    out = df.withColumns({f"days_since_{n}": F.floor((F.col(at) - F.col(c)) / 86400) for n, c in event_times.items()})
    present = reduce(lambda p, q: p + q, [F.col(s).isNotNull().cast("int") for s in signals])
    up = reduce(lambda p, q: p | q, [F.coalesce(F.col(s) > 0, F.lit(False)) for s in signals])
    down = reduce(lambda p, q: p | q, [F.coalesce(F.col(s) < 0, F.lit(False)) for s in signals])
    return out.withColumn("n_sources", present).withColumn("sign_disagreement", up & down)


def resume_keys(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: keys without a row in the existing output."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def group_scale(train: DataFrame, df: DataFrame, *, by: str, value: str) -> DataFrame:
    """Robust scaling with the median and interquartile range of the training rows."""
    q = train.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("_med"), F.percentile(value, F.lit(0.75)).alias("_hi"), F.percentile(value, F.lit(0.25)).alias("_lo"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(q, by, "left").withColumn("scaled", (F.col(value) - F.col("_med")) / F.when(span == 0, F.lit(1.0)).otherwise(span)).drop("_med", "_hi", "_lo")


def adjust_prices(df: DataFrame) -> DataFrame:
    """Split and dividend adjustment. The ratio adjusted/raw close (1 when raw is 0) scales
    open, high and low; close becomes the adjusted one; all four and volume round half-even
    to four decimals."""
    k = F.when(F.col("close") == 0, F.lit(1.0)).otherwise(F.col("adj_close") / F.col("close"))
    made = {c: F.bround(F.col(c) * k, 4) for c in ("open", "high", "low")}
    return df.withColumns({**made, "close": F.bround("adj_close", 4), "volume": F.bround("volume", 4)})


def gauss_rank(df: DataFrame, *, period: str, entity: str, value: str, out: str = "gauss") -> DataFrame:
    """Normal quantile of (rank + 1) / (N + 1) within each period; ordinal ranks from 0,
    ties by entity. Null values are ranked first, as smallest.

    The quantile is a rational approximation in built-in arithmetic, so it stays in the JVM.
    """
    w = Window.partitionBy(period)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).asc_nulls_first(), entity))).withColumn("_n", F.count(F.lit(1)).over(w))
    p = F.col("_r") / (F.col("_n") + 1)
    return d.withColumn(out, normal_quantile(p)).drop("_r", "_n")


# Coefficients of a published rational approximation of the normal quantile.
_CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function for 0 < p < 1, to about 1e-9 relative."""
    horner = lambda cs, x: reduce(lambda a, c: a * x + c, [F.lit(c) for c in cs[1:]], F.lit(cs[0]))
    q = p - 0.5
    centre = q * horner(_CENTRE_NUM, q * q) / horner(_CENTRE_DEN, q * q)
    tail = lambda x: horner(_TAIL_NUM, F.sqrt(-2 * F.log(x))) / horner(_TAIL_DEN, F.sqrt(-2 * F.log(x)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(centre)


def normal_quantile_sql(p: str) -> str:
    """The same expression as ANSI SQL."""
    horner = lambda cs, x: reduce(lambda a, c: f"({a} * ({x}) + ({c!r}))", cs[1:], f"({cs[0]!r})")
    q = f"(({p}) - 0.5)"
    t = lambda x: f"sqrt(-2 * ln({x}))"
    tail = lambda x: f"{horner(_TAIL_NUM, t(x))} / {horner(_TAIL_DEN, t(x))}"
    return f"CASE WHEN ({p}) < 0.02425 THEN {tail(p)} WHEN ({p}) > 1 - 0.02425 THEN -({tail(f'(1 - ({p}))')}) ELSE {q} * {horner(_CENTRE_NUM, f'{q}*{q}')} / {horner(_CENTRE_DEN, f'{q}*{q}')} END"
