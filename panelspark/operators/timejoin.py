"""Point-in-time joins: calendar windows, backward as-of, lookback picks, rollback.

No join here compares every pair of rows. Time is cut into blocks, joins are equalities on
(entity, block), and what crosses a block border is carried by one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch(c: str | Column) -> Column:
    """Whole seconds of a timestamp, with or without zone (then UTC is meant)."""
    return F.floor(F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) / 1_000_000)


def assign_windows(df: DataFrame, windows: DataFrame, *, ts: str, start: str, end: str, by: list[str] | None = None, closed_left: bool = False, block_s: int = 7 * 86400) -> DataFrame:
    """Rows of ``df`` with the columns of each window that holds them.

    start, end and ts are seconds. A window is (start, end], or [start, end] with
    closed_left: then a row on a shared border belongs to both windows. Windows are put
    into every block they touch and joined by equality of (by, block), so a row meets
    only the windows of its own block. Null times fall out; rows outside all windows too.
    """
    keys = by or []
    w = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    w = w.withColumn("_blk", F.explode(F.sequence(F.floor(F.col(start) / block_s), F.floor(F.col(end) / block_s))))
    d = df.where(F.col(ts).isNotNull()).withColumn("_blk", F.floor(F.col(ts) / block_s))
    inside = (d[ts] >= w[start] if closed_left else d[ts] > w[start]) & (d[ts] <= w[end])
    cond = [d[k] == w[k] for k in keys] + [d["_blk"] == w["_blk"], inside]
    return d.join(w, cond).select(*[d[c] for c in d.columns if c != "_blk"], *[w[c] for c in w.columns if c != "_blk" and c not in keys])


def asof_backward(
    left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str, right_ts: str, values: list[str],
    tolerance_s: int | None = None, tie: list[str] | None = None, exact: bool = True, block_s: int = 30 * 86400, prefix: str = "",
) -> DataFrame:
    """All rows of ``left`` with the values of the latest right row at or before them.

    Adds prefix+value for each of ``values`` and prefix+"asof_ts". tolerance_s: rows
    staler than this don't count. exact: whether a right row of the same second counts.
    Of right rows of one second the one with the largest ``tie`` wins (values if not given).
    Left rows without match, key or time keep nulls and are never dropped. An entity may
    hold any share of the rows: work is split by (entity, block of time), and only one row
    per block crosses over.
    """
    order = tie or values
    payload = F.struct(F.col(right_ts).cast("long").alias("_at"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(order)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], payload.alias("_p")).where(" AND ".join(["_p._at IS NOT NULL", *[f"_k{i} IS NOT NULL" for i in range(len(by))]]))
    keys = [f"_k{i}" for i in range(len(by))]
    r = r.withColumn("_blk", F.floor(F.col("_p._at") / block_s))
    last = r.groupBy(*keys, "_blk").agg(F.max("_p").alias("_p"))
    lt = F.col(left_ts).cast("long")
    body = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], lt.alias("_ts"))
    body = body.withColumn("_blk", F.floor(F.col("_ts") / block_s))
    marks = body.select(*keys, "_blk").distinct().join(last, [*keys, "_blk"], "full")
    w = Window.partitionBy(*keys).orderBy("_blk")
    carried = marks.select(*keys, "_blk", F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    side = F.lit(0) if exact else F.lit(2)
    both = body.select("_row", *keys, "_ts", "_blk", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p")).unionByName(
        r.select(F.lit(None).cast(body.schema["_row"].dataType).alias("_row"), *keys, F.col("_p._at").alias("_ts"), "_blk", side.alias("_side"), "_p")
    )
    inner = Window.partitionBy(*keys, "_blk").orderBy("_ts", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_got", F.last("_p", ignorenulls=True).over(inner)).where("_side = 1")
    both = both.join(carried, [*keys, "_blk"], "left").withColumn("_got", F.coalesce("_got", "_carry"))
    if tolerance_s is not None:
        both = both.withColumn("_got", F.when(F.col("_ts") - F.col("_got._at") <= tolerance_s, F.col("_got")))
    return both.select("_row.*", *[F.col(f"_got._v{i}").alias(prefix + v) for i, v in enumerate(values)], F.col("_got._at").alias(f"{prefix}asof_ts"))


def lookback_pick(left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str, right_ts: str, values: list[str], narrow_s: int, wide_s: int, tie: list[str] | None = None) -> DataFrame:
    """Latest right row within ``narrow_s``, else within ``wide_s``; ``within_narrow`` says which.

    The latest row within the narrow window is also the latest within the wide one, so
    one as-of join does both.
    """
    got = asof_backward(left, right, by=by, left_ts=left_ts, right_ts=right_ts, values=values, tolerance_s=max(narrow_s, wide_s), tie=tie)
    return got.withColumn("within_narrow", F.when(F.col("asof_ts").isNotNull(), F.col(left_ts) - F.col("asof_ts") <= narrow_s))


def latest_per_kind(left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str, right_ts: str, kind: str, kinds: dict[str, int], values: list[str], tie: list[str] | None = None) -> DataFrame:
    """Array ``picks``: for each kind, in order, its latest right row within the kind's lookback."""
    out = left
    for k, back in kinds.items():
        out = asof_backward(out, right.where(F.col(kind) == k), by=by, left_ts=left_ts, right_ts=right_ts, values=values, tolerance_s=back, tie=tie, prefix=f"_{k}_")
    made = [F.when(F.col(f"`_{k}_asof_ts`").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"`_{k}_asof_ts`").alias("asof_ts"), *[F.col(f"`_{k}_{v}`").alias(v) for v in values])) for k in kinds]
    return out.select(*[F.col(f"`{c}`") for c in left.columns], F.array_compact(F.array(*made)).alias("picks"))


def membership_on(current: DataFrame, changes: DataFrame, *, member: str, ts: str, action: str, at: int, added: str = "add", tie: str | None = None) -> DataFrame:
    """Members at a past moment: the present list with later changes undone.

    For a member touched after ``at`` the earliest such change decides: it was absent if
    that change added it and present if it removed it. All others are as they are now.
    """
    later = changes.where(F.col(ts) > at).groupBy(F.col(member).alias("m")).agg(F.min_by(F.col(action), F.struct(F.col(ts), F.col(tie or action))).alias("first_action"))
    now = current.select(F.col(member).alias("m")).where("m IS NOT NULL").distinct().withColumn("now", F.lit(True))
    both = now.join(later, "m", "full")
    keep = F.when(F.col("first_action").isNull(), F.col("now")).otherwise(F.col("first_action") != added)
    return both.where(keep).select(F.col("m").alias(member))
