"""Pairing records with the nearest record in time of the same entity.

Method: both sides are united, sorted per entity and time; the last and the next
right-hand time are carried onto each left row; the nearer one within the tolerance
wins. So that no entity has to fit into one task, time is cut into blocks as long as the
tolerance: whatever lies within it of a left row is in the row's own block or in one of
the two beside it, so right-hand times are copied to three blocks and (entity, block) is
the unit of work. ``salts`` splits such a unit further where the right side is tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import timeshape
from panelspark.plans.times import SEC_SQL, times_sql
from panelspark.sources.tables import sec_times, table, ticker_key


def nearest_pairs(
    left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_time: str, right_time: str,
    entity: str | None, tolerance_s: int, salts: int = 1,
) -> DataFrame:
    """(left_id, right_id, distance_s): for each left row the nearest right row(s).

    Times are whole seconds since 1970. Distances up to ``tolerance_s`` inclusive count.
    Of right rows equally near (before and after, or of one instant) all are listed.
    Rows whose entity, time or id is null are out; repeated rows count once; an empty
    side gives no rows. Other columns of either side are ignored, so names can't clash.
    entity: column that both sides have; None: all rows are one entity.
    """
    who = F.col(entity) if entity else F.lit("")
    lhs = left.select(who.alias("e"), F.col(left_time).cast("long").alias("t"), F.col(left_id).cast("string").alias("l")).dropna().distinct()
    rhs = right.select(who.alias("e"), F.col(right_time).cast("long").alias("t"), F.col(right_id).cast("string").alias("r")).dropna().distinct()
    block = F.floor(F.col("t") / tolerance_s) if tolerance_s else F.col("t")
    near = rhs.select("e", "t").distinct().withColumn("b", F.explode(F.array(block - 1, block, block + 1)))
    near = near.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    both = lhs.withColumn("b", block).withColumn("z", F.pmod(F.xxhash64("l"), F.lit(salts)).cast("int"))
    both = both.select("e", "b", "z", "t", "l").unionByName(near.withColumn("l", F.lit(None).cast("string")).select("e", "b", "z", "t", "l"))
    both = both.withColumn("rt", F.when(F.col("l").isNull(), F.col("t"))).withColumn("side", F.col("l").isNotNull())
    unit = Window.partitionBy("e", "b", "z")
    # the right rows of an instant stand first in both directions, so equal times meet
    both = both.withColumn("before", F.last("rt", ignorenulls=True).over(unit.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.last("rt", ignorenulls=True).over(unit.orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.where("l IS NOT NULL").withColumn("near", F.least(F.col("t") - F.col("before"), F.col("after") - F.col("t"))).where(F.col("near") <= tolerance_s)
    hit = lambda c: F.when(F.abs(F.col("t") - F.col(c)) == F.col("near"), F.col(c))
    pairs = both.select("e", "l", "near", F.explode(F.array_distinct(F.array_compact(F.array(hit("before"), hit("after"))))).alias("t"))
    return pairs.join(rhs, ["e", "t"]).select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), F.col("near").alias("distance_s")).distinct()


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ec = table(spark, sf_dir, "ec", "ticker", "event_ts_utc", "doc_id")
    return ec.select(ticker_key().alias("k"), F.floor(F.unix_micros("event_ts_utc") / 1_000_000).alias("ts"), F.col("doc_id").alias("call_id"))


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = table(spark, sf_dir, "calendar", "curr_close_utc")
    return timeshape.normalise(cal, "curr_close_utc", zone="UTC", out="ts").select("ts", "curr_close_utc")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b")]


def filing_call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = sec_times(spark, sf_dir, "ticker", "doc_id").select(ticker_key().alias("k"), F.col("filed_s").alias("ts"), F.col("doc_id").alias("filing_id"))
    return nearest_pairs(filings, _calls(spark, sf_dir), left_id="filing_id", right_id="call_id", left_time="ts", right_time="ts", entity="k", tolerance_s=72 * 3600)


def call_week_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_pairs(_calls(spark, sf_dir), _weeks(spark, sf_dir), left_id="call_id", right_id="curr_close_utc", left_time="ts", right_time="ts", entity=None, tolerance_s=48 * 3600, salts=16)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = filing_call_pairs(spark, sf_dir).unionByName(call_week_pairs(spark, sf_dir))
    return both.select(*_pair(F.col("left_id"), F.col("right_id"))).distinct()


def queries() -> dict:
    return {"p1_found": p1_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {SEC_SQL}, {times_sql("sec_raw")},
times AS (SELECT DISTINCT rec_key, raw, s FROM known WHERE s IS NOT NULL),
f AS (SELECT DISTINCT nullif(upper(trim(x.ticker)), '') AS k, x.doc_id, t.s FROM sec x JOIN times t ON x.doc_id = t.rec_key AND x.filed_at_utc = t.raw),
c AS (SELECT DISTINCT nullif(upper(trim(ticker)), '') AS k, doc_id, CAST(floor(epoch_us(event_ts_utc) / 1000000) AS BIGINT) AS s FROM ec WHERE event_ts_utc IS NOT NULL),
fc AS (SELECT f.doc_id AS a, f.s AS fs, c.doc_id AS b, abs(f.s - c.s) AS d, min(abs(f.s - c.s)) OVER (PARTITION BY f.doc_id, f.s, f.k) AS m FROM f JOIN c ON f.k = c.k),
w AS (SELECT DISTINCT curr_close_utc AS id, CAST(epoch(CAST(curr_close_utc AS TIMESTAMPTZ)) AS BIGINT) AS s FROM calendar),
cw AS (SELECT c.doc_id AS a, w.id AS b, abs(c.s - w.s) AS d, min(abs(c.s - w.s)) OVER (PARTITION BY c.doc_id, c.s) AS m FROM c JOIN w ON w.s BETWEEN c.s - 172800 AND c.s + 172800)
SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM (SELECT a, b FROM fc WHERE d = m AND d <= 259200 UNION ALL SELECT a, b FROM cw WHERE d = m)"""
    }
