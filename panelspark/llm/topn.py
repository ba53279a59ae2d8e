"""The N best items of every group by statistics-guided skipping.

Method: the three columns that matter are written clustered by group. ``REBALANCE`` lets
AQE split a group that would overfill a file into several and merge small ones, so a hot
group never lands in one task. Within a file rows stand by group and falling score, in
row groups of a few thousand rows whose minimum and maximum of group and score Parquet
keeps. A task then takes one file: it reads its row groups in descending maximum score and
skips one when its maximum lies strictly below the current N-th score of every group it
contains. A row group of one group is judged by its statistics alone; where first and last
group are both full, the group column alone is read for the exact set. What the files
keep, at most N rows of each group and file, is merged by a last ranking.

What can be skipped follows from the data: of a group with many more rows than a row
group nearly everything is, of groups with about N rows nothing, because their rows are the
result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.plans.times import NEWS_SQL, times_sql
from panelspark.session import cut_lineage, drop_scratch, scratch_path, ship_package
from panelspark.sources.tables import news_times, ticker_key

#: Rows of a row group of the clustered file: few, so that skipping has a grain.
ROW_GROUP_ROWS = 4096


class ScanReport:
    """Row groups read and skipped by a call of ``top_n_per_group``."""

    def __init__(self, spark: SparkSession):
        self.read, self.skipped, self.files = (spark.sparkContext.accumulator(0) for _ in range(3))


def _scan_file(uri: str, n: int) -> tuple[pd.DataFrame, int, int]:
    """Best n rows of each group in a clustered file; row groups read and skipped."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    best: dict[str, dict[str, int]] = {}
    nth: dict[str, int] = {}
    read = skipped = 0
    with system.open_input_file(path) as handle:
        file = pq.ParquetFile(handle)
        at = {file.metadata.schema.column(i).name: i for i in range(len(file.metadata.schema))}
        stats = []
        for k in range(file.metadata.num_row_groups):
            g, s = (file.metadata.row_group(k).column(at[c]).statistics for c in ("grp", "score"))
            known = g is not None and g.has_min_max and s is not None and s.has_min_max
            stats.append((s.max if known else float("inf"), g.min if known else None, g.max if known else None, k))
        for top, low, high, k in sorted(stats, key=lambda x: (-x[0], x[3])):
            if low is not None and nth.get(low, top) > top and nth.get(high, top) > top:
                inside = (low,) if low == high else pc.unique(file.read_row_group(k, columns=["grp"])["grp"]).to_pylist()
                if all(nth.get(g, top) > top for g in inside):
                    skipped += 1
                    continue
            read += 1
            part = file.read_row_group(k, columns=["grp", "score", "item"]).to_pandas()
            part = part.sort_values(["grp", "score", "item"], ascending=[True, False, True], kind="stable").drop_duplicates(["grp", "item"])
            part = part[part.groupby("grp", sort=False).cumcount() < n]
            for grp, score, item in part.itertuples(index=False):
                own = best.setdefault(grp, {})
                own[item] = max(own.get(item, score), score)
            for grp in part["grp"].unique():
                own = best[grp]
                if len(own) > n:
                    own = best[grp] = dict(heapq.nsmallest(n, own.items(), key=lambda x: (-x[1], x[0])))
                if len(own) == n:
                    nth[grp] = min(own.values())
    rows = [(g, s, i) for g, own in best.items() for i, s in own.items()]
    return pd.DataFrame(rows, columns=["grp", "score", "item"]), read, skipped


def top_n_per_group(df: DataFrame, *, group: list[str], score: str, item: str, n: int, report: ScanReport | None = None) -> DataFrame:
    """(group..., rank_no, item, score): the n highest scores of each group.

    score: a whole number; rows with a null score, item or group column are out. Ties go
    to the smaller item. An item that repeats within a group counts once, by its best
    score. Groups with fewer than n items come out whole. Empty input: no rows. Other
    columns are ignored. The clustered file lies in the session's shared folder until the
    result, at most n rows a group, is checkpointed there. report: counts row groups.
    """
    spark = df.sparkSession
    ship_package(spark)
    sep = "\u0001"
    rows = df.select(F.concat_ws(sep, *[F.col(g).cast("string") for g in group]).alias("grp"), F.col(score).cast("long").alias("score"), F.col(item).cast("string").alias("item"), *[F.col(g).isNotNull().alias(f"ok{i}") for i, g in enumerate(group)])
    for i in range(len(group)):
        rows = rows.where(f"ok{i}").drop(f"ok{i}")
    rows = rows.dropna()
    path = scratch_path(spark, "topn")
    rows.hint("rebalance", "grp").sortWithinPartitions("grp", F.desc("score"), "item").write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).option("compression", "zstd").parquet(path)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for uri in part["uri"]:
                best, read, skipped = _scan_file(re.sub(r"^file:/+", "file:///", uri), n)
                if report is not None:
                    report.read.add(read)
                    report.skipped.add(skipped)
                    report.files.add(1)
                yield best

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("uri"))  # names only, no content
    kept = names.mapInPandas(scan, rows.schema)
    kept = kept.groupBy("grp", "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "item")
    kept = cut_lineage(kept.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n))
    drop_scratch(spark, path)
    parts = F.split("grp", sep)
    return kept.select(*[parts[i].cast(df.schema[g].dataType).alias(g) for i, g in enumerate(group)], "rank_no", "item", "score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = news_times(spark, sf_dir, "ticker", "doc_id", "source_tier")
    # the score orders tier A, B, C, null first and time second; times are below 2**40
    tier = F.when(F.col("source_tier") == "A", 3).when(F.col("source_tier") == "B", 2).when(F.col("source_tier") == "C", 1).otherwise(0)
    day = F.date_from_unix_date(F.floor(F.col("published_s") / 86400).cast("int")).cast("string")
    items = news.select(ticker_key().alias("ticker"), day.alias("cal_day"), (tier.cast("long") * (1 << 40) + F.col("published_s")).alias("score"), "doc_id")
    top = top_n_per_group(items, group=["ticker", "cal_day"], score="score", item="doc_id", n=3)
    return top.select("ticker", "cal_day", "rank_no", F.col("item").alias("doc_id"))


def queries() -> dict:
    return {"p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH {NEWS_SQL}, {times_sql("news_raw")},
times AS (SELECT DISTINCT rec_key, raw, s FROM known WHERE s IS NOT NULL),
rows AS (SELECT nullif(upper(trim(n.ticker)), '') AS ticker, n.doc_id, CASE n.source_tier WHEN 'A' THEN 3 WHEN 'B' THEN 2 WHEN 'C' THEN 1 ELSE 0 END AS t, k.s FROM news n JOIN times k ON n.doc_id = k.rec_key AND n.published_at_utc = k.raw),
days AS (SELECT ticker, strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS cal_day, doc_id, max(t * 1099511627776 + s) AS score FROM rows WHERE ticker IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, cal_day ORDER BY score DESC, doc_id) AS r FROM days)
SELECT ticker, cal_day, CAST(r AS INTEGER) AS rank_no, doc_id FROM ranked WHERE r <= 3"""
    }
