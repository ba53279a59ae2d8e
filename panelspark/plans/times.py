"""Queries of problem 6: mixed timestamp formats and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import timeshape
from panelspark.sources.tables import table, zone_names


NEW_YORK = "America/New_York"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four fields as one column of values, so each mask is looked up in one pass."""
    zones = table(spark, sf_dir, "source_zones").select(F.col("source").alias("sz_source"), "zone", "date_order").dropDuplicates(["sz_source"])
    names = zone_names(zones)
    news = table(spark, sf_dir, "news", "doc_id", "source", "published_at_utc").join(F.broadcast(zones), F.col("source") == F.col("sz_source"), "left")
    field = lambda df, name, key, date, zone=F.lit(NEW_YORK), dmy=F.lit(False): df.select(F.lit(name).alias("field_name"), F.col(key).alias("rec_key"), F.col(name.split(".")[1]).alias("raw"), zone.alias("zone"), dmy.alias("dmy"), F.lit(date).alias("is_date"))
    rows = (
        field(news, "news.published_at_utc", "doc_id", False, F.col("zone"), F.col("date_order") == "dmy")
        .unionByName(field(table(spark, sf_dir, "sec"), "sec.filed_at_utc", "doc_id", False))
        .unionByName(field(table(spark, sf_dir, "ec"), "ec.call_date", "doc_id", True))
        .unionByName(field(table(spark, sf_dir, "calendar"), "calendar.week_decision_date", "curr_close_utc", True))
    )
    rows = timeshape.normalise(rows, "raw", zone=F.col("zone"), zones=[*names, NEW_YORK], day_first=F.col("dmy"), out="s", local_date="day")
    value = F.when(F.col("is_date"), F.col("day").cast("string")).otherwise(timeshape.utc_text(F.col("s")))
    rows = rows.withColumn("norm_value", value).where(F.col("norm_value").isNotNull() & (F.col("norm_value") != F.col("raw")))
    return rows.select("field_name", "rec_key", "norm_value").distinct()


# The same normalisation as SQL, by other means: try_strptime over a list of formats.
_FORMATS = "'%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y%m%dT%H%M%S', '%d %b %Y %H:%M:%S', '%B %d, %Y, %H:%M', '%b %d, %Y %I:%M %p', '%Y-%m-%d', '%Y%m%d', '%Y-%j', '%G-W%V-%u', '%d-%b-%y', '%B %d, %Y', '%d %b %Y'"
_HOURS = " ".join(f"WHEN '{k}' THEN {v * 60}" for k, v in timeshape.ABBREVIATIONS.items())


def times_sql(source: str) -> str:
    """CTEs that end in ``known`` (field_name, rec_key, raw, s, day) for a CTE ``source`` of
    (field_name, rec_key, raw, zone, dmy)."""
    return f"""
t1 AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS v0 FROM {source}),
t2 AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN regexp_matches(v0, '^\\d{{4}}-\\d\\d-\\d\\dt') THEN upper(v0) ELSE v0 END, '(:\\d\\d)[.,]\\d+', '\\1'), '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ', '') AS v1 FROM t1),
t3 AS (SELECT *, regexp_extract(v1, '(?:\\d|[AP]M)( ?[A-Z]{{1,5}}| ?[+-]\\d\\d:?\\d\\d)$', 1) AS z0 FROM t2),
t4 AS (SELECT *, CASE WHEN trim(z0) IN ('AM', 'PM') OR regexp_matches(v1, '^\\d{{4}}-\\d\\d-\\d\\d$') OR NOT regexp_matches(v1, ':|T\\d') THEN '' ELSE z0 END AS z1 FROM t3),
t5 AS (SELECT *, trim(z1) AS z, trim(v1[1:length(v1) - length(z1)]) AS v FROM t4),
t6 AS (SELECT *, CASE WHEN regexp_matches(v, '^\\d{{9,10}}$') THEN CAST(v AS BIGINT) WHEN regexp_matches(v, '^\\d{{13}}$') THEN CAST(v AS BIGINT) // 1000 END AS e,
  CASE WHEN contains(v, '/') AND dmy THEN coalesce(try_strptime(v, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %I:%M %p']), try_strptime(v, '%d/%m/%Y'))
       WHEN contains(v, '/') THEN coalesce(try_strptime(v, ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %I:%M %p']), try_strptime(v, '%m/%d/%Y'))
       ELSE try_strptime(v, [{_FORMATS}]) END AS c FROM t5),
t7 AS (SELECT *, CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE z[1:1] WHEN '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INT) * 3600 + CAST(z[length(z) - 1:length(z)] AS INT) * 60) ELSE CASE z {_HOURS} END END AS off FROM t6),
t8 AS (SELECT *, CASE WHEN e > 0 THEN e WHEN e IS NOT NULL THEN NULL WHEN off IS NOT NULL THEN CAST(epoch(c) AS BIGINT) - off WHEN z = 'ET' THEN CAST(epoch(timezone('America/New_York', c)) AS BIGINT) WHEN z = '' THEN CAST(epoch(timezone(zone, c)) AS BIGINT) END AS s FROM t7),
known AS (SELECT field_name, rec_key, raw, s, CASE WHEN e IS NOT NULL OR z <> '' THEN CAST(timezone('America/New_York', to_timestamp(s)) AS DATE) ELSE CAST(c AS DATE) END AS day FROM t8)"""


NEWS_SQL = "news_raw AS (SELECT 'news.published_at_utc' AS field_name, n.doc_id AS rec_key, n.published_at_utc AS raw, z.zone AS zone, coalesce(z.date_order = 'dmy', false) AS dmy FROM news n LEFT JOIN source_zones z ON n.source = z.source)"
SEC_SQL = "sec_raw AS (SELECT 'sec.filed_at_utc' AS field_name, doc_id AS rec_key, filed_at_utc AS raw, 'America/New_York' AS zone, false AS dmy FROM sec)"


def queries() -> dict:
    return {"p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    rows = "ec_raw AS (SELECT 'ec.call_date' AS field_name, doc_id AS rec_key, call_date AS raw, 'America/New_York' AS zone, false AS dmy FROM ec), cal_raw AS (SELECT 'calendar.week_decision_date' AS field_name, curr_close_utc AS rec_key, week_decision_date AS raw, 'America/New_York' AS zone, false AS dmy FROM calendar)"
    union = "every AS (SELECT * FROM news_raw UNION ALL SELECT * FROM sec_raw UNION ALL SELECT * FROM ec_raw UNION ALL SELECT * FROM cal_raw)"
    value = "CASE WHEN field_name IN ('ec.call_date', 'calendar.week_decision_date') THEN CAST(day AS VARCHAR) ELSE strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') END"
    return {"p6_found": f"WITH {NEWS_SQL}, {SEC_SQL}, {rows}, {union}, {times_sql('every')}, o AS (SELECT field_name, rec_key, raw, {value} AS norm_value FROM known) SELECT DISTINCT field_name, rec_key, norm_value FROM o WHERE norm_value IS NOT NULL AND norm_value <> raw"}
