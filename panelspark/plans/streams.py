"""Queries that run the streaming operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans.base import num, sql_num
from panelspark.streaming import events as ev

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def stream(spark, d):
    path = f"{d}/events.parquet"
    return ev.read_events(spark, path, spark.read.parquet(path).schema)


@query("SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS VARCHAR)[1:10] AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    x = ev.drain(ev.windowed_counts(stream(spark, d), ts="ts", key="event_type"), "counts", "complete")
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_of_key(spark, d):
    return ev.drain(ev.first_of_key(stream(spark, d).select("user_id", "ts"), ts="ts", keys=["user_id"], late="400 days"), "first").select("user_id").distinct()


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    x = ev.drain(ev.session_counts(stream(spark, d).select("user_id", "ts"), ts="ts", key="user_id", gap="6 hours"), "sessions", "complete")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query(f"""WITH z AS (SELECT event_type, event_id, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-12) AS z FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
SELECT event_type, event_id, {sql_num('CASE WHEN abs(z) < 1e-7 THEN 0 ELSE z END', 'z')} FROM z""")
def stream_running_zscore(spark, d):
    x = ev.drain(ev.running_zscore(stream(spark, d).select("event_type", "event_id", "value"), key="event_type", order="event_id", value="value"), "zscore")
    return x.select("event_type", "event_id", num(F.when(F.abs("z") < 1e-7, 0.0).otherwise(F.col("z")), "z"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
