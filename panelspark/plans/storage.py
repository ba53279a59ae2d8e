"""Queries that write and read again: files, caches, run folders, step logs, merges.

Each goes over whole tables through a scratch path in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.texts import rough_tokens
from panelspark.operators import panel as pn
from panelspark.operators.splits import run_name, set_path
from panelspark.plans.base import BARS, bars, chain, day
from panelspark.session import scratch_path
from panelspark.sources import files
from panelspark.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_roundtrip(spark, d):
    path = scratch_path(spark, "parquet")
    files.write_parquet(table(spark, d, "orders"), path, by=["o_orderstatus"])
    return files.read_parquet(spark, path, columns=["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def append_resume(spark, d):
    """An output that a first run left half done is completed; what is there stays."""
    path, rows = scratch_path(spark, "append"), table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    files.append_missing(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), path, ["o_orderkey"])
    files.append_missing(rows.drop("o_orderstatus"), path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey")
def cached_result(spark, d):
    path = scratch_path(spark, "cached")
    build = lambda: table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    files.cached(spark, path, build)
    return files.cached(spark, path, lambda: build().where("false"))  # there already: not built again


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_roundtrip(spark, d):
    path, rows = scratch_path(spark, "csv"), table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    files.write_csv(rows, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return files.read_csv(spark, path, schema).drop("monitor_file")


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def jsonl_roundtrip(spark, d):
    path, rows = scratch_path(spark, "jsonl"), table(spark, d, "documents", "doc_id", "text", "lang", "n_chars")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema)


_KEY = "nullif(upper(trim(ticker)), '')"


@query(f"""WITH c AS (SELECT CAST(year(event_ts_utc) AS VARCHAR) AS week, {_KEY} AS ticker, count(*) AS n FROM ec WHERE event_ts_utc IS NOT NULL AND {_KEY} IS NOT NULL GROUP BY ALL),
f AS (SELECT CAST(year(filing_date) AS VARCHAR) AS week, {_KEY} AS ticker, count(*) AS n FROM sec WHERE filing_date IS NOT NULL AND {_KEY} IS NOT NULL GROUP BY ALL)
SELECT coalesce(c.week, f.week) AS week, coalesce(c.ticker, f.ticker) AS ticker, 0 AS n_news, CAST(coalesce(c.n, 0) AS INTEGER) AS n_calls, CAST(coalesce(f.n, 0) AS INTEGER) AS n_filings FROM c FULL JOIN f ON c.week = f.week AND c.ticker = f.ticker""")
def bundle_counts(spark, d):
    """Calls and filings of a company and year, nested in one document each."""
    key = F.nullif(F.upper(F.trim("ticker")), F.lit(""))
    calls = table(spark, d, "ec", "ticker", "event_ts_utc", "doc_id", "text").select(F.year("event_ts_utc").cast("string").alias("week"), key.alias("ticker"), "doc_id", "text").dropna(subset=["week", "ticker"])
    filings = table(spark, d, "sec", "ticker", "filing_date", "doc_id", "form_type").select(F.year("filing_date").cast("string").alias("week"), key.alias("ticker"), "doc_id", "form_type").dropna(subset=["week", "ticker"])
    return files.write_bundles(calls.where("false"), calls, filings, scratch_path(spark, "bundles"))


@query("SELECT n_name AS run_id, n_nationkey AS seed, 'nation_' || n_nationkey || '__rate_' || CAST(n_nationkey / 4 AS VARCHAR).regexp_replace('\\.0$', '') AS name, n_nationkey = 24 AS newest FROM nation")
def run_folders(spark, d):
    """A run's row per nation, a table of fixed size; names made from the runs' settings."""
    root = scratch_path(spark, "runs")
    for r in table(spark, d, "nation", "n_nationkey", "n_name").collect():
        config = set_path({"env": {"nation": -1}}, "env.nation", r.n_nationkey)
        overrides = {"env.nation": config["env"]["nation"], "train.rate": r.n_nationkey / 4}
        files.write_run(spark, root, f"run-{r.n_nationkey:03}", {"run_id": r.n_name, "seed": r.n_nationkey, "name": run_name(overrides)})
    runs = files.read_runs(spark, root)
    newest = files.latest_run(runs).select(F.col("run_dir").alias("top"))
    return runs.join(F.broadcast(newest), F.col("run_dir") == F.col("top"), "left").select("run_id", F.col("seed").cast("int").alias("seed"), "name", F.col("top").isNotNull().alias("newest"))


@query("""SELECT user_id AS episode_id, event_id AS step_idx, CAST(ts AS VARCHAR)[1:10] AS date, CASE WHEN NOT isnan(value) THEN value END AS log_return, CASE WHEN NOT isnan(value) THEN value * 2 END AS nav, event_type = 'purchase' AS bought FROM events""")
def step_logs(spark, d):
    """Every event as a step of its user's log: written as JSON lines, read with the log's schema, flattened."""
    e = table(spark, d, "events", "user_id", "event_id", "ts", "value", "event_type")
    v = F.nanvl("value", F.lit(None))
    meta = F.struct(F.col("user_id").cast("long").alias("episode_id"), F.col("event_id").cast("long").alias("step_idx"), F.lit(None).cast("long").alias("date_idx"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    trading = F.struct(F.array((F.col("event_type") == "purchase").cast("double")).alias("executed_weights"), (v * 2).alias("nav_end_of_period"))
    path = scratch_path(spark, "steps")
    files.write_jsonl(e.select(meta.alias("meta"), F.create_map(F.lit("log_return"), v).alias("reward_components"), trading.alias("trading")), path)
    x = files.flatten_steps(files.read_jsonl(spark, path, files.STEP_LOG))
    return x.select("episode_id", "step_idx", "date", F.col("`reward.log_return`").alias("log_return"), F.col("`trading.nav_end_of_period`").alias("nav"), (F.col("`trading.executed_weights`")[0] == 1.0).alias("bought"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, CAST(coalesce(last_order, DATE '1970-01-01') AS VARCHAR)[1:10] AS last_order FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def attach_defaults(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    c = table(spark, d, "customer", "c_custkey").withColumn("n_orders", F.lit(-1))
    x = pn.attach(c, o, ["c_custkey"], {"n_orders": 0, "last_order": "1970-01-01"})
    return x.select("c_custkey", "n_orders", F.date_format("last_order", "yyyy-MM-dd").alias("last_order"))


@query("SELECT o_orderkey, o_orderstatus, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def merge_checked(spark, d):
    """The status stands on both sides and must agree; the segment is new."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    extra = o.join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderstatus", "c_mktsegment")
    return pn.merge_agreeing(o.drop("o_custkey"), extra, ["o_orderkey"])


@query(chain(BARS) + """, m AS (SELECT date, max(turbulence) AS t FROM bars GROUP BY date), f AS (SELECT date, last_value(t IGNORE NULLS) OVER (ORDER BY date) AS t FROM m)
SELECT ticker, CAST(date AS VARCHAR) AS date, f.t AS turbulence FROM bars JOIN f USING (date)""")
def market_series(spark, d):
    return pn.market_fill(bars(spark, d).select("ticker", "date", "turbulence"), day="date", columns=["turbulence"]).select("ticker", day("date"), "turbulence")


@query("SELECT doc_id, coalesce(length(text), 0) // 4 AS n_tokens FROM documents")
def token_lengths(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", rough_tokens("text").alias("n_tokens"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
