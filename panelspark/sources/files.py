"""File sources and sinks: JSON lines, CSV with comment headers, run folders, document bundles."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.panel import resume_keys
from panelspark.session import cut_lineage

#: One step of a run log.
STEP_LOG = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("episode_id", T.LongType()), T.StructField("step_idx", T.LongType()), T.StructField("date_idx", T.LongType()), T.StructField("date", T.StringType())])),
    T.StructField("reward_components", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("trading", T.StructType([T.StructField("executed_weights", T.ArrayType(T.DoubleType())), T.StructField("intent_weights", T.ArrayType(T.DoubleType())), T.StructField("trade_shares", T.ArrayType(T.DoubleType())), T.StructField("trade_cost", T.DoubleType()), T.StructField("nav_end_of_period", T.DoubleType())])),
])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Scan with an optional fixed schema; only named columns reach the reader."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Atomic by Spark's commit protocol; ``append`` resumes an output."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stored result of ``build``; built and written when missing or forced."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Writes the rows whose keys the output lacks; the number written. A first call
    makes the output. Call it again after a failure: what is there stays as it is."""
    spark = df.sparkSession
    todo = resume_keys(df, spark.read.parquet(path), keys) if exists(spark, path) else df
    todo = cut_lineage(todo.dropDuplicates(keys))
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header below any number of ``#`` lines; ``monitor_file`` names the file."""
    r = spark.read.option("header", True).option("comment", "#").option("inferSchema", schema is None)
    return (r.schema(schema) if schema else r).csv(path).withColumn("monitor_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_csv(df: DataFrame, path: str) -> None:
    """S6."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped (``broken_lines`` counts the latter)."""
    schema = schema if isinstance(schema, str) else T.StructType(list(schema))
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value").where(F.try_parse_json("value").isNotNull())
    return parsed.select("r.*")


def broken_lines(spark: SparkSession, path: str) -> int:
    """Lines, not blank, that ``read_jsonl`` leaves out because they are no JSON."""
    return spark.read.text(path).where((F.length(F.trim("value")) > 0) & F.try_parse_json("value").isNull()).count()


def write_jsonl(df: DataFrame, path: str) -> None:
    """Timestamps and arrays become JSON as they are; NaN becomes null."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.mode("overwrite").json(path)


def flatten_steps(df: DataFrame) -> DataFrame:
    """Step logs with one column per field: meta plain, ``reward.x``, ``trading.x``."""
    names = [f.name for f in STEP_LOG["trading"].dataType]
    rewards = ("log_return", "downside_deviation", "cvar", "loss_frequency", "endogenous_risk", "raw_turbulence", "normalized_turbulence", "raw_llm_risk", "normalized_llm_risk", "market_risk_penalty", "llm_risk_penalty", "total_reward")
    return df.select("meta.*", *[F.col("reward_components").getItem(r).alias(f"reward.{r}") for r in rewards], *[F.col(f"trading.{n}").alias(f"trading.{n}") for n in names])


def write_bundles(news: DataFrame, calls: DataFrame, filings: DataFrame, path: str) -> DataFrame:
    """One row per (week, ticker) with nested news, call and filings and their counts,
    written as JSON partitioned by week and ticker; the counts are returned."""
    keys = ["week", "ticker"]
    pack = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in keys])).alias(name))
    out = pack(news, "news").join(pack(calls, "calls"), keys, "full").join(pack(filings, "filings"), keys, "full")
    out = out.withColumns({f"n_{c}": F.coalesce(F.size(c), F.lit(0)) for c in ("news", "calls", "filings")})
    out.write.mode("overwrite").partitionBy(*keys).json(path)
    return out.select(*keys, "n_news", "n_calls", "n_filings")


def read_runs(spark: SparkSession, root: str, name: str = "run_row") -> DataFrame:
    """All runs under a folder, one row each, with ``run_dir``; runs differ in columns."""
    df = spark.read.json(f"{root}/*/{name}.json")
    return df.withColumn("run_dir", F.element_at(F.split(F.input_file_name(), "/"), -2))


def latest_run(runs: DataFrame, run_dir: str = "run_dir") -> DataFrame:
    """The run whose folder name sorts last."""
    return runs.orderBy(F.desc(run_dir)).limit(1)


def write_run(spark: SparkSession, root: str, run_id: str, row: dict, name: str = "run_row") -> None:
    """One run's row in its place, in whatever file system ``root`` names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_paths(root, run_id)[name])
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps(row), "utf-8"))
    finally:
        out.close()


def run_paths(root: str, run_id: str) -> dict[str, str]:
    """The standard places of a run's files."""
    base = f"{root.rstrip('/')}/{run_id}"
    return {"root": base, "meta": f"{base}/meta.json", "run_row": f"{base}/run_row.json"} | {k: f"{base}/{k}" for k in ("train", "test", "monitor", "progress", "models", "analysis")}
