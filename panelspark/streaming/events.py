"""Streaming forms of batch operators: windows, late data, deduplication, running normalisers.

The same transformations run on a static frame; streams add a watermark, which bounds state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.session import scratch_path, ship_package


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the files of a folder; a single file is found through its parent."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return r.parquet(path)
    parent, _, name = path.rpartition("/")
    return r.option("pathGlobFilter", name).parquet(parent)


def windowed_counts(events: DataFrame, *, ts: str, key: str, width: str = "7 days", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(start, key, n): counts per window; on a stream, state older than ``late`` is dropped."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(events: DataFrame, *, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, key, n) of sessions: events of a key closer than ``gap``."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    return e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_of_key(events: DataFrame, *, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once: on a stream within the watermark, so the state stays bounded."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def running_zscore(events: DataFrame, *, key: str, order: str, value: str, window: int = 26) -> DataFrame:
    """(key, order, z): z-score of each value against the key's last ``window`` values, itself
    included; the window is the state of the key."""
    ship_package(events.sparkSession)
    kinds = dict(events.dtypes)
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, z double"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order)
        made = []
        for at, v in zip(rows[order], rows[value]):
            last = [*last, float(v)][-window:]
            mean = sum(last) / len(last)
            dev = (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5
            made.append((k[0], at, (float(v) - mean) / (dev + 1e-12)))
        state.update((last,))
        yield pd.DataFrame(made, columns=[key, order, "z"])

    return events.select(key, order, value).dropna().groupBy(key).applyInPandasWithState(step, out, "last array<double>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads the result back."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
