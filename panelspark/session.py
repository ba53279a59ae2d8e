"""Session helpers and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a relation whose size was measured may be broadcast.
BROADCAST_LIMIT = 32 * 1024 * 1024


def build_session(name: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only a local session may fall back to a temporary folder of this machine; on a
    cluster a missing setting is an error, because executors couldn't read each
    other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="panelspark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a scratch path; for use when all that was read from it is cut off."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """``df.distinct()`` where few keys repeat: only rows whose key occurs more than once are
    shuffled. The repeated keys are measured; beyond the broadcast limit all rows are."""
    again = cut_lineage(df.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key"))
    size = again.agg(F.count("*"), F.coalesce(F.sum(F.length(F.col("_key").cast("string"))), F.lit(0))).first()
    if size[0] * 64 + size[1] > BROADCAST_LIMIT:
        return df.distinct()
    again = F.broadcast(again)
    on = df[key].eqNullSafe(again["_key"])
    return df.join(again, on, "left_anti").union(df.join(again, on, "left_semi").distinct())


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size of a relation; exact for a checkpoint or a scan without filter."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever the driver imported it from.

    The zip is served by the driver, so it needs no shared folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="panelspark-code-")) / "panelspark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Before a stage of heavy per-row work: the same rows over all cores.

    A large input has more partitions than there are cores and stays as it is, without a
    shuffle; only one that arrives in a few large pieces (one file, one row group) is dealt
    out by a hash of the keys.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    # behind a shuffle the partitions are AQE's business, and asking would run the shuffle
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *[F.xxhash64(k) for k in keys])
