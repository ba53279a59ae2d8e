"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import timeshape


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ticker_key(c: str = "ticker") -> Column:
    """Trimmed upper-case key; blank means null."""
    t = F.upper(F.trim(F.col(c)))
    return F.when(t != "", t)


#: Names in the IANA list of zones, with room.
MAX_ZONES = 1000


def zone_names(zones: DataFrame) -> list[str]:
    """Distinct names in ``zone``; more than there are zones is an error."""
    names = [r.zone for r in zones.select("zone").dropna().distinct().limit(MAX_ZONES + 1).collect()]
    if len(names) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} zone names")
    return names


def news_times(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """News with ``published_s``; the local zone and day order come from source_zones."""
    zones = table(spark, sf_dir, "source_zones").select(F.col("source").alias("sz_source"), "zone", "date_order").dropDuplicates(["sz_source"])
    names = zone_names(zones)
    cols = dict.fromkeys([*columns, "published_at_utc", "source"])
    df = table(spark, sf_dir, "news", *cols)
    df = df.join(F.broadcast(zones), F.col("source") == F.col("sz_source"), "left")
    df = timeshape.normalise(df, "published_at_utc", zone=F.col("zone"), zones=names, day_first=F.col("date_order") == "dmy", out="published_s")
    return df.drop("sz_source", "zone", "date_order")


def sec_times(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    cols = dict.fromkeys([*columns, "filed_at_utc"])
    return timeshape.normalise(table(spark, sf_dir, "sec", *cols), "filed_at_utc", out="filed_s")
