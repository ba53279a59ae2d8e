"""A paged service as a Spark data source: market bars, news, transcripts, macro series.

One partition is one (key chunk, period); a task pages through it until an empty page, with
retries that back off. What is fetched is up to a function from a request to a list of
records, so the source works with any client and, in tests, without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Request(InputPartition):
    def __init__(self, keys: list[str], start: str, end: str):
        super().__init__((tuple(keys), start, end))
        self.keys, self.start, self.end = keys, start, end


def with_retries(call: Callable[[], list[dict]], attempts: int = 5, wait_s: float = 0.2) -> list[dict]:
    for i in range(attempts):
        try:
            return call()
        except OSError:
            if i == attempts - 1:
                raise
            time.sleep(wait_s * 2**i)
    return []


def chunks(items: list[str], size: int) -> list[list[str]]:
    return [items[i : i + size] for i in range(0, len(items), size)]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.o, self.fields = options, fields

    def partitions(self) -> list[Request]:
        keys = json.loads(self.o["keys"])
        periods = json.loads(self.o.get("periods", '[["", ""]]'))
        return [Request(c, a, b) for c in chunks(keys, int(self.o.get("chunk", 5))) for a, b in periods]

    def read(self, partition: Request) -> Iterator[tuple]:
        module, name = self.o["fetch"].rsplit(".", 1)
        fetch = getattr(import_module(module), name)
        page = 0
        while True:
            rows = with_retries(lambda: fetch(partition.keys, partition.start, partition.end, page))
            if not rows:
                return
            for r in rows:
                yield tuple(r.get(f) for f in self.fields)
            page += 1


class PagedSource(DataSource):
    """Options: fetch (dotted name of the function), keys and periods (JSON), chunk."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs an explicit schema")

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options), schema.fieldNames())


def yearly(first: int, last: int) -> list[tuple[str, str]]:
    """Calendar years as periods."""
    return [(f"{y}-01-01", f"{y}-12-31") for y in range(first, last + 1)]


def read_paged(spark: SparkSession, schema: str, *, fetch: str, keys: list[str], periods: list[tuple[str, str]] | None = None, chunk: int = 5):
    """All records of the keys over the periods."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(schema).options(fetch=fetch, keys=json.dumps(keys), periods=json.dumps(periods or [("", "")]), chunk=str(chunk)).load()


def html_cells(df, column: str):
    """Rows of a table's cells out of an HTML page, tags and blanks removed."""
    from pyspark.sql import functions as F

    rows = df.select(F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", ""), r"\s+", " ")))
    return rows.select("row_no", cells.alias("cells")).where(F.size("cells") > 0)
