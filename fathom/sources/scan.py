"""Paged responses of services, kept as files, as data sources of Spark.

Two formats: `article_pages`, windows of dates with pages of articles, and
`series_pages`, series with pages at offsets. Spark plans a task for each window
or series; filters on dates, importance, topics and series reach the source, which
then opens fewer files. Pages are read until one is short or missing, with retries.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ARTICLE = "id long, created date, title string, body string, topic string, importance string"
SERIES = "series string, date date, value double"
IMPORTANCE = ("low", "medium", "high")
DAY = dt.timedelta(1)


def retried(read: Callable[[], Any], tries: int = 3, backoff: float = 2.0, wait: Callable[[float], None] = time.sleep) -> Any:
    """What read() gives; after an OSError it waits 1, `backoff`, `backoff`^2 ... seconds and
    tries again. A missing file is no error but None: there is no such page."""
    for k in range(tries):
        try:
            return read()
        except FileNotFoundError:
            return None
        except OSError:
            if k == tries - 1:
                raise
            wait(backoff**k)


class Pages:
    """The files of one page: a folder of JSON lines, as Spark writes it, or one file."""

    def __init__(self, uri: str, tries: int):
        self.store, self.root = pafs.FileSystem.from_uri(uri)
        self.tries = tries

    def text(self, name: str) -> str | None:
        def read() -> str:
            place = f"{self.root}/{name}"
            if self.store.get_file_info(place).type == pafs.FileType.Directory:
                files = [f.path for f in self.store.get_file_info(pafs.FileSelector(place)) if f.is_file and not f.base_name.startswith(("_", "."))]
            else:
                files = [place]
            return "\n".join(self.store.open_input_stream(f).read().decode() for f in sorted(files))

        return retried(read, self.tries)

    def names(self, folder: str, prefix: str) -> list[str]:
        found = self.store.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name.removeprefix(prefix) for f in found if f.base_name.startswith(prefix))


class Bounds:
    """Dates from first to last, and allowed values of columns, as filters narrow them."""

    def __init__(self, date: str, first: dt.date, last: dt.date, columns: tuple[str, ...]):
        self.date, self.first, self.last = date, first, last
        self.allowed: dict[str, set | None] = dict.fromkeys(columns)

    def take(self, f: Filter) -> None:
        name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
        if name == self.date and isinstance(value, dt.date):
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, value + DAY * isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                self.last = min(self.last, value - DAY * isinstance(f, LessThan))
        elif name in self.allowed and isinstance(f, (EqualTo, In)):
            values = {value} if isinstance(f, EqualTo) else set(value)
            self.allowed[name] = values if self.allowed[name] is None else self.allowed[name] & values

    def allows(self, column: str, value: str) -> bool:
        return self.allowed[column] is None or value in self.allowed[column]


class Window(InputPartition):
    def __init__(self, start: dt.date):
        self.start = start


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.tries = options["path"], int(options.get("pagesize", 100)), int(options.get("tries", 3))
        first, last = (dt.date.fromisoformat(options.get(k, str(v))) for k, v in (("first", dt.date.min), ("last", dt.date.max)))
        self.days, self.bounds = int(options.get("days", 30)), Bounds("created", first, last, ("importance", "topic"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All filters stay with Spark too: the source only leaves out what can't match."""
        for f in filters:
            self.bounds.take(f)
            yield f

    def partitions(self) -> list[Window]:
        starts = [dt.date.fromisoformat(name) for name in Pages(self.path, self.tries).names("", "start=")]
        return [Window(s) for s in starts if s <= self.bounds.last and s + DAY * self.days >= self.bounds.first]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        pages, start = Pages(self.path, self.tries), f"start={partition.start}"
        for importance in pages.names(start, "importance="):
            if not self.bounds.allows("importance", importance):
                continue
            for topic in pages.names(f"{start}/importance={importance}", "topic="):
                if not self.bounds.allows("topic", topic):
                    continue
                page = 0
                while text := pages.text(f"{start}/importance={importance}/topic={topic}/page={page}"):
                    rows = [json.loads(x) for x in text.splitlines() if x]
                    days = [dt.date.fromisoformat(x["created"][:10]) for x in rows]
                    kept = [(x, d) for x, d in zip(rows, days, strict=True) if self.bounds.first <= d <= self.bounds.last]
                    columns = [pa.array([x["id"] for x, _ in kept], pa.int64()), pa.array([d for _, d in kept], pa.date32()), *(pa.array([x.get(c) for x, _ in kept], pa.string()) for c in ("title", "body"))]
                    columns += [pa.array([v] * len(kept), pa.string()) for v in (topic, importance)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "created", "title", "body", "topic", "importance"])
                    if len(rows) < self.size:
                        break
                    page += 1


class ArticlePages(DataSource):
    """Options: path (a URI that pyarrow.fs can open), first and last (all), days (30: a window
    has 31), pageSize (100), tries (3). Files: start=/importance=/topic=/page=k."""

    @classmethod
    def name(cls) -> str:
        return "article_pages"

    def schema(self) -> str:
        return ARTICLE

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader({k.lower(): v for k, v in self.options.items()})


class One(InputPartition):
    def __init__(self, name: str):
        self.name = name


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tries = options["path"], int(options.get("tries", 3))
        self.bounds = Bounds("date", dt.date.min, dt.date.max, ("series",))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.bounds.take(f)
            yield f

    def partitions(self) -> list[One]:
        return [One(s) for s in Pages(self.path, self.tries).names("", "series=") if self.bounds.allows("series", s)]

    def read(self, partition: One) -> Iterator[pa.RecordBatch]:
        pages, at, total = Pages(self.path, self.tries), 0, 1
        while at < total:
            text = pages.text(f"series={partition.name}/offset={at}")
            if not text:
                raise ValueError(f"series {partition.name}: no page at {at} of {total}")
            responses = [json.loads(x)["response"] for x in text.splitlines() if x]
            total = int(responses[0]["total"])
            rows = [x for r in responses for x in r["data"]]
            if not rows and at < total:
                raise ValueError(f"series {partition.name}: an empty page at {at} of {total}")
            at += len(rows)
            found = [(dt.date.fromisoformat(x["period"]), float(x["value"])) for x in rows if x.get("value") is not None]
            found = [x for x in found if self.bounds.first <= x[0] <= self.bounds.last]
            columns = [pa.array([partition.name] * len(found), pa.string()), pa.array([x[0] for x in found], pa.date32()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["series", "date", "value"])


class SeriesPages(DataSource):
    """Options: path, tries. Files: series=/offset=, objects with response.total and
    response.data (period, value), read on until `total` rows came; null values go."""

    @classmethod
    def name(cls) -> str:
        return "series_pages"

    def schema(self) -> str:
        return SERIES

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, kind: type[DataSource], path: str, **options) -> DataFrame:
    """A DataFrame over one of the sources, with filters pushed to it. Spark decides on
    that when it plans, so the session's setting is changed for good."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def write_article_pages(rows: DataFrame, path: str, first: str, days: int = 30, size: int = 100) -> None:
    """rows of ARTICLE as the files that article_pages reads. Pages are numbered within
    a window, importance and topic, by date and id."""
    start = F.date_add(F.lit(first).cast("date"), (F.floor(F.datediff("created", F.lit(first).cast("date")) / (days + 1)) * (days + 1)).cast("int"))
    rows = rows.withColumn("start", start)
    parts = ["start", "importance", "topic"]
    number = F.row_number().over(Over.partitionBy(*parts).orderBy("created", "id")) - 1
    paged = rows.withColumn("page", F.floor(number / size).cast("int"))
    paged.repartition(*parts, "page").write.mode("overwrite").partitionBy(*parts, "page").json(path)


def write_series_pages(rows: DataFrame, path: str, size: int = 5000) -> None:
    """rows of SERIES as the files that series_pages reads."""
    by = Over.partitionBy("series")
    at = F.row_number().over(by.orderBy("date")) - 1
    placed = rows.withColumns({"_n": at, "_total": F.count("*").over(by).cast("string")}).withColumn("offset", (F.floor(F.col("_n") / size) * size).cast("long"))
    data = F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("period"), "value")))
    pages = placed.groupBy("series", "offset").agg(F.struct(F.first("_total").alias("total"), data.alias("data")).alias("response"))
    pages.repartition("series", "offset").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("series", "offset").json(path)
