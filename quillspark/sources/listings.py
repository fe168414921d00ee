"""Paged monthly listings as a Spark data source, in batch and as a stream.

A listing is a folder of pages ``month=YYYY-MM/page=N/*``, one record a line, as a crawl or
``write_listing`` leaves it.  Up to ``MOST_PARTITIONS`` pages are each a partition of its own, more are
dealt out as runs of pages, each read page by page; conditions on ``month``
and ``page`` are pushed down, so a month's read opens that month's pages only.  As a stream
the offset is the last page taken, in the order of (month, page): a restart goes on behind it,
and what is appended later (more pages of the last month, later months) is the next batch.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "month string, page int, record string"
NAME = "paged_listing"
#: Records of one Arrow batch.
BATCH = 4096
#: Pages up to which each is a partition; bytes above which a run of pages isn't made longer.
MOST_PARTITIONS, RUN_BYTES = 200, 64 << 20
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass(frozen=True)
class Page:
    month: str
    page: int
    files: tuple[str, ...]
    size: int


@dataclass(frozen=True)
class Run(InputPartition):
    pages: tuple[Page, ...]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


def months(path: str) -> list[str]:
    """Months that a listing has a folder of, in order."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name[6:] for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("month="))


def pages(path: str, only: list[str] | None = None) -> list[Page]:
    """Pages of a listing (of ``only`` these months) in order; what isn't named like a page is none."""
    from pyarrow import fs

    store, root = _store(path)
    found: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for month in months(path) if only is None else only:
        for f in store.get_file_info(fs.FileSelector(f"{root}/month={month}", recursive=True, allow_not_found=True)):
            parts = f.path[len(root) :].strip("/").split("/")
            if f.type == fs.FileType.File and len(parts) == 3 and parts[1].startswith("page=") and parts[2][0] not in "._":
                found.setdefault((month, int(parts[1][5:])), []).append((f.path, f.size))
    return [Page(m, p, tuple(sorted(n for n, _ in files)), sum(size for _, size in files)) for (m, p), files in sorted(found.items())]


def runs(taken: list[Page]) -> list[Run]:
    """Pages in order, dealt out to partitions."""
    most, out = -(-len(taken) // MOST_PARTITIONS), []
    held: list[Page] = []
    for page in taken:
        if held and (len(held) >= most or sum(p.size for p in held) + page.size > RUN_BYTES):
            out.append(Run(tuple(held)))
            held = []
        held.append(page)
    return [*out, Run(tuple(held))] if held else out


def records(path: str, page: Page) -> Iterator[pa.RecordBatch]:
    """Lines of a page that aren't blank."""
    store, _ = _store(path)
    for file in page.files:
        held: list[str] = []
        with store.open_input_stream(file) as raw:
            rest = b""
            while block := raw.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                held += [x.decode() for x in lines if x.strip()]
                while len(held) >= BATCH:
                    yield _batch(page, held[:BATCH])
                    held = held[BATCH:]
            if rest.strip():
                held.append(rest.decode())
        if held:
            yield _batch(page, held)


def run_records(path: str, run: Run) -> Iterator[pa.RecordBatch]:
    for page in run.pages:
        yield from records(path, page)


def _batch(page: Page, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([page.month] * len(lines), pa.string()), pa.array([page.page] * len(lines), pa.int32()), pa.array(lines, pa.string())], ["month", "page", "record"])


class ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.kept: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("month", "page") and isinstance(f, (In, *_COMPARE)):
                self.kept.append((column, f))
            else:
                yield f

    def partitions(self) -> list[Run]:
        def wanted(p: Page) -> bool:
            return all(getattr(p, c) in f.value if isinstance(f, In) else _COMPARE[type(f)](getattr(p, c), f.value) for c, f in self.kept)

        return runs([p for p in pages(self.path) if wanted(p)])

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        return run_records(self.path, partition) if partition else iter(())  # None where there are no pages


class ListingStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"month": "", "page": -1}

    def latestOffset(self) -> dict:
        for month in reversed(months(self.path)):
            if last := pages(self.path, [month])[-1:]:
                return {"month": month, "page": last[0].page}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Run]:
        low, high = ((x["month"], x["page"]) for x in (start, end))
        between = [m for m in months(self.path) if start["month"] <= m <= end["month"]]
        return runs([p for p in pages(self.path, between) if low < (p.month, p.page) <= high])

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return run_records(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark push conditions down to it."""
    from pyspark import cloudpickle

    import quillspark.sources.listings as here

    cloudpickle.register_pickle_by_value(here)  # the planner's workers need no path to this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """``month, page, record`` of all pages; conditions on the first two select the pages that are opened."""
    register(spark)
    return spark.read.format(NAME).option("path", path).load()


def stream_listing(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).option("path", path).load()


def write_listing(rows: DataFrame, path: str, month: Column, order: list[Column], page_size: int, mode: str = "append") -> None:
    """Pages of at most ``page_size`` rows of each month, a JSON object a line, numbered from 0 in ``order``.

    Rows without a month are left out.
    """
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("month").orderBy(*order)) - 1
    paged = rows.withColumn("month", month).where("month IS NOT NULL").withColumn("page", F.floor(place / page_size).cast("int"))
    record = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    paged.select("month", "page", record.alias("value")).repartition("month", "page").write.mode(mode).partitionBy("month", "page").text(path)
