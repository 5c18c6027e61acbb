"""Paged feeds as a Python data source: filters go to the feed, pages are read in parallel, and new rows can be followed as a stream."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

PAGE = 2000
PASSING = ("timed out", "temporarily", "connection reset", "503", "429")
#: Lanes that read pages beside one another where a feed doesn't say how many there are.
LANES = 8


class _Pages(InputPartition):
    """Pages from offset on, every step-th; just one if last."""

    def __init__(self, offset: int, step: int, last: bool, count: int):
        super().__init__(offset)
        self.offset, self.step, self.last, self.count = offset, step, last, count


def date_literal(day: str | dt.date) -> str:
    """A day as a remote filter takes it."""
    return f"DATE '{day}'"


def timestamp_literal(moment: dt.datetime) -> str:
    """A UTC time as a remote filter takes it."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.UTC)
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


def literal(value: object) -> str | None:
    """A value as a remote filter takes it, or None where that would not be exact."""
    if isinstance(value, bool):
        return None
    if isinstance(value, dt.datetime):
        return None if value.microsecond else timestamp_literal(value)
    if isinstance(value, dt.date):
        return date_literal(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value) if isinstance(value, int) or (isinstance(value, float) and value == value and abs(value) != float("inf")) else None


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def remote(f: Filter) -> str | None:
    """A filter in the feed's language, or None where it has to stay with Spark. All that is said is true of the same rows there and here: nulls fit nothing but IS NULL."""
    if len(f.attribute) != 1 or not f.attribute[0].replace("_", "").isalnum():
        return None
    name = f.attribute[0]
    if type(f) in _SIGNS:
        v = literal(f.value)
        return v and f"{name} {_SIGNS[type(f)]} {v}"
    if isinstance(f, In):
        values = [literal(v) for v in f.value if v is not None]
        return f"{name} IN ({', '.join(values)})" if values and all(values) else None
    if isinstance(f, StringStartsWith):
        return None if any(c in f.value for c in "%_\\") else f"{name} LIKE {literal(f.value + '%')}"
    return {IsNotNull: f"{name} IS NOT NULL", IsNull: f"{name} IS NULL"}.get(type(f))


class _Feed:
    """What both readers share. Options: path (a URL or path with '{offset}' and '{count}', and where the feed can filter and prune '{where}' and '{fields}'), page (rows of a page), tries, where (a filter to begin with)."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.page = int(options.get("page", PAGE))
        self.where = [options["where"]] if options.get("where") else []

    def address(self, path: str, offset: int, count: int) -> str:
        return path.format(offset=offset, count=count, where=quote(" AND ".join(self.where) or "1=1"), fields=quote(",".join(f.name for f in self.schema.fields if f.name != "geometry")))

    def fetched(self, path: str, offset: int = 0, count: int = 0) -> list | dict:
        where = self.address(path, offset, count)
        return with_retry(lambda: fetch(where), int(self.options.get("tries", "5")))

    def rows(self, p: _Pages) -> Iterator[tuple]:
        offset = p.offset
        while True:
            got, more = records(self.fetched(self.options["path"], offset, p.count))
            if len(got) > p.count:
                raise ValueError(f"{self.address(self.options['path'], offset, p.count)} has {len(got)} rows; {p.count} were asked for")
            for r in got:
                yield tuple(r.get(f.name) for f in self.schema.fields)
            if p.last or not more and len(got) < p.count:
                return
            offset += p.step

    def total(self) -> int | None:
        """Rows that the feed has for the filter: as an option says (without a filter), or as the address in the option count does, or unknown."""
        if self.options.get("count"):
            got = self.fetched(self.options["count"])
            return int(got["count"] if isinstance(got, dict) else got[0]["count"])
        return int(self.options["total"]) if "total" in self.options and len(self.where) == bool(self.options.get("where")) else None


class PagedReader(_Feed, DataSourceReader):
    """Reads offset pages of a feed. Further options: total (rows of the whole feed) or count (the address of {"count": n}), lanes.

    With a total, a partition for each page. Without, each of so many lanes reads its share of the pages until one is short and doesn't say that
    there is more. A page is a JSON list of records, or a GeoJSON object: its features' properties, the geometry as JSON text in
    the column geometry, and exceededTransferLimit for more. A page that is missing, or longer than asked for, is an error (but an empty first page of a lane). Filters
    that the feed understands are sent with each page, if the path has '{where}' and the session allows it (with_feeds); then offsets count the rows that fit.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            said = remote(f) if "{where}" in self.options["path"] else None
            if said:
                self.where.append(said)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if (n := self.total()) is not None:
            return [_Pages(k, self.page, True, self.page) for k in range(0, max(n, 1), self.page)]
        lanes = int(self.options.get("lanes", str(LANES) if "{where}" in self.options["path"] else "1"))
        return [_Pages(k * self.page, lanes * self.page, False, self.page) for k in range(lanes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition)


class PagedStreamReader(_Feed, DataSourceStreamReader):
    """Follows a feed that only grows: the offset is the number of rows read, the option count says how many there are. A batch is cut into pages, which are read again alike if it is run again."""

    def initialOffset(self) -> dict:
        return {"rows": int(self.options.get("from", "0"))}

    def latestOffset(self) -> dict:
        n = self.total()
        if n is None:
            raise ValueError("a feed that is followed needs the option count")
        return {"rows": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["rows"], end["rows"]
        return [_Pages(k, self.page, True, min(self.page, b - k)) for k in range(a, b, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition)


def records(page: list | dict) -> tuple[list[dict], bool]:
    """The records of a JSON page, and whether it says that there are more."""
    if isinstance(page, list):
        return page, False
    if "error" in page:
        raise ValueError(f"the feed answers with an error: {page['error']}")
    rows = [{**(f.get("properties") or {}), "geometry": json.dumps(f["geometry"]) if f.get("geometry") else None} for f in page["features"]]
    return rows, bool(page.get("exceededTransferLimit") or (page.get("properties") or {}).get("exceededTransferLimit"))


def fetch(url: str) -> list | dict:
    """A JSON page."""
    with urlopen(url if "://" in url else f"file://{url}", timeout=60) as f:
        return json.load(f)


def with_retry(call: Callable[[], list], tries: int, wait: float = 1.5) -> list:
    """call(), again after wait * 2 ** i seconds for failures that pass; others are raised at once."""
    for i in range(tries):
        try:
            return call()
        except Exception as e:
            if i == tries - 1 or not any(x in str(e).lower() for x in PASSING):
                raise
            time.sleep(wait * 2**i)
    return []


class PagedSource(DataSource):
    """spark.read.format('paged').schema(...).option('path', ...).load(), and readStream alike; with_feeds() makes it known."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(schema, self.options)


def with_feeds(spark: SparkSession) -> SparkSession:
    """Makes the format 'paged' known to a session, and lets its filters go to the feeds."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
