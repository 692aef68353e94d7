"""Paged JSON searches as a Spark data source, for batches and for streams.

The service is asked once for how many records there are; every page is a partition, fetched by the task that reads it.
A stream's offset is a number of records in the order of their publication, so a restart asks for the pages after those
that were committed, and a page that is read again gives the same rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "item_key string, title string, detail_url string, category string, published string, region string, project_code string, tenderer string, position long"
# Names under which services give a field, in the order they are tried.
FIELDS = {
    "item_key": ("infoid", "infoId"), "title": ("title", "titlenew"), "category": ("categorynum", "categoryNum"), "published": ("pubinwebdate", "webdate", "infodate", "infoDate"),
    "region": ("infoc", "infoC"), "project_code": ("infod", "infoD", "projectno", "projectNo"), "tenderer": ("companyname", "companyName"),
}


def payload(category: str, offset: int, size: int, start: str | None = None, end: str | None = None) -> dict:
    """What a search is asked for: records of a category, oldest first, and published between two days if one is given."""
    out = {
        "pn": offset, "rn": size, "cnum": "001", "sort": json.dumps({"webdate": "1", "newid": "1"}), "noParticiple": "1",
        "condition": [{"fieldName": "categorynum", "equal": category, "isLike": True, "likeType": 2}],
    }
    if start or end:
        first, last = date.fromisoformat(start or end), date.fromisoformat(end or start)
        out["time"] = [{"fieldName": "webdate", "startTime": f"{first} 00:00:00", "endTime": f"{last} 23:59:59"}]
    return out


def unwrapped(text: str) -> dict:
    """The result of a response, which may hold it as JSON text under `content`."""
    found = json.loads(text)
    if isinstance(found, dict) and isinstance(found.get("content"), str):
        found = json.loads(found["content"])
    result = found.get("result") if isinstance(found, dict) else None
    return result if isinstance(result, dict) else {}


def row(record: object, position: int, category: str, detail: str) -> tuple | None:
    """A record's row; none for what isn't a record or has no key. A title that is missing is the key."""
    if not isinstance(record, dict):
        return None

    def text(field: str) -> str | None:
        return next((t for n in FIELDS[field] if (t := str(record.get(n) if record.get(n) is not None else "").strip())), None)

    key = text("item_key")
    if not key:
        return None
    kind = text("category") or category
    published = text("published")
    url = detail.replace("{category}", kind).replace("{key}", key)
    return key, text("title") or key, url, kind, published[:10] if published else None, text("region"), text("project_code"), text("tenderer"), position


def ask(url: str, body: dict, tries: int = 3, timeout: float = 30.0) -> str:
    """The answer to a JSON body; errors are tried again after a growing pause."""
    import time
    import urllib.request

    for n in range(tries):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.read().decode("utf-8")
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(2**n)
    raise AssertionError


@dataclass
class Page(InputPartition):
    """Records from start on, size of them at most, before end."""

    start: int
    end: int


class _Search:
    def __init__(self, options: dict):
        self.url, self.category, self.size = options["url"], options.get("category", ""), max(1, int(options.get("pagesize", 50)))
        self.start, self.end = options.get("startdate"), options.get("enddate")
        self.detail = options.get("detail", "{key}")

    def _found(self, offset: int, size: int) -> dict:
        return unwrapped(ask(self.url, payload(self.category, offset, size, self.start, self.end)))

    def total(self) -> int:
        return int(self._found(0, 1).get("totalcount") or 0)

    def pages(self, start: int, end: int) -> list[Page]:
        return [Page(k, min(k + self.size, end)) for k in range(start, end, self.size)]

    def read(self, partition: Page | None):
        if partition is None:  # what Spark reads where there are no pages
            return
        records = self._found(partition.start, partition.end - partition.start).get("records") or []
        for k, record in enumerate(records[: partition.end - partition.start]):
            made = row(record, partition.start + k, self.category, self.detail)
            if made:
                yield made


class SearchReader(_Search, DataSourceReader):
    def partitions(self):
        return self.pages(0, self.total())


class SearchStream(_Search, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        return {"records": self.total()}

    def partitions(self, start: dict, end: dict):
        return self.pages(start["records"], end["records"])

    def commit(self, end: dict) -> None:
        pass


class SearchSource(DataSource):
    """spark.dataSource.register(SearchSource); format "paged_search" with the options url, category, pageSize, startDate,
    endDate and detail (an address with {key} and {category}). An answer without records or a total is an empty one."""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SearchReader(self.options)

    def streamReader(self, schema):
        return SearchStream(self.options)
