"""Connectors to publishing sites as Spark data sources.

A site is a row of settings: a list page, how many pages it has, and the expression that finds items. `partitions`
plans the list pages, `read` fetches and parses one, and an incremental run joins what comes against known keys.
Fetching is a function of the url, so a test or a mirror passes its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "site string, page int, url string, title string, period string, item_key string"


@dataclass
class Site:
    """How a site lists its publications. item: named groups url and title, and period if it is printed."""

    name: str
    list_url: str
    pages: int = 1
    item: str = r'<a[^>]+href="(?P<url>[^"]+)"[^>]*>(?P<title>[^<]+)</a>'
    wanted: str = ""
    headers: dict = field(default_factory=dict)


def parse_list(site: Site, page: int, html: str):
    """Rows of one list page."""
    from urllib.parse import urljoin

    for m in re.finditer(site.item, html):
        title = re.sub(r"\s+", " ", m["title"]).strip()
        if site.wanted and not re.search(site.wanted, title):
            continue
        found = re.search(r"(20\d{2})\s*[年/.-]\s*(0?[1-9]|1[0-2])(?!\d)", m.groupdict().get("period") or title)
        period = f"{found[1]}-{int(found[2]):02d}" if found else None
        url = urljoin(site.list_url, m["url"])
        yield site.name, page, url, title, period, f"{site.name}:{period or title}"


def fetch(url: str, headers: dict, tries: int = 3, timeout: float = 30.0) -> str:
    """A page's text; a short answer or an error is tried again after a growing pause."""
    import time
    import urllib.request

    for n in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                data, length = r.read(), r.headers.get("Content-Length")
                if length and int(length) != len(data):
                    raise OSError(f"{url}: {len(data)} of {length} bytes")
                return data.decode(r.headers.get_content_charset() or "utf-8", "replace")
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(2**n)
    raise AssertionError


@dataclass
class ListPage(InputPartition):
    page: int


class SiteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.site = Site(options["site"], options["listurl"], int(options.get("pages", 1)), options.get("item", Site.item), options.get("wanted", ""))

    def partitions(self):
        return [ListPage(n) for n in range(1, self.site.pages + 1)]

    def read(self, partition):
        url = self.site.list_url.replace("{page}", str(partition.page))
        yield from parse_list(self.site, partition.page, fetch(url, self.site.headers))


class SiteSource(DataSource):
    """spark.dataSource.register(SiteSource); spark.read.format("publication_site").options(...).load()"""

    @classmethod
    def name(cls):
        return "publication_site"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SiteReader(self.options)
