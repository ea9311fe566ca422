"""A paged HTTP JSON API as a Spark data source: pages are counted once and read in parallel.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("url", "http://host/api/users/0/items/top").load()

A page is asked for with ``format``, ``limit`` and ``start``; the header ``Total-Results`` says how many records there
are. Without it, pages are read one after another until one is short. Each record is a row with its JSON text.

As a stream, the offset is the library's version (header ``Last-Modified-Version``): a batch asks for the records that are
``since`` the last one, in the order in which they were added, so that a record that changes meanwhile moves no other to
another page. A record that is newer than the batch's end is left for the next one, so each state that is read is read once.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

TIMEOUT = 30


class Unreachable(OSError):
    """The API does not answer."""


class BadStatus(ValueError):
    """The API answers with a status other than 200."""


class BadJson(ValueError):
    """The answer is no JSON array."""


def fetch(url: str, start: int, limit: int, more: dict[str, str]) -> tuple[list, int | None]:
    """Records, and how many there are in all."""
    rows, headers = answer_of(url, start, limit, more)
    total = headers.get("Total-Results")
    return rows, int(total) if total and total.isdigit() else None


def answer_of(url: str, start: int, limit: int, more: dict[str, str]) -> tuple[list, Mapping[str, str]]:
    query = urllib.parse.urlencode({"format": "json", "limit": limit, "start": start} | more)
    try:
        with urllib.request.urlopen(f"{url}{'&' if '?' in url else '?'}{query}", timeout=TIMEOUT) as answer:
            body, headers = answer.read(), answer.headers
            if answer.status != 200:
                raise BadStatus(f"{url}: {answer.status}")
    except urllib.error.HTTPError as e:
        raise BadStatus(f"{url}: {e.code}") from e
    except OSError as e:
        raise Unreachable(f"{url}: {e}") from e
    try:
        rows = json.loads(body)
    except ValueError as e:
        raise BadJson(f"{url}: {e}") from e
    if not isinstance(rows, list):
        raise BadJson(f"{url}: no array")
    return rows, headers


class Page(InputPartition):
    def __init__(self, start: int, to_end: bool):
        self.start, self.to_end = start, to_end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.limit, self.more = options["url"], int(options.get("limit", 100)), {}
        if options.get("itemtype"):
            self.more["itemType"] = options["itemtype"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A test of the record's type is left to the server."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("item_type",):
                self.more["itemType"] = f.value
            yield f

    def partitions(self) -> list[Page]:
        rows, total = fetch(self.url, 0, self.limit, self.more)
        if total is None:
            return [Page(0, True)]
        return [Page(at, False) for at in range(0, max(total, 1), self.limit)]

    def read(self, page: Page) -> Iterator[tuple]:
        at = page.start
        while True:
            rows, _ = fetch(self.url, at, self.limit, self.more)
            for n, r in enumerate(rows):
                yield at + n, kind_of(r), json.dumps(r, ensure_ascii=False)
            at += len(rows)
            if not page.to_end or len(rows) < self.limit:
                return


def kind_of(record: object) -> str | None:
    return record.get("data", {}).get("itemType") if isinstance(record, dict) and isinstance(record.get("data"), dict) else None


class ChangedPage(InputPartition):
    def __init__(self, start: int, since: int, until: int):
        self.start, self.since, self.until = start, since, until


class ChangeReader(DataSourceStreamReader):
    """Records by the version of their last change."""

    def __init__(self, options: dict):
        self.url, self.limit = options["url"], int(options.get("limit", 100))
        self.first = int(options.get("since", 0))
        self.more = {"sort": "dateAdded", "direction": "asc"} | ({"itemType": options["itemtype"]} if options.get("itemtype") else {})

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        _, headers = answer_of(self.url, 0, 1, self.more)
        version = headers.get("Last-Modified-Version")
        if not version or not version.isdigit():
            raise BadStatus(f"{self.url}: no version to go on from")
        return {"version": int(version)}

    def partitions(self, start: dict, end: dict) -> list[ChangedPage]:
        since, until = start["version"], end["version"]
        if since >= until:
            return []
        _, total = fetch(self.url, 0, 1, self.more | {"since": str(since)})
        return [ChangedPage(at, since, until) for at in range(0, total or 0, self.limit)]

    def read(self, page: ChangedPage) -> Iterator[tuple]:
        rows, _ = fetch(self.url, page.start, self.limit, self.more | {"since": str(page.since)})
        for n, r in enumerate(rows):
            version = r.get("version") if isinstance(r, dict) else None
            if isinstance(version, int) and page.since < version <= page.until:
                yield page.start + n, kind_of(r), json.dumps(r, ensure_ascii=False)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "position long, item_type string, value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options)
