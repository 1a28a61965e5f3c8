"""Python data sources over fetched list pages and read-API pages, as a crawler left them in a shared folder.

* `listing`: pages of known number, `page-<n>.html`; batch, and stream with the number of pages read as its offset. A partition reads
  `pagesPerPartition` pages, by default 8, or more where that would make above 256 partitions.
* `listing_walk`: listings whose pages name the pages to read next; a partition walks one listing.
* `feed`: JSON pages that name the next one by a cursor; a partition follows one feed.

Filters on `page`, `listing` and `feed` are pushed down, so other files are never opened. A page that is missing is an
error, never a silent end: a gap in a listing, a page that another one names, a cursor that leads nowhere or in a circle.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from marlstone.sources.files import opened

#: How a listing names its entries and its pages, and how many pages of it are read.
ENTRY, PAGING, LISTING_PAGES = r"fnView\('[^']*',\s*(\d+)\)", r"fnPaging\(\s*'(\d+)'\s*\)", 50


def body(path: str, name: str) -> str:
    """A file's text; FileNotFoundError where it is missing."""
    system, root = opened(path)
    with system.open_input_stream(f"{root}/{name}") as f:
        return f.read().decode("utf-8", "replace")


def names(path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    from pyarrow import fs

    system, root = opened(path)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)))


#: Partitions that a range of pages is dealt over at most, and pages that one of them reads at least, unless the caller says otherwise.
MOST_PARTITIONS, LEAST_PAGES = 256, 8


@dataclass
class Pages(InputPartition):
    first: int
    last: int


def dealt(first: int, last: int, step: int | None) -> list[Pages]:
    """Partitions of the pages from `first` to `last`; their number doesn't grow with that of the pages beyond a bound."""
    step = step or max(LEAST_PAGES, -(-(last - first + 1) // MOST_PARTITIONS))
    return [Pages(a, min(a + step - 1, last)) for a in range(first, last + 1, step)]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", ENTRY)
        self.first, self.last, self.step = 1, int(options.get("pages", 1)), int(options.get("pagesPerPartition", 0))

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("page",) and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                if not isinstance(f, LessThanOrEqual):
                    self.first = max(self.first, int(f.value))
                if not isinstance(f, GreaterThanOrEqual):
                    self.last = min(self.last, int(f.value))
            else:
                yield f

    def partitions(self):
        return dealt(self.first, self.last, self.step) or [Pages(1, 0)]

    def read(self, part: Pages) -> Iterator[tuple]:
        return entries(self.path, self.pattern, part)


def entries(path: str, pattern: str, part: Pages) -> Iterator[tuple]:
    """(page, ord, ref) of a range of pages."""
    for n in range(part.first, part.last + 1):
        for ord_, m in enumerate(re.finditer(pattern, body(path, f"page-{n}.html"))):
            yield n, ord_, m.group(1)


class ListingStream(DataSourceStreamReader):
    """Pages from 1 on as they are written; the offset is the last page that is there together with all before it."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.step = options["path"], options.get("pattern", ENTRY), int(options.get("pagesPerPartition", 0))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        have = {int(m[1]) for n in names(self.path) if (m := re.fullmatch(r"page-(\d+)\.html", n))}
        last = max(have, default=0)
        if len(have) != last:
            raise FileNotFoundError(f"page {min(set(range(1, last + 1)) - have)} of {last} is missing in {self.path}")
        return {"page": last}

    def partitions(self, start: dict, end: dict):
        return dealt(start["page"] + 1, end["page"], self.step)

    def read(self, part: Pages) -> Iterator[tuple]:
        return entries(self.path, self.pattern, part)

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "page int, ord int, ref string"

    def reader(self, schema):
        return ListingReader(self.options)

    def streamReader(self, schema):
        return ListingStream(self.options)


@dataclass
class Folder(InputPartition):
    name: str


class FolderReader(DataSourceReader):
    """A reader with a partition for each folder below `path`, or for those that a filter on `column` names."""

    column = ""

    def __init__(self, options: dict):
        self.path, self.only = options["path"], None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,) and isinstance(f, (EqualTo, In)):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self):
        have = [n for n in names(self.path) if self.only is None or n in self.only]
        return [Folder(n) for n in have] or [Folder("")]


class ListingWalkReader(FolderReader):
    column = "listing"

    def __init__(self, options: dict):
        super().__init__(options)
        self.pattern, self.paging, self.most = options.get("pattern", ENTRY), options.get("paging", PAGING), int(options.get("pages", LISTING_PAGES))

    def read(self, part: Folder) -> Iterator[tuple]:
        """(listing, page, ord, ref): from page 1 on, pages in the order in which they are named; a repeated ref counts once."""
        if not part.name:
            return
        seen, queue, found = {1}, deque([1]), set()
        while queue:
            n = queue.popleft()
            text = body(f"{self.path}/{part.name}", f"page-{n}.html")
            for ord_, m in enumerate(re.finditer(self.pattern, text)):
                if m.group(1) not in found:
                    found.add(m.group(1))
                    yield part.name, n, ord_, m.group(1)
            for to in sorted({int(m.group(1)) for m in re.finditer(self.paging, text)}):
                if 1 <= to <= self.most and to not in seen:
                    seen.add(to)
                    queue.append(to)


class ListingWalk(DataSource):
    @classmethod
    def name(cls):
        return "listing_walk"

    def schema(self):
        return "listing string, page int, ord int, ref string"

    def reader(self, schema):
        return ListingWalkReader(self.options)


class FeedReader(FolderReader):
    column = "feed"

    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options["max"]) if "max" in options else None

    def read(self, part: Folder) -> Iterator[tuple]:
        """(feed, page, ord, event): the events of a feed's pages, at most `max` of them, as JSON."""
        if not part.name:
            return
        cursor, seen, n, left = "first", set(), 0, self.most
        while cursor:
            if cursor in seen:
                raise ValueError(f"feed {part.name} names cursor {cursor} twice")
            seen.add(cursor)
            n += 1
            got = json.loads(body(f"{self.path}/{part.name}", f"{cursor}.json"))
            for ord_, event in enumerate(got.get("data") or []):
                if left == 0:
                    return
                left = None if left is None else left - 1
                yield part.name, n, ord_, json.dumps(event, ensure_ascii=False)
            cursor = (got.get("page") or {}).get("next_cursor")


class Feed(DataSource):
    @classmethod
    def name(cls):
        return "feed"

    def schema(self):
        return "feed string, page int, ord int, event string"

    def reader(self, schema):
        return FeedReader(self.options)


REGISTRY: dict[str, type[DataSource]] = {c.name(): c for c in (Listing, ListingWalk, Feed)}


def register(spark: SparkSession) -> None:
    """Makes the sources known by name; a later registration of a name replaces an earlier one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in REGISTRY.values():
        spark.dataSource.register(source)
