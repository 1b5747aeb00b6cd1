"""Paged feeds as a Spark source: pages name the cursor of the next, which is known only when a page is there.

A feed can't be read by several tasks, but feeds can: they are dealt out as partitions. In
each, the cursor is followed until a page names none, one that an earlier run has seen (``known``), or one
that this run has seen (a feed that turns back on itself). A feed of more pages than the
bound is an error, not cut. Here pages are files; ``fetch`` may be any function from
(feed, cursor) to a page.

A page: ``{"items": [{"href": ..., "title": ...}, ...], "next": cursor or null}``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lexiforge.sources import files

FIRST = "first"
SCHEMA = "feed string, page int, cursor string, position int, href string, title string"
#: A title that is a number only; another one of the same target is better.
COUNT_ONLY = r"\A[٠-٩۰-۹0-9,٬\s]+\z"


class FeedError(RuntimeError):
    """A feed can't be read whole."""


class Feeds(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, str], dict | None] | None):
        self.path, self.fetch = options.get("path", ""), fetch or self.from_files
        self.feeds = json.loads(options["feeds"])
        self.known = json.loads(options.get("known", "{}"))
        self.pages, self.tasks = int(options.get("pages", "10000")), int(options.get("tasks", "8"))

    def partitions(self) -> list[Feeds]:
        parts: dict[int, list[str]] = {}
        for feed in self.feeds:
            parts.setdefault(zlib.crc32(feed.encode()) % self.tasks, []).append(feed)
        return [Feeds(sorted(names)) for names in parts.values()] or [Feeds([])]

    def from_files(self, feed: str, cursor: str) -> dict | None:
        store, folder = files.opened(self.path)
        found = [f for f in files.listed(store, f"{folder}/feed={feed}/cursor={cursor}") if f.endswith(".json")]
        return json.loads(files.read(store, found[0])) if found else None

    def read(self, partition: Feeds) -> Iterator[tuple]:
        for feed in partition.names:
            cursor, seen, stop, page = FIRST, set(), self.known.get(feed), 0
            while cursor is not None and cursor != stop and cursor not in seen:
                if page >= self.pages:
                    raise FeedError(f"{feed} has more than {self.pages} pages")
                seen.add(cursor)
                found = self.fetch(feed, cursor)
                if found is None:
                    raise FeedError(f"{feed} has no page {cursor}")
                for position, item in enumerate(found.get("items") or ()):
                    yield feed, page, cursor, position, item.get("href"), item.get("title")
                cursor, page = found.get("next"), page + 1


def paged_feed(fetch: Callable[[str, str], dict | None] | None = None) -> type[DataSource]:
    """A source named ``paged_feed``; options: path, feeds (JSON array), known (JSON object of cursors), pages, tasks."""

    class PagedFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_feed"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return FeedReader(self.options, fetch)

    return PagedFeed


def read_feeds(spark: SparkSession, path: str, feeds: list[str], known: dict[str, str] | None = None, pages: int = 10_000, tasks: int = 8, fetch: Callable[[str, str], dict | None] | None = None) -> DataFrame:
    """(feed, page, cursor, position, href, title) of all items of the feeds up to their known cursors."""
    spark.dataSource.register(paged_feed(fetch))
    options = {"path": path, "feeds": json.dumps(feeds), "known": json.dumps(known or {}), "pages": str(pages), "tasks": str(tasks)}
    return spark.read.format("paged_feed").options(**options).load()


def write_feed(items: DataFrame, path: str) -> None:
    """Pages as files; ``items``: (feed, cursor, next, position, href, title)."""
    listed = F.array_sort(F.collect_list(F.struct("position", "href", "title")))
    pages = items.groupBy("feed", "cursor").agg(listed.alias("items"), F.first("next", ignorenulls=True).alias("next"))
    pages.repartition("feed", "cursor").write.mode("error").partitionBy("feed", "cursor").json(path)


def merged(items: DataFrame) -> DataFrame:
    """(feed, href, title, repeats, conflict): each target once, under its first title that isn't a number only, else its first; conflict if it has other titles."""
    only_count = F.coalesce(F.col("title").rlike(COUNT_ONLY), F.lit(True))
    title = F.min_by("title", F.struct(only_count, "page", "position"))
    named = F.when(~only_count, F.col("title"))
    return items.where("href IS NOT NULL").groupBy("feed", "href").agg(title.alias("title"), (F.count("*") - 1).alias("repeats"), F.coalesce(F.min(named) != F.max(named), F.lit(False)).alias("conflict"))
