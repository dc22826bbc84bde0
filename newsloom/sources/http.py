"""Live feeds as a data source: one row per feed, with its body or with what failed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .feeds import ATOM_ENTRY, RSS_ITEM, atom_entry, rss_item

#: Feeds that one task pulls, seconds that it waits for each, and bytes that a body may have.
FEEDS_PER_TASK, TIMEOUT, MOST_BYTES = 10, 15, 64 << 20


class TooLargeError(Exception):
    """A body of more than MOST_BYTES."""


def answer_of(url: str, etag: str | None = None, modified: str | None = None) -> tuple[str | None, str | None, str | None, str | None]:
    """(body, failure, ETag, Last-Modified) of a feed; neither body nor failure if it says that it is as it was at the validators given."""
    import urllib.error
    import urllib.request

    try:
        request = urllib.request.Request(url)  # noqa: S310  the registry names the addresses
        for name, value in (("If-None-Match", etag), ("If-Modified-Since", modified)):
            if value:
                request.add_header(name, value)
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:  # noqa: S310
            status = getattr(answer, "status", None)
            if status not in (None, 200):
                return None, f"status {status}", None, None
            raw = answer.read(MOST_BYTES + 1)
            if len(raw) > MOST_BYTES:
                raise TooLargeError
            if getattr(answer, "length", None):  # bytes that were announced and have not come
                return None, "IncompleteRead", None, None
            return raw.decode("utf-8", "replace"), None, answer.headers.get("ETag"), answer.headers.get("Last-Modified")
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return None, None, etag, modified
        return None, type(e).__name__, None, None
    except Exception as e:  # noqa: BLE001  no feed, however it fails, keeps the others from being read
        return None, type(e).__name__, None, None


class FeedPartition(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(None)
        self.urls = urls


class FeedReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[FeedPartition]:
        return [FeedPartition(self.urls[i : i + FEEDS_PER_TASK]) for i in range(0, len(self.urls), FEEDS_PER_TASK)] or [FeedPartition([])]

    def read(self, partition: FeedPartition) -> Iterator[tuple[str, str | None, str | None]]:
        for url in partition.urls:
            yield (url, *answer_of(url)[:2])


class FeedSource(DataSource):
    """Options: urls, one to a line."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_feeds"

    def schema(self) -> str:
        return "feed string, body string, failure string"

    def reader(self, schema) -> FeedReader:
        return FeedReader([u for u in self.options.get("urls", "").split("\n") if u])


def asked_for(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(feed, body, failure) of every feed: a body, or what kept it from being there (an error's name or a status)."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("newsloom_feeds").option("urls", "\n".join(urls)).load()


def pulled(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(feed, body) of the feeds that answer."""
    return asked_for(spark, urls).where("body is not null").select("feed", "body")


def items_of(bodies: DataFrame, body: Column | None = None, also: Sequence[str] = ()) -> DataFrame:
    """The items of RSS and Atom bodies with their position, in the shape that `feeds.capped` takes, and what else of the bodies' columns is asked for."""
    parsed = F.from_xml(F.col("body") if body is None else body, F.lit(f"channel struct<item: array<struct<{RSS_ITEM}>>>, entry array<struct<{ATOM_ENTRY}>>"))
    each = F.coalesce(F.transform(parsed["channel"]["item"], rss_item), F.transform(parsed["entry"], atom_entry))
    return bodies.select("feed", *also, F.posexplode(each).alias("pos", "i")).select("feed", *also, (F.col("pos") + 1).alias("pos"), "i.*")
