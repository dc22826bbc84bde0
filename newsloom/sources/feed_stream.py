"""Live feeds as a stream: each trigger asks some of them, and each of their entries comes once.

A turn asks the next `feedsPerTrigger` feeds of the list, round and round; the offset is the number of the last turn. What a task gets
from a feed it lands under the shared folder before it hands it on, together with the validators of the answer and the entries known
so far. So the next question can be a conditional one, a turn that is run again after a failure reads what the first try has landed
and gives the same rows, and nothing of an answer passes through the driver.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feeds import ENTRIES_PER_FEED
from .http import FEEDS_PER_TASK, answer_of, items_of

TURNS, ANSWERS = "turns", "answers"
#: Answers of a feed for which an entry that is in it no more is still known, and so does not come again.
REMEMBERED = 50


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def entries_of(body: str) -> list[str]:
    """What tells the entries of an RSS or Atom body apart, in order: their identifier, else their address, else their title."""
    root = ElementTree.fromstring(body)
    found = []
    for entry in root.findall("channel/item") or root.findall("{*}entry"):
        named = (entry.findtext(f"{{*}}{tag}") for tag in ("guid", "id", "link"))
        href = next((link.get("href") for link in entry.findall("{*}link") if link.get("href")), None)
        found.append(_digest(next((n.strip() for n in named if n and n.strip()), None) or href or entry.findtext("{*}title") or ""))
    return found


def next_answer(last: dict, body: str | None, failure: str | None, etag: str | None, modified: str | None) -> dict:
    """The answer as it is landed: a body only if some of its first entries are new, whose places (from 1) are `fresh`.

    No body and no failure means that nothing has changed. A feed that fails keeps its validators and entries until it answers again.
    """
    keys: list[str] = []
    if body is not None:
        try:
            keys = entries_of(body)[:ENTRIES_PER_FEED]
        except ElementTree.ParseError as e:
            body, failure = None, type(e).__name__
    if body is None:
        return {**last, "body": None, "fresh": [], "failure": failure}
    count, known, fresh = last.get("count", 0) + 1, dict(last.get("known", {})), []
    for place, key in enumerate(keys, 1):
        if key not in known:
            fresh.append(place)
        known[key] = count
    known = {k: n for k, n in known.items() if n > count - REMEMBERED}
    return {"etag": etag, "modified": modified, "count": count, "known": known, "body": body if fresh else None, "fresh": fresh, "failure": None}


class Landing:
    """Small files under a folder that the driver and all executors see."""

    def __init__(self, folder: str):
        from pyarrow import fs

        if folder.startswith("file:"):
            folder = "/" + folder.removeprefix("file:").lstrip("/")
        self.files, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self._local = isinstance(self.files, fs.LocalFileSystem)
        self._chosen = fs.FileSelector

    def numbers(self, folder: str) -> list[int]:
        """The files of a folder, which are named by numbers."""
        found = self.files.get_file_info(self._chosen(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def read(self, name: str) -> dict:
        with self.files.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def written(self, name: str, content: dict) -> dict:
        """Write a file unless it is there already; what it has now. A file is whole before it gets its name.

        Where a file system lets a second file take the place of the first (object stores do), keep speculative tasks off.
        """
        path = f"{self.root}/{name}"
        part = f"{path}.{uuid.uuid4().hex}"
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(content).encode())
        try:
            if self._local:
                os.link(part, path)
                self.files.delete_file(part)
            else:
                self.files.move(part, path)
        except OSError:  # another has been first
            self.files.delete_file(part)
        return self.read(name)

    def removed(self, folder: str, numbers: list[int], before: int) -> None:
        for n in numbers:
            if n < before:
                try:
                    self.files.delete_file(f"{self.root}/{folder}/{n:012d}")
                except FileNotFoundError:  # so has another
                    pass


class TurnPartition(InputPartition):
    def __init__(self, asked: list[tuple[str, int]]):
        super().__init__(None)
        self.asked = asked


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, urls: list[str], folder: str, per_turn: int, seconds: float):
        self.urls, self.folder, self.per_turn, self.seconds = urls, folder, per_turn, seconds
        self._begun: float | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"turn": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """A new turn, unless the last one of this run began less than `seconds` ago.

        Its number is written before it is handed out, so no later run of the query, whatever became of this one, goes back behind it.
        """
        landing = Landing(self.folder)
        known = landing.numbers(TURNS)
        turn = known[-1] if known else 0
        if self._begun is None or time.monotonic() - self._begun >= self.seconds:
            turn += 1
            landing.written(f"{TURNS}/{turn:012d}", {})
            landing.removed(TURNS, known, turn - 1)
            self._begun = time.monotonic()
        return {"turn": turn}

    def partitions(self, start: dict, end: dict) -> list[TurnPartition]:
        """The feeds of the turns after start, each once and in its last turn of them."""
        turn_of: dict[str, int] = {}
        n = len(self.urls)
        rounds = -(-n // self.per_turn)  # so many turns come to every feed; those before them ask none that these don't
        for turn in range(max(start["turn"], end["turn"] - rounds) + 1, end["turn"] + 1):
            first = (turn - 1) * self.per_turn
            turn_of |= {self.urls[i % n]: turn for i in range(first, first + min(n, self.per_turn))}
        asked = list(turn_of.items())
        return [TurnPartition(asked[i : i + FEEDS_PER_TASK]) for i in range(0, len(asked), FEEDS_PER_TASK)]

    def read(self, partition: TurnPartition) -> Iterator[tuple]:
        landing = Landing(self.folder)
        for url, turn in partition.asked:
            folder = f"{ANSWERS}/{_digest(url)}"
            known = landing.numbers(folder)
            if turn in known:
                answer = landing.read(f"{folder}/{turn:012d}")
            else:
                before = [n for n in known if n < turn]
                last = landing.read(f"{folder}/{before[-1]:012d}") if before else {}
                got = next_answer(last, *answer_of(url, last.get("etag"), last.get("modified")))
                at = datetime.datetime.now(datetime.UTC).isoformat()
                answer = landing.written(f"{folder}/{turn:012d}", got | {"at": at})
                if before:
                    landing.removed(folder, known, before[-1])
            if answer["body"] is not None or answer["failure"] is not None:
                yield url, turn, datetime.datetime.fromisoformat(answer["at"]), answer["body"], answer["fresh"], answer["failure"]


class FeedStreamSource(DataSource):
    """Options: urls, one to a line; folder, which all executors see; feedsPerTrigger; seconds between turns."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_feed_stream"

    def schema(self) -> str:
        return "feed string, turn long, asked_at timestamp, body string, fresh array<int>, failure string"

    def streamReader(self, schema) -> FeedStreamReader:  # noqa: N802
        urls = dict.fromkeys(u for u in self.options.get("urls", "").split("\n") if u)
        return FeedStreamReader(list(urls), self.options["folder"], int(self.options["feedsPerTrigger"]), float(self.options["seconds"]))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its file system, as executors need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def asked(spark: SparkSession, urls: list[str], folder: str, feeds_per_trigger: int = 500, seconds: float = 60.0) -> DataFrame:
    """A stream of (feed, turn, asked_at, body, fresh, failure): a row for each feed that has new entries or fails when it is asked.

    The list may change between runs of a query; the folder belongs to one query and has to stay as long as its checkpoint.
    """
    if feeds_per_trigger < 1:
        raise ValueError("a trigger has to ask one feed at least")
    spark.dataSource.register(FeedStreamSource)
    options = {"urls": "\n".join(urls), "folder": qualified(spark, folder), "feedsPerTrigger": str(feeds_per_trigger), "seconds": str(seconds)}
    return spark.readStream.format("newsloom_feed_stream").options(**options).load()


def new_items(answers: DataFrame) -> DataFrame:
    """(feed, turn, asked_at, pos, ITEM) of the entries that are new in each answer."""
    return items_of(answers.where("body is not null"), also=["turn", "asked_at", "fresh"]).where(F.array_contains("fresh", F.col("pos"))).drop("fresh")
