"""Streams whose state is their own: preference weights in the order of events, reading progress and articles in tables with commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup
from ..operators.activity import FINISHED
from ..operators.preferences import DELTAS, HIGHEST, LOWEST, START, TAGS_PER_ARTICLE
from ..operators.versioned import VersionedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEIGHTS = "user_id long, topic_name string, pillar_id int, weight double"
WEIGHT = Row("user_id", "topic_name", "pillar_id", "weight")


def preference_steps(actions: DataFrame, articles: DataFrame) -> DataFrame:
    """(user_id, ts, at, event_id, d, pillar_id, topics): the stream of actions with what each adds to which topics.

    articles: id, pillar_id, micro_tags, a table; best one that has its classes stored, as every batch reads it.
    """
    tagged = articles.select(F.col("id").alias("article_id"), "pillar_id", F.slice("micro_tags", 1, TAGS_PER_ARTICLE).alias("topics")).where(F.size("topics") > 0)
    delta = F.element_at(F.create_map(*[F.lit(x) for kv in DELTAS.items() for x in kv]), F.col("action"))
    return actions.join(tagged, "article_id").select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", delta.alias("d"), "pillar_id", "topics")


class _Weights(StatefulProcessor):
    """A user's weights up to the watermark, and the steps after it, which wait for those that may still come before them.

    What is handed on after each batch are the weights with all steps so far, in the order of (ts, event_id). Once the
    watermark has passed a step nothing can come before it any more: it goes into the weights, so what waits is bounded by the
    actions within the lateness. Each state is one value with a list for each part, as a user's are only read and written whole.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weights = handle.getValueState("weights", "topic array<string>, pillar_id array<int>, weight array<int>")
        self.waiting = handle.getValueState("waiting", "step array<array<long>>, topics array<array<string>>")  # step: at, event_id, d, pillar_id

    @staticmethod
    def _moved(weights: dict, steps: list[tuple]) -> None:
        for (_, _, d, pillar), topics in steps:
            for topic in topics:
                first, weight = weights.get(topic, (pillar, START))
                weights[topic] = (first, max(LOWEST, min(HIGHEST, weight + d)))

    def _known(self) -> dict:
        stored = self.weights.get()
        return {topic: (pillar, weight) for topic, pillar, weight in zip(*stored)} if stored else {}

    def _steps(self) -> list[tuple]:
        """Those that wait, in their order."""
        stored = self.waiting.get()
        return list(zip(*stored)) if stored else []

    @staticmethod
    def _in_lists(rows: list[tuple]) -> tuple:
        return tuple(map(list, zip(*rows)))

    def _wait_for(self, steps: list[tuple]) -> None:
        self.handle.registerTimer(-(-steps[0][0][0] // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self._steps()
        steps = {(s[0], s[1]): (s, topics) for s, topics in before}  # an event that comes twice counts once
        for _, _, s, topics in rows:
            steps[s[0], s[1]] = (s, topics)
        now = [steps[k] for k in sorted(steps)]
        if not before or now[0][0][:2] != before[0][0][:2]:
            self._wait_for(now)
        self.waiting.update(self._in_lists(now))
        weights = self._known()
        self._moved(weights, now)
        for topic, (pillar, weight) in weights.items():
            yield WEIGHT(key[0], topic, pillar, weight / 10)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        steps = self._steps()
        settled, rest = [s for s in steps if s[0][0] <= passed], [s for s in steps if s[0][0] > passed]
        if settled:
            weights = self._known()
            self._moved(weights, settled)
            self.weights.update(self._in_lists([(t, p, w) for t, (p, w) in weights.items()]))
            if rest:
                self.waiting.update(self._in_lists(rest))
            else:
                self.waiting.clear()
        if rest:
            self._wait_for(rest)
        yield from ()

    def close(self) -> None:
        pass


def learned_weights(steps: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(user_id, topic_name, pillar_id, weight) of every user with new actions, after each batch; the last row of a user and topic counts.

    Equal to the weights of all actions in their order, however they come, as long as none is later than the lateness: those are
    dropped. Actions without a time are dropped too. Repeated events count once while they wait.
    """
    step = F.array(*(F.col(c).cast("long") for c in ("at", "event_id", "d", "pillar_id")))  # one list: each field of a row costs its own time in Python
    known = steps.where("ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), step.alias("step"), "topics")
    return known.withWatermark("ts", lateness).groupBy("user_id").transformWithState(_Weights(), WEIGHTS, "Update", "EventTime")


def with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """run() while streams that start keep their state in RocksDB, which those with several states need; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


# Tables that streams write to


def _progress(beats: DataFrame) -> DataFrame:
    return beats.groupBy("user_id", "article_id").agg(
        F.max("scroll_pct").alias("scroll_pct"), F.sum("duration_sec").alias("duration_sec"), F.sum("beats").alias("beats"), F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at")
    )


def progress_into(beats: DataFrame, table: VersionedTable, name: str, checkpoint: str) -> None:
    """Bring the heartbeats that are there now into a table of (user_id, article_id, scroll_pct, duration_sec, beats, started_at, updated_at).

    Each batch is summed up first, then merged into the files that have its readers, in one commit under the batch's number: a batch
    that is run again after a failure finds its number and changes nothing. The stream itself keeps no state.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.select("user_id", "article_id", "scroll_pct", "duration_sec", F.lit(1).cast("long").alias("beats"), F.col("ts").alias("started_at"), F.col("ts").alias("updated_at"))
        summed = _progress(own).persist()
        try:
            table.merge(summed, lambda old, new: _progress(old.unionByName(new)), batch=(name, number))
        finally:
            summed.unpersist()

    beats.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress_of(table: VersionedTable, strict_completion: bool = False) -> DataFrame:
    """What activity.reading_progress says of all heartbeats so far: a read once complete stays so, as neither depth nor beats go down."""
    done = F.col("scroll_pct") >= FINISHED
    return table.read().withColumn("completed", done if strict_completion else done & (F.col("beats") >= 2)).drop("beats")


def articles_into(raw: DataFrame, table: VersionedTable, name: str, checkpoint: str, order: list[Column]) -> None:
    """Bring the raw articles that are there now into a table by title_hash, none whose hash or address it has already.

    Of copies within a batch the first in the order stays, of those in several batches the one of the first batch. Each batch is one
    commit under its number, so batches that are run again insert nothing twice.
    """

    def insert(batch: DataFrame, number: int) -> None:
        known = table.read().select("title_hash", "url") if table.snapshot() else batch.limit(0)
        table.append(dedup.new_articles(batch, known, order), batch=(name, number))

    raw.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
