"""Queries of streams with state of their own and of tables with commits: each comes in several runs, out of order, and is restarted in between."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators.versioned import VersionedTable
from ..session import shared_folder
from ..sources import adapters as A
from ..sources import feed_stream, feeds
from ..streaming import stateful
from ..streaming.activity import run_available
from . import sql as S
from .composed import NEW, escaped, ingested, stored
from .queries import HEADLINE, moment
from .registry import query

RUNS = 3
#: Feeds of the live query, and of how many one is out of order in the second run.
FEEDS, BROKEN = 300, 7


def in_runs(events: DataFrame, folder: str) -> Iterator[int]:
    """Land the events under the folder in RUNS runs by time, each of them up to a day earlier or later than its own time."""
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000
    shifted = day + F.pmod(F.col("event_id") * 37, F.lit(48)) / 24 - 1
    first = events.agg(F.min(day).alias("least"), F.max(day).alias("most")).first()
    length = ((first["most"] or 0) - (first["least"] or 0)) / RUNS or 1
    run = F.greatest(F.lit(0), F.least(F.lit(RUNS - 1), F.floor((shifted - (first["least"] or 0)) / length))).cast("int")
    for k in range(RUNS):
        events.where(run == k).write.mode("append").parquet(folder)
        yield k


@query(S.with_(S.articles(), S.actions(), S.preferences()) + "SELECT user_id, topic_name, pillar_id, weight FROM preferences")
def stream_pref_weights(spark: SparkSession, d: str) -> DataFrame:
    """Preference weights of a stream of actions that come out of order: steps wait for the watermark, which moves on from run to run."""
    base, classes = shared_folder(spark, "weights"), shared_folder(spark, "classes")
    A.articles(spark, d).select("id", "pillar_id", "micro_tags").write.parquet(classes)
    acts, out = A.interactions(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), None
    for _ in in_runs(acts, f"{base}/in"):
        stream = spark.readStream.schema(acts.schema).parquet(f"{base}/in")
        weights = stateful.learned_weights(stateful.preference_steps(stream, spark.read.parquet(classes)), lateness="2 days")
        out = stateful.with_rocks(spark, lambda w=weights: run_available(w, base, keys=["user_id", "topic_name"]))
    return out.select("user_id", "topic_name", "pillar_id", F.round("weight", 6).alias("weight"))


@query(S.with_(S.beats(), S.progress()) + f"SELECT user_id, article_id, scroll_pct, duration_sec, completed, {S.moment('started_at')} AS started_at, {S.moment('updated_at')} AS updated_at FROM progress")
def stream_completion(spark: SparkSession, d: str) -> DataFrame:
    """Reading progress of a stream of heartbeats, merged batch by batch into a table with commits."""
    base = shared_folder(spark, "progress")
    beats, table = A.heartbeats(spark, d), VersionedTable(spark, f"{base}/table", ["user_id", "article_id"])
    for _ in in_runs(beats, f"{base}/in"):
        stateful.progress_into(spark.readStream.schema(beats.schema).parquet(f"{base}/in"), table, "beats", f"{base}/checkpoint")
    return stateful.progress_of(table).select("user_id", "article_id", "scroll_pct", "duration_sec", "completed", moment("started_at"), moment("updated_at"))


@query(S.with_(NEW) + f"SELECT url, title_hash, headline, pillar_id, {S.moment('published_at')} AS published_at FROM new_rows")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The ingest cycle as a stream into a table with commits: what it has already goes, and so does what comes a second time."""
    base = shared_folder(spark, "stream-ingest")
    table = VersionedTable(spark, f"{base}/table", ["title_hash"])
    raw = ingested(spark, d).select("source_rank", "feed", "pos", "url", "title_hash", "headline", "pillar_id", "published_at")
    table.append(raw.limit(0).unionByName(stored(spark, d), allowMissingColumns=True))
    for again in range(2):
        raw.write.parquet(f"{base}/in/run={again}")
        stateful.articles_into(spark.readStream.schema(raw.schema).parquet(f"{base}/in/*"), table, "articles", f"{base}/checkpoint", [F.col("source_rank"), F.col("feed"), F.col("pos")])
    return table.read().where("source_rank is not null").select("url", "title_hash", "headline", "pillar_id", moment("published_at"))


def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(folder, feed, body): bodies of feeds in the place of those before them. A try that is repeated writes the same again."""
    for frame in frames:
        for folder, feed, body in frame.itertuples(index=False):
            landing = feed_stream.Landing(folder)
            landing.files.create_dir(landing.root, recursive=True)
            with landing.files.open_output_stream(f"{landing.root}/{feed}.xml") as f:
                f.write(body.encode())
        yield frame[["feed"]]


@query(f"""WITH items AS (SELECT doc_id, {S.squeeze('headline')} AS title, doc_id % {FEEDS} AS f, doc_id // {FEEDS} % {RUNS} AS came FROM ({HEADLINE})), runs AS (SELECT unnest(range({RUNS})) AS run),
shown AS (SELECT *, row_number() OVER (PARTITION BY run, f ORDER BY came DESC, doc_id DESC) AS pos FROM items JOIN runs ON came <= run)
SELECT 'http://x/' || doc_id AS url, {S.fingerprint('title')} AS title_hash, title AS headline, min(run) + 1 AS turn FROM shown WHERE pos <= {feeds.ENTRIES_PER_FEED} AND NOT (run = 1 AND f % {BROKEN} = 0) AND title <> '' GROUP BY ALL""")
def stream_live_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The entries of live feeds, each once with the turn that it came with: feeds show their newest entries, which change from run to run."""
    base, docs = shared_folder(spark, "live"), A.table(spark, d, "documents")
    whole_base = feed_stream.qualified(spark, base)
    came = F.floor(F.col("doc_id") / FEEDS) % RUNS
    runs = docs.select("doc_id", (F.col("doc_id") % FEEDS).alias("f"), came.alias("came")).withColumn("run", F.explode(F.sequence(F.col("came"), F.lit(RUNS - 1).cast("long"))))
    newest = Window.partitionBy("run", "f").orderBy(F.desc("came"), F.desc("doc_id"))
    shown = runs.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= feeds.ENTRIES_PER_FEED).drop("came")
    held = docs.select("doc_id", "text").join(F.broadcast(shown), "doc_id")  # RUNS * FEEDS * ENTRIES_PER_FEED rows at most
    title = text.squeeze(text.opening(F.col("text")))
    item = F.concat(F.lit("<item><title>"), escaped(title), F.lit("</title><link>http://x/"), F.col("doc_id").cast("string"), F.lit("</link></item>"))
    listed = held.select("run", "f", F.struct("n", item.alias("x")).alias("x")).groupBy("run", "f").agg(F.array_sort(F.collect_list("x")).alias("items"))
    closing = F.when((F.col("run") != 1) | (F.col("f") % BROKEN != 0), "</channel></rss>").otherwise("")
    bodies = listed.select("run", F.lit(f"{whole_base}/site").alias("folder"), F.col("f").alias("feed"), F.concat(F.lit("<rss><channel>"), F.array_join("items.x", ""), closing).alias("body"))
    bodies.write.parquet(f"{base}/bodies")
    urls, out = [f"{whole_base}/site/{k}.xml" for k in range(FEEDS)], None
    for run in range(RUNS):
        now = spark.read.parquet(f"{base}/bodies").where(F.col("run") == run).select("folder", "feed", "body")
        now.mapInPandas(placed, "feed long").write.format("noop").mode("overwrite").save()
        items = feeds.capped(feed_stream.new_items(feed_stream.asked(spark, urls, f"{base}/landing", FEEDS, seconds=0)))
        out = run_available(items.select(F.col("link").alias("url"), text.title_fingerprint(F.col("title")).alias("title_hash"), F.col("title").alias("headline"), "turn"), base)
    return out
