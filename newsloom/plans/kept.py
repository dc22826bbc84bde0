"""Queries of what is stored so that later reads are cheap: tables by their keys, feeds by deltas, postings, totals of days."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import activity, browse, feed, feed_delta, layout, rollups, search_index
from ..operators.versioned import VersionedTable
from ..session import shared_folder
from ..sources import adapters as A
from . import sql as S
from .queries import moment
from .registry import query

#: Days before the last one at which feeds were refreshed earlier.
REFRESHED = (2, 1)


@query(S.with_(S.plain_articles(), S.actions(), S.beats(), S.progress()) + f""", kept AS (SELECT 'bookmark' AS kind, user_id, article_id, max(ts) AS at FROM actions WHERE action = 'save' GROUP BY ALL HAVING count(*) % 2 = 1
UNION ALL SELECT CASE WHEN completed THEN 'finished' ELSE 'begun' END, user_id, article_id, updated_at FROM progress)
SELECT kind, user_id, article_id, {S.moment('k.at')} AS at, headline, 'global' AS scope FROM kept k JOIN articles a ON a.id = k.article_id""")
def clustered_reading_list(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks and reads with their articles, from stored tables that are in buckets of the article: the joins shuffle nothing."""
    rows = {
        "articles": A.articles(spark, d, classified=False).drop("is_trending", "sentiment", "full_body"),
        "bookmarks": browse.bookmarks(A.interactions(spark, d)),
        "reading_progress": activity.reading_progress(A.heartbeats(spark, d)),
    }
    stored = layout.stored_together(spark, shared_folder(spark, "clustered"), {n: schemas.conformed(df, n) for n, df in rows.items()}, f"clustered_{uuid.uuid4().hex}")
    articles = stored["articles"].read().select(F.col("id").alias("article_id"), "headline", "scope")
    marks = stored["bookmarks"].read().select(F.lit("bookmark").alias("kind"), "user_id", "article_id", F.col("saved_at").alias("at"))
    reads = stored["reading_progress"].read().select(F.when(F.col("completed"), "finished").otherwise("begun").alias("kind"), "user_id", "article_id", F.col("updated_at").alias("at"))
    both = marks.join(articles, "article_id").unionByName(reads.join(articles, "article_id"))
    return both.select("kind", "user_id", "article_id", moment("at"), "headline", "scope")


@query(S.with_(S.articles(), S.actions(), S.preferences(), S.feed()) + "SELECT user_id, article_id, score FROM feed")
def feed_after_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The feeds as three refreshes leave them, each of which scores only what has changed; classes are worked out once."""
    base = shared_folder(spark, "deltas")
    A.articles(spark, d).select("id", "published_at", "is_trending", "pillar_id", "micro_tags").write.parquet(f"{base}/classes")
    articles, acts = spark.read.parquet(f"{base}/classes"), A.interactions(spark, d)

    def newest(until):
        return feed.candidates(articles if until is None else articles.where(F.col("published_at") <= until), A.as_of() if until is None else until)

    kept = before = None
    for run, days in enumerate((*REFRESHED, None)):
        until = None if days is None else A.as_of() - F.expr(f"INTERVAL {days} DAYS")
        known = acts if until is None else acts.where(F.col("ts") < until)
        if kept is None:
            kept = feed_delta.first(known, articles, newest(until))
        else:
            kept = feed_delta.refreshed(kept, known.where(F.coalesce(F.col("ts") >= before, F.lit(True))), known, articles, newest(until))
        kept, before = kept.stored(spark, f"{base}/run={run}"), until
    engaged = newest(None).join(feed.engagement(acts), "id", "left").withColumn("engagement", F.coalesce("engagement", F.lit(0)))
    return feed_delta.shown(kept, engaged, A.as_of())


@query(S.with_(S.plain_articles()) + """, w AS (SELECT text, string_split(text, ' ') AS ws FROM benchmark),
queries AS (SELECT DISTINCT q AS query FROM (SELECT unnest([array_to_string(ws[1:3], ' '), ws[4], left(text, 2)]) AS q FROM w) WHERE q <> '')
SELECT query, row_number() OVER (PARTITION BY query ORDER BY published_at DESC, id DESC) AS rank, id FROM queries JOIN articles ON contains(lower(headline), lower(query)) OR contains(lower(full_body), lower(query))
QUALIFY rank <= 25""")
def search_many(spark: SparkSession, d: str) -> DataFrame:
    """A search for each passage of the benchmark's first three words, its fourth word and its first two characters, by postings, from the newest articles on."""
    words = F.split("text", " ")
    asked = F.array(F.array_join(F.slice(words, 1, 3), " "), F.get(words, F.lit(3)), F.substring("text", 1, 2))
    queries = A.table(spark, d, "benchmark").select(F.explode(asked).alias("query")).where("query <> ''").distinct()
    articles = A.articles(spark, d, classified=False).select("id", "headline", "full_body", "published_at")
    return search_index.search_newest(articles, queries, shared_folder(spark, "postings"))


@query(f"""WITH acts AS (SELECT ts, user_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'save' END AS action, greatest(0, least(60, floor(value)))::BIGINT AS duration_sec FROM events)
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS span, count(*) AS n_actions, count(*) FILTER (action = 'read') AS n_reads, count(*) FILTER (action = 'save') AS n_saves, sum(duration_sec)::BIGINT AS duration_sec, count(DISTINCT user_id) AS n_users FROM acts GROUP BY 1""")
def weekly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Weeks from stored days: a tenth of the actions comes late, and that batch comes twice. Users are counted from who was there on which day."""
    acts = A.timed_actions(spark, d)
    late = F.pmod(F.col("event_id") * 37, F.lit(10)) == 0
    base = shared_folder(spark, "days")
    days, users = VersionedTable(spark, f"{base}/table", ["day"]), VersionedTable(spark, f"{base}/users", ["user_id", "day"])
    for number, rows in ((0, acts.where(~late)), (1, acts.where(late)), (1, acts.where(late))):
        rollups.added(days, rows, ("actions", number))
        rollups.users_added(users, rows, ("actions", number))
    return rollups.spans(days.read(), "week", users.read()).withColumn("span", F.col("span").cast("string"))
