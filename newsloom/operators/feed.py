"""Personal feeds: scores, pages and their fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import engagement_boost, recency, serendipity

# How many candidates of how many days, the least score, and the page that is too short.
CANDIDATES, DAYS, LEAST_SCORE, SHORT_PAGE = 500, 7, 0.05, 5

#: The parts of a score that follow from the article and the time.
TIMED = ("recency", "boost", "trend")


def engagement(actions: DataFrame) -> DataFrame:
    """(id, engagement): reads of each article."""
    return actions.where("action = 'read'").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("engagement"))


def candidates(articles: DataFrame, as_of: Column, most: int = CANDIDATES, days: int = DAYS) -> DataFrame:
    """The newest articles of the last days, at most so many. What takes long to work out about articles belongs behind this."""
    return articles.where(F.col("published_at") > as_of - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("published_at"), F.desc("id")).limit(most)


def interests(candidates: DataFrame, preferences: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, article_id, interest, *keep) over all users with preferences and the candidates: the part of a score that weights decide.

    The candidates are limited by number, so every user meets a table of fixed size, which is broadcast. Weights of pillars
    add up; of topics that differ in case only the last one by name counts. Candidates of one pillar and the same tags interest a
    user alike, which is worked out once for all of them.
    """
    facts = candidates.select("pillar_id", F.transform("micro_tags", lambda t: F.lower(t)).alias("tags"), F.struct("id", *keep).alias("of"))
    alike = facts.groupBy("pillar_id", "tags").agg(F.collect_list("of").alias("alike"))
    by_pillar = preferences.groupBy("user_id", "pillar_id").agg(F.sum("weight").alias("w"))
    by_topic = preferences.groupBy("user_id", F.lower("topic_name").alias("topic")).agg(F.max_by("weight", "topic_name").alias("w"))
    users = (
        by_pillar.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("pillar_id", "w"))).alias("pillars"))
        .join(by_topic.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "w"))).alias("topics")), "user_id")
    )
    met = users.crossJoin(F.broadcast(alike))
    liked = F.coalesce(F.try_element_at("pillars", F.col("pillar_id")), F.lit(0.0))
    tags = F.aggregate(F.transform("tags", lambda t: F.coalesce(F.try_element_at(F.col("topics"), t), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    each = met.select("user_id", (liked * 2 + tags * 3).alias("interest"), "alike").select("user_id", "interest", F.explode("alike").alias("of"))
    return each.select("user_id", F.col("of.id").alias("article_id"), "interest", *(F.col("of")[c].alias(c) for c in keep))


def _timed(candidates: DataFrame, as_of: Column) -> DataFrame:
    return candidates.withColumns({"recency": recency(F.col("published_at"), as_of), "boost": engagement_boost(F.col("engagement")), "trend": F.when(F.col("is_trending"), 0.5).otherwise(0.0)})


def _scored(pairs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    # Behind explode() a score is worked out once: the filter on it would be put before it, with the whole expression again.
    total = F.col("interest") * F.col("recency") + F.col("boost") + F.col("trend") + serendipity(F.col("article_id"), F.col("user_id"))
    return pairs.select("user_id", "article_id", F.explode(F.array(F.round(total, 6))).alias("score"), *keep).where(F.col("score") > LEAST_SCORE)


def scores(candidates: DataFrame, preferences: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, article_id, score) over all users with preferences and the candidates, with those of their columns that are to be kept."""
    return _scored(interests(_timed(candidates, as_of), preferences, (*TIMED, *keep)), keep)


def scored(pairs: DataFrame, candidates: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from pairs whose interest is known."""
    facts = _timed(candidates, as_of).select(F.col("id").alias("article_id"), *TIMED, *keep)
    return _scored(pairs.join(F.broadcast(facts), "article_id"), keep)


def page(feed: DataFrame, articles: DataFrame | None = None, number: int = 1, size: int = 10, scope: str | None = None, pillar: int | None = None) -> DataFrame:
    """One page of every user's feed, best first, with has_more; filters that aren't given don't apply.

    What it orders and filters by comes with the feed or else from articles.
    """
    joined = feed if articles is None else feed.join(articles.withColumnRenamed("id", "article_id"), "article_id")
    for name, value in (("scope", scope), ("pillar_id", pillar)):
        if value is not None:
            joined = joined.where(F.col(name) == value)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("published_at"), F.desc("article_id"))
    ranked = joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number * size + 1)
    more = ranked.withColumn("has_more", F.max("rank").over(Window.partitionBy("user_id")) > number * size)
    return more.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def page_or_recent(page_rows: DataFrame, recent: DataFrame, least: int = SHORT_PAGE) -> DataFrame:
    """The page, or the recent articles at score 1 where the page has too few rows; both of the same columns."""
    both = page_rows.withColumn("__own", F.lit(True)).unionByName(recent.withColumn("__own", F.lit(False)))  # two pages
    counted = both.withColumn("__n", F.count_if("__own").over(Window.partitionBy()))
    return counted.where(F.col("__own") == (F.col("__n") >= least)).drop("__own", "__n")
