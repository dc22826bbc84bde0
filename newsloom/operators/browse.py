"""Lists of articles: explore, trending, search, notifications, bookmarks, profile, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ascii_json
from ..functions.taxonomy import Taxonomy
from .patterns import found_in



def newest() -> list[Column]:
    return [F.desc("published_at"), F.desc("id")]


def explore(articles: DataFrame, taxonomy: Taxonomy, page: int = 1, size: int = 20, scope: str | None = None, pillar: int | None = None, category: str | None = None) -> DataFrame:
    """One page of the newest articles with has_more. A category is a pillar's slug; an unknown one filters nothing, a pillar wins."""
    wanted = pillar if pillar is not None else taxonomy.pillar_of_slug(category) if category else None
    conditions = [F.col(c) == v for c, v in (("scope", scope), ("pillar_id", wanted)) if v is not None]
    rows = articles.where(reduce(Column.__and__, conditions)) if conditions else articles
    shown = rows.orderBy(*newest()).offset((page - 1) * size).limit(size + 1)
    ranked = shown.withColumn("rank", F.row_number().over(Window.orderBy(*newest())))  # size + 1 rows
    return ranked.withColumn("has_more", F.max("rank").over(Window.partitionBy()) > size).where(F.col("rank") <= size)


def trending(articles: DataFrame, most: int = 30) -> DataFrame:
    return articles.where("is_trending").orderBy(*newest()).limit(most)


def search(articles: DataFrame, query: str, most: int = 25) -> DataFrame:
    """The newest articles with the query, taken literally and without regard to case, in headline or body."""
    q = F.lit(query.lower())
    return articles.where(F.contains(F.lower("headline"), q) | F.contains(F.lower("full_body"), q)).orderBy(*newest()).limit(most)


def decorated(articles: DataFrame, pillars: DataFrame, default: int = 1) -> DataFrame:
    """articles with pillar_name and pillar_slug; an unknown pillar is shown as the default one."""
    known = pillars.select("pillar_id", F.col("name").alias("pillar_name"), F.col("slug").alias("pillar_slug"))
    other = pillars.where(F.col("pillar_id") == default).select(F.col("name").alias("__n"), F.col("slug").alias("__s"))
    joined = articles.join(F.broadcast(known), "pillar_id", "left").crossJoin(F.broadcast(other))  # a dimension, and one row of it
    return joined.withColumns({"pillar_name": F.coalesce("pillar_name", "__n"), "pillar_slug": F.coalesce("pillar_slug", "__s")}).drop("__n", "__s")


def notifications(preferences: DataFrame, articles: DataFrame, topics: int = 5, each: int = 2, loose: bool = False) -> DataFrame:
    """Of each user's heaviest topics the newest articles that have the tag (loose: whose tags as JSON, beyond ASCII escaped, have its text).

    preferences are read twice and, if loose, once more before the result is: best ones that are stored.
    """
    user = Window.partitionBy("user_id").orderBy(F.desc("weight"), "topic_name")
    heaviest = preferences.withColumn("n", F.row_number().over(user)).where(F.col("n") <= topics).select("user_id", "topic_name")
    names = preferences.select("topic_name").distinct()
    if loose:
        # Articles of the same tags have the same text: the newest few of them stand for it, and go along with it as one row.
        shown = articles.select("id", "headline", "published_at", F.lower(ascii_json(F.col("micro_tags"))).alias("json"))
        ranked = shown.withColumn("n", F.row_number().over(Window.partitionBy("json").orderBy(*newest()))).where(F.col("n") <= each)
        newest_of = ranked.groupBy("json").agg(F.collect_list(F.struct("id", "headline", "published_at")).alias("newest"))
        lowered = names.withColumn("lowered", F.lower("topic_name"))
        matched = found_in(newest_of, "json", lowered, "lowered").join(lowered, "lowered").select("topic_name", F.inline("newest"))
    else:
        matched = articles.select("id", "headline", "published_at", F.explode(F.array_distinct("micro_tags")).alias("topic_name"))
    best = matched.withColumn("n", F.row_number().over(Window.partitionBy("topic_name").orderBy(*newest()))).where(F.col("n") <= each)
    return heaviest.join(best, "topic_name").select("user_id", "topic_name", F.col("id").alias("article_id"), "headline", "published_at")


def bookmarks(actions: DataFrame) -> DataFrame:
    """(user_id, article_id, saved_at): a save toggles, so an odd number of them leaves a bookmark."""
    saves = actions.where("action = 'save'").groupBy("user_id", "article_id").agg(F.count("*").alias("n"), F.max("ts").alias("saved_at"))
    return saves.where("n % 2 = 1").drop("n")


def profile(actions: DataFrame, preferences: DataFrame, marks: DataFrame) -> DataFrame:
    """Counts of a user's actions, topics and bookmarks."""
    done = actions.groupBy("user_id").agg(F.count_if(F.col("action") == "read").alias("n_read"), F.count_if(F.col("action") == "like").alias("n_liked"), F.count("*").alias("n_actions"))
    topics = preferences.groupBy("user_id").agg(F.count("*").alias("n_topics"), F.round(F.max("weight"), 2).alias("top_weight"))
    saved = marks.groupBy("user_id").agg(F.count("*").alias("n_bookmarks"))
    out = done.join(topics, "user_id", "left").join(saved, "user_id", "left")
    return out.select("user_id", "n_read", "n_liked", "n_actions", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_topics", "n_bookmarks")), "top_weight")


def profile_page(actions: DataFrame, preferences: DataFrame, marks: DataFrame) -> DataFrame:
    """(user_id, articles_read, likes, bookmarks, preferences) of each user with actions; preferences from the heaviest down."""
    done = actions.groupBy("user_id").agg(F.count_if(F.col("action") == "read").alias("articles_read"), F.count_if(F.col("action") == "like").alias("likes"))
    listed = preferences.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "topic_name", "pillar_id", F.round("weight", 2).alias("weight")))).alias("p"))
    listed = listed.select("user_id", F.transform("p", lambda x: x.dropFields("order")).alias("preferences"))
    saved = marks.groupBy("user_id").agg(F.count("*").alias("bookmarks"))
    out = done.join(saved, "user_id", "left").join(listed, "user_id", "left")
    none = F.array().cast("array<struct<topic_name string, pillar_id int, weight double>>")
    return out.select("user_id", "articles_read", "likes", F.coalesce("bookmarks", F.lit(0)).alias("bookmarks"), F.coalesce("preferences", none).alias("preferences"))


def as_json(decorated_articles: DataFrame) -> DataFrame:
    """(id, body): each article as one nested JSON text."""
    pillar = F.struct(F.col("pillar_id").alias("id"), F.col("pillar_name").alias("name"), F.col("pillar_slug").alias("slug"))
    body = F.struct("id", F.col("headline").alias("refined_title"), pillar.alias("pillar"), "micro_tags", F.col("is_trending").alias("isTrending"))
    return decorated_articles.select("id", F.to_json(body).alias("body"))


def pillar_counts(articles: DataFrame, pillars: DataFrame) -> DataFrame:
    counts = articles.groupBy("pillar_id").agg(F.count("*").alias("n"))
    return pillars.join(counts, "pillar_id", "left").select("pillar_id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n_articles"))


def health(articles: DataFrame, users: DataFrame) -> DataFrame:
    """One row of totals, each table read once."""
    a = articles.agg(F.count("*").alias("n_articles"), F.count_if("is_trending").alias("n_trending"), F.count_if(F.col("sentiment") == "negative").alias("n_negative"))
    return a.crossJoin(users.agg(F.count_distinct("user_id").alias("n_users")))  # one row each


def topic_tree(topics: DataFrame, pillars: DataFrame) -> DataFrame:
    """(pillar_id, name, topics): names in their order, joined."""
    listed = topics.groupBy("pillar_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("t"))
    return pillars.join(listed, "pillar_id", "left").select("pillar_id", "name", F.coalesce(F.array_join("t.name", "|"), F.lit("")).alias("topics"))


def topic_search(topics: DataFrame, query: str, most: int = 40) -> DataFrame:
    return topics.where(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("position").limit(most)


def details(articles: DataFrame, actions: DataFrame) -> DataFrame:
    """articles with engagement, and shown_engagement: what the latest reader was shown, which is the count before that read."""
    reads = actions.where("action = 'read'").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("engagement"))
    joined = articles.join(reads, "id", "left").withColumn("engagement", F.coalesce("engagement", F.lit(0)).cast("long"))
    return joined.withColumn("shown_engagement", F.greatest(F.col("engagement") - 1, F.lit(0)).cast("long"))


def recents(articles: DataFrame, offset: int, most: int) -> DataFrame:
    """The newest articles from a place on."""
    return articles.orderBy(*newest()).offset(offset).limit(most)
