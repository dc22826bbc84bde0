"""Feeds kept up to date by what has changed: only users with new actions and articles new to the candidates are scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feed
from .preferences import learned_weights


@dataclass(frozen=True)
class Feeds:
    """What is kept between refreshes: weights, the candidates' ids, and (user_id, article_id, interest, fresh) of every pair.

    The interest is the part of a score that follows from the user's weights and the article; what depends on the time and on
    reads is put on it when feeds are shown, so that it never has to be kept up to date. fresh marks the pairs of the last refresh.
    """

    preferences: DataFrame
    candidates: DataFrame
    pairs: DataFrame

    def stored(self, spark: SparkSession, folder: str) -> Feeds:
        """Written under the folder, and as read from there."""
        parts = {"preferences": self.preferences, "candidates": self.candidates, "pairs": self.pairs}
        for name, df in parts.items():
            df.write.parquet(f"{folder}/{name}")
        return Feeds(*(spark.read.parquet(f"{folder}/{name}") for name in parts))


def first(actions: DataFrame, articles: DataFrame, candidates: DataFrame) -> Feeds:
    """All users' feeds from nothing."""
    preferences = learned_weights(actions, articles)
    return Feeds(preferences, candidates.select("id"), feed.interests(candidates, preferences).withColumn("fresh", F.lit(True)))


def refreshed(old: Feeds, new_actions: DataFrame, actions: DataFrame, articles: DataFrame, candidates: DataFrame) -> Feeds:
    """The feeds after new actions, and with the candidates as they are now.

    Users with new actions learn their weights again, from all of their actions, and are scored with all candidates; other users
    with the candidates that are new; pairs of candidates that are none any more go. Both candidate tables are limited by number,
    so they are broadcast; users meet by a shuffle of the pairs on user_id.
    """
    changed = new_actions.select("user_id").distinct()
    learned = learned_weights(actions.join(changed, "user_id", "left_semi"), articles)
    others = old.preferences.join(changed, "user_id", "left_anti")
    preferences = others.unionByName(learned)
    came = candidates.join(F.broadcast(old.candidates), "id", "left_anti")
    scored = feed.interests(candidates, learned).unionByName(feed.interests(came, others)).withColumn("fresh", F.lit(True))
    still = candidates.select(F.col("id").alias("article_id"))
    kept = old.pairs.join(F.broadcast(still), "article_id", "left_semi").join(changed, "user_id", "left_anti").withColumn("fresh", F.lit(False))
    return Feeds(preferences, candidates.select("id"), kept.unionByName(scored))


def shown(kept: Feeds, candidates: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, article_id, score) as feed.scores() gives it, from the pairs that are kept."""
    return feed.scored(kept.pairs, candidates, as_of, keep)
