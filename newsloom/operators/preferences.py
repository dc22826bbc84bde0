"""Topic preferences learned from interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in tenths so that sums are exact: what an action adds to a topic's weight, the weight at first, and its bounds.
DELTAS = {"like": 3, "save": 5, "read": 1, "dislike": -4, "quiz_complete": 2}
START, LOWEST, HIGHEST = 10, 1, 50
TAGS_PER_ARTICLE = 3
#: Seconds of a user's actions that are folded at first.
BUCKET_SECONDS = 600


def _fold(order: str) -> Column:
    """The composition of a group's steps (d, lo, hi) in an order: w -> least(hi, greatest(lo, w + d)), again as d, lo, hi."""
    step = "named_struct('d', acc.d + x.d, 'lo', greatest(x.lo, least(x.hi, acc.lo + x.d)), 'hi', greatest(x.lo, least(x.hi, acc.hi + x.d)))"
    listed = f"transform(array_sort(collect_list(struct({order}, d, lo, hi))), x -> named_struct('d', x.d, 'lo', x.lo, 'hi', x.hi))"
    return F.expr(f"aggregate({listed}, named_struct('d', 0, 'lo', -1000000, 'hi', 1000000), (acc, x) -> {step})")


def learned_weights(actions: DataFrame, articles: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(user_id, topic_name, pillar_id, weight): each action moves the first tags of its article, clamped at every step.

    A step is w -> clamp(w + d); a series of steps is again of the form clamp(w + d, low, high). So steps are folded by short
    times first, then over these: no task orders or holds a long history. The pillar is that of the first action.
    """
    delta = F.element_at(F.create_map(*[F.lit(x) for kv in DELTAS.items() for x in kv]), F.col("action"))
    tagged = articles.select(F.col("id").alias("article_id"), "pillar_id", F.slice("micro_tags", 1, TAGS_PER_ARTICLE).alias("tags")).where(F.size("tags") > 0)
    steps = actions.join(tagged, "article_id").select("user_id", F.explode("tags").alias("topic_name"), "pillar_id", "ts", "event_id", delta.alias("d"))
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000))
    single = steps.withColumns({"lo": F.lit(LOWEST), "hi": F.lit(HIGHEST), "bucket": bucket})
    short = single.groupBy("user_id", "topic_name", "bucket").agg(_fold("ts, event_id").alias("f"), F.min_by("pillar_id", F.struct("ts", "event_id")).alias("pillar_id"))
    whole = short.select("user_id", "topic_name", "bucket", "pillar_id", "f.*").groupBy("user_id", "topic_name").agg(_fold("bucket").alias("f"), F.min_by("pillar_id", "bucket").alias("pillar_id"))
    weight = F.greatest(F.col("f.lo"), F.least(F.col("f.hi"), F.col("f.d") + START)) / 10
    return whole.select("user_id", "topic_name", "pillar_id", F.round(weight, 6).alias("weight"))


def replaced_topics(preferences: DataFrame, chosen: DataFrame) -> DataFrame:
    """preferences with those of the users in `chosen` (user_id, topic_name, pillar_id) replaced by its topics, each once at weight 1."""
    others = preferences.join(chosen.select("user_id").distinct(), "user_id", "left_anti")
    new = chosen.dropDuplicates(["user_id", "topic_name"]).select("user_id", "topic_name", "pillar_id", F.lit(1.0).alias("weight"))
    return others.select("user_id", "topic_name", "pillar_id", "weight").unionByName(new)
