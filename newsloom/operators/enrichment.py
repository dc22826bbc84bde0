"""Enrichment of articles: a provider's output, repaired, or rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import cleaned_tags, merged_tags

# The slugs that a category may have.
CATEGORIES = ["society", "economy", "tech", "arts", "nature", "selfwell", "philo", "lifestyle", "sports"]
#: Words of a title, a summary and a body: what is too long, and what it is cut to.
TITLE_WORDS, TITLE_CUT, SUMMARY_WORDS, SUMMARY_CUT, BODY_WORDS = 14, 12, 65, 55, 180
SCHEMA = "refined_title string, summary string, full_body string, category string, topic_tags array<string>, is_trending boolean, sentiment string, when_info string, where_info string"

Provider = Callable[[pd.DataFrame], pd.Series]


def by_rules(title: Column, body: Column, category: Column) -> Column:
    """An enriched struct from the article alone: truncated title, first sentences, truncated body."""
    return text.bound(text.clean_markup(body), lambda clean: _by_rules(title, text.first_sentences(clean, 2), text.truncate_words(clean, BODY_WORDS), category))


def _by_rules(title: Column, first: Column, source: Column, category: Column) -> Column:
    return F.struct(
        text.truncate_words(title, TITLE_CUT).alias("refined_title"),
        text.truncate_words(text.bound(first, lambda s: F.when(s == "", title).otherwise(s)), SUMMARY_CUT).alias("summary"),
        text.bound(source, lambda s: F.when(s == "", title).otherwise(s)).alias("full_body"),
        category.alias("category"), F.array().cast("array<string>").alias("topic_tags"), F.lit(False).alias("is_trending"),
        F.lit("neutral").alias("sentiment"), F.lit("").alias("when_info"), F.lit("Not specified").alias("where_info"),
    )


def repaired(rows: DataFrame, title: str = "title", body: str = "body", category: str = "category_default", raw: str = "raw", cleaned: bool = False) -> DataFrame:
    """rows with the struct `raw` checked and mended into `enriched`, step by step; a null struct is one made by the rules.

    Missing parts get defaults; an unknown category the default one; a title of over 14 words is cut to 12; a summary of under
    10 words becomes the first sentences; one that restates the title the next sentences, if they have 15 words and don't; one
    of over 65 words is cut to 55; a body of under 40 words is taken from the source; tags that are not empty are trimmed, five
    at most. What several steps look at is a column, worked out once. A body that comes cleaned is not cleaned a second time.
    """
    steps = rows.withColumn("__clean", F.coalesce(body, F.lit("")) if cleaned else text.clean_markup(F.col(body)))
    steps = steps.withColumns({"__sentences": text.sentences(F.col("__clean")), "__source": text.truncate_words(F.col("__clean"), BODY_WORDS)})
    steps = steps.withColumns({"__first": text.joined_sentences(F.col("__sentences"), 2), "__later": text.strip(F.array_join(F.slice("__sentences", 2, 2), " "))})
    steps = steps.withColumn("__raw", F.coalesce(F.col(raw), _by_rules(F.col(title), F.col("__first"), F.col("__source"), F.col(category))))
    name, given = F.coalesce("__raw.refined_title", title), F.coalesce("__raw.summary", F.lit(""))
    steps = steps.withColumn("__title", F.when(text.word_count(name) > TITLE_WORDS, text.truncate_words(name, TITLE_CUT)).otherwise(name))
    steps = steps.withColumn("__s1", F.when(text.word_count(given) < 10, F.when(F.col("__first") == "", F.col("__title")).otherwise(F.col("__first"))).otherwise(given))
    usable = (text.word_count(F.col("__later")) >= 15) & ~text.restates_title(F.col("__later"), F.col("__title"))
    steps = steps.withColumn("__s2", F.when(text.restates_title(F.col("__s1"), F.col("__title")) & usable, F.col("__later")).otherwise(F.col("__s1")))
    steps = steps.withColumn("__s3", F.when(text.word_count(F.col("__s2")) > SUMMARY_WORDS, text.truncate_words(F.col("__s2"), SUMMARY_CUT)).otherwise(F.col("__s2")))
    long_body = F.coalesce("__raw.full_body", F.lit(""))
    mended = F.struct(
        F.col("__title").alias("refined_title"), F.col("__s3").alias("summary"),
        F.when(text.word_count(long_body) < 40, F.when(F.col("__source") == "", F.col("__s3")).otherwise(F.col("__source"))).otherwise(long_body).alias("full_body"),
        F.when(F.col("__raw.category").isin(CATEGORIES), F.col("__raw.category")).otherwise(F.col(category)).alias("category"),
        cleaned_tags(F.coalesce("__raw.topic_tags", F.array().cast("array<string>"))).alias("topic_tags"),
        F.coalesce("__raw.is_trending", F.lit(False)).alias("is_trending"), F.coalesce("__raw.sentiment", F.lit("neutral")).alias("sentiment"),
        F.coalesce("__raw.when_info", F.lit("")).alias("when_info"), F.coalesce("__raw.where_info", F.lit("Not specified")).alias("where_info"),
    )
    return steps.withColumn("enriched", mended).drop("__clean", "__sentences", "__source", "__first", "__later", "__raw", "__title", "__s1", "__s2", "__s3")


def provided(rows: DataFrame, providers: list[Provider], title: str = "title", body: str = "body") -> DataFrame:
    """rows with `raw`: the first provider's JSON answer that is one, code fences stripped; null where all fail.

    A provider takes a pandas frame of title and body and returns a series of JSON texts or nulls. One that raises counts as
    having no answer for the batch, and the next is asked.
    """
    names = rows.columns

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answer = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            for provider in providers:
                waiting = answer.isna()
                if not waiting.any():
                    break
                try:
                    answer[waiting] = provider(frame.loc[waiting, [title, body]])
                except Exception:  # noqa: BLE001, S112  a provider that fails is one without an answer
                    continue
            yield frame[names].assign(__json=answer)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __json string"
    parsed = F.from_json(text.strip_code_fence(F.col("__json")), SCHEMA, {"mode": "PERMISSIVE"})
    usable = F.col("__json").isNotNull() & parsed["refined_title"].isNotNull()
    return rows.mapInPandas(ask, schema).withColumn("raw", F.when(usable, parsed)).drop("__json")


def to_enrich(articles: DataFrame, done: DataFrame, most: int = 50) -> DataFrame:
    """The newest articles that are not among the done ones."""
    return articles.join(done.select("id"), "id", "left_anti").orderBy(F.desc("published_at"), F.desc("id")).limit(most)


def written_back(articles: DataFrame, answers: DataFrame, pillars: DataFrame) -> DataFrame:
    """articles with the answers (id, enriched) written into them and ai_processed set; the others stay as they are.

    The pillar is that of the category's slug (pillars: pillar_id, slug) and else stays; tags are those of the answer, then the
    article's, each once. The title hash stays that of the source's title.
    """
    slugs = F.broadcast(pillars.select(F.col("pillar_id").alias("__pillar"), "slug"))
    new = answers.select("id", "enriched").join(slugs, F.col("enriched.category") == F.col("slug"), "left").drop("slug")
    joined, e = articles.join(new, "id", "left"), "enriched"
    values = {
        "headline": F.col(f"{e}.refined_title"), "summary_60": F.col(f"{e}.summary"), "full_body": F.col(f"{e}.full_body"), "source_summary": F.col(f"{e}.summary"), "when_info": F.col(f"{e}.when_info"),
        "where_info": F.col(f"{e}.where_info"), "pillar_id": F.coalesce("__pillar", "pillar_id"), "micro_tags": merged_tags(F.col(f"{e}.topic_tags"), F.coalesce("micro_tags", F.array().cast("array<string>"))),
        "is_trending": F.col(f"{e}.is_trending"), "sentiment": F.col(f"{e}.sentiment"), "ai_processed": F.lit(True),
    }
    answered = F.col(e).isNotNull()
    return joined.withColumns({c: F.when(answered, v).otherwise(F.col(c)) for c, v in values.items() if c in articles.columns}).select(articles.columns)
