"""Rule-based classification by keyword lists, which are data: any taxonomy can be given."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bound


@dataclass(frozen=True)
class Taxonomy:
    """Pillars by id (name, slug), their keywords and topics, and words that tell a scope."""

    pillars: dict[int, tuple[str, str]]
    keywords: dict[int, list[str]]
    topics: dict[str, int]
    title_words: list[tuple[int, list[str]]] = field(default_factory=list)
    synonyms: dict[str, int] = field(default_factory=dict)
    home_words: list[str] = field(default_factory=list)
    local_words: list[str] = field(default_factory=list)
    world_words: list[str] = field(default_factory=list)

    def pillar_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, n, s) for i, (n, s) in self.pillars.items()], "pillar_id int, name string, slug string")

    def topic_table(self, spark: SparkSession) -> DataFrame:
        from .text import slug

        return spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(self.topics.items())], "position int, name string, pillar_id int").withColumn("slug", slug(F.col("name")))

    def pillar_of_slug(self, slug: str) -> int | None:
        own = {s: i for i, (_, s) in self.pillars.items()}
        return (own | self.synonyms).get(slug.lower())


def contained(text: Column, words: list[str]) -> Column:
    """How many of the words stand in the text, also inside longer words."""
    return F.size(F.filter(F.lit([w.lower() for w in words]), lambda w: F.contains(text, w))) if words else F.lit(0)


def matched_topics(text: Column, topics: list[str], most: int = 10) -> Column:
    found = bound(F.lower(F.coalesce(text, F.lit(""))), lambda lowered: F.filter(F.lit(list(topics)), lambda t: F.contains(lowered, F.lower(t))))
    return F.slice(found, 1, most)


def pillar_of(title: Column, body: Column, taxonomy: Taxonomy) -> Column:
    """The pillar of the highest score (2 for a keyword, 3 for a topic), the lowest id on ties.

    Where nothing scores, the first list with a word in the title decides, and else it is pillar 1.
    """
    ids = sorted(taxonomy.pillars)
    own_topics = {i: [t for t, p in taxonomy.topics.items() if p == i] for i in ids}

    def scores(text: Column) -> Column:
        return F.array(*[(contained(text, taxonomy.keywords.get(i, [])) * 2 + contained(text, own_topics[i]) * 3).cast("int") for i in ids])

    def by_title(lowered: Column) -> Column:
        pillar = F.lit(1)
        for other, words in reversed(taxonomy.title_words):
            pillar = F.when(contained(lowered, words) > 0, F.lit(other)).otherwise(pillar)
        return pillar

    def best(found: Column) -> Column:
        return F.when(F.array_max(found) > 0, F.get(F.lit(ids), F.array_position(found, F.array_max(found)).cast("int") - 1))

    fallback = bound(F.lower(F.coalesce(title, F.lit(""))), by_title)
    return F.coalesce(bound(_whole(title, body), lambda text: bound(scores(text), best)), fallback).cast("int")


def _whole(title: Column, body: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def scope_of(title: Column, body: Column, taxonomy: Taxonomy) -> Column:
    def counts(text: Column) -> Column:
        return F.array(*[contained(text, w) for w in (taxonomy.home_words, taxonomy.local_words, taxonomy.world_words)])

    def named(n: Column) -> Column:
        home, local, world = (F.get(n, F.lit(i)) for i in range(3))
        return F.when((local >= 2) & (home > 0), "local").when(home > world, "national").otherwise("global")

    return bound(_whole(title, body), lambda text: bound(counts(text), named))
