"""The logical tables (articles, interactions, heartbeats ...) made from the synthetic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..functions.taxonomy import Taxonomy, matched_topics, pillar_of, scope_of
from ..session import spread

AS_OF = "2024-01-31 00:00:00"

#: A small vocabulary that fits the invented prose; a real one is passed in its place.
DEMO = Taxonomy(
    pillars={
        1: ("Public Affairs", "society"), 2: ("Money & Markets", "economy"), 3: ("Science & Tech", "tech"), 4: ("Arts", "arts"), 5: ("Nature", "nature"),
        6: ("Health", "selfwell"), 7: ("Ideas", "philo"), 8: ("Living", "lifestyle"), 9: ("Sport & Play", "sports"),
    },
    keywords={
        1: ["minister", "thandre", "enverder"], 2: ["market", "eringth", "tionel"], 3: ["software", "ingtion", "ungver"], 4: ["film", "hertion", "ouén"], 5: ["climate", "ationer", "ciónlla"],
        6: ["clinic", "onthe", "heitver"], 7: ["ethics", "estand", "mentque"], 8: ["travel", "thntre", "adoas"], 9: ["league", "ndble", "keitsch"],
    },
    topics={"License": 1, "Version": 2, "Token": 3, "Erha": 4, "Anre": 5, "Lich": 6, "Eau": 7, "Ciónes": 8, "Whth": 9, "Apache": 3, "Ouer": 7, "Thtion": 2},
    title_words=[(9, ["st", "goal"]), (4, ["re", "song"]), (5, ["an", "sea"])],
    synonyms={"science": 3, "business": 2, "wellbeing": 6, "philosophy": 7, "governance": 1},
    home_words=["the", "der", "les"],
    local_words=["ing", "ung", "tion"],
    world_words=["world", "on", "es"],
)

ACTIONS = {"view": "read", "click": "like", "purchase": "save", "error": "dislike", "signup": "quiz_complete"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


#: Tables of long texts.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def published_at(doc_id: Column) -> Column:
    """Hours of January 2024, each as often as any other."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(doc_id * 337 % 720).cast("int"))


def articles(spark: SparkSession, sf_dir: str, taxonomy: Taxonomy = DEMO, classified: bool = True) -> DataFrame:
    """documents and labels as articles. Unlabelled documents are neutral and not trending."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = docs.select(
        F.col("doc_id").alias("id"),
        text.opening(F.col("text")).alias("headline"),
        F.col("text").alias("full_body"),
        F.col("source").alias("source_name"),
        published_at(F.col("doc_id")).alias("published_at"),
    )
    if classified:
        base = with_classes(base, taxonomy)
    marked = labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    return base.join(marked, "id", "left").withColumns({
        "is_trending": F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)),
        "sentiment": F.when(F.col("toxic") == 1, "negative").otherwise("neutral"),
    }).drop("quality", "toxic")


def with_classes(articles: DataFrame, taxonomy: Taxonomy = DEMO) -> DataFrame:
    """articles with pillar_id, scope and micro_tags; best put behind whatever leaves fewer of them."""
    return articles.withColumns({
        "pillar_id": pillar_of(F.col("headline"), F.col("full_body"), taxonomy),
        "scope": scope_of(F.col("headline"), F.col("full_body"), taxonomy),
        "micro_tags": matched_topics(F.col("full_body"), list(taxonomy.topics)),
    })


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as actions on articles, an append-only log."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))  # one row
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select("event_id", "ts", "user_id", (F.col("event_id") % F.col("n_docs")).alias("article_id"), action.alias("action"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reading heartbeats: seconds clamped to 0..60, scroll depth to 0..100."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))  # one row
    scroll = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select(
        "event_id", "ts", "user_id", (F.col("event_id") % F.col("n_docs")).alias("article_id"),
        scalars.clamp(F.floor("value"), 0, 60).cast("long").alias("duration_sec"), scalars.clamp(scroll, 0, 100).cast("int").alias("scroll_pct"),
    )


def timed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (event_id, ts, user_id, action, duration_sec)."""
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", action.alias("action"), scalars.clamp(F.floor("value"), 0, 60).cast("long").alias("duration_sec"))
