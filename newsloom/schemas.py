"""The stored tables: their columns, and what a row is told by."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the columns that are unique together, and what a missing value of a column is."""

    columns: str
    unique: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


# Names, types and defaults of the stored tables.
TABLES = {
    "users": Table("id bigint, email string, password string, name string, bio string, avatar_url string, language string, created_at timestamp_ntz, last_login timestamp_ntz", ("email",), {"name": "", "bio": "", "avatar_url": "", "language": "en"}),
    "topics": Table("id bigint, name string, slug string, pillar_id int, sub_pillar string, color string, emoji string", ("name",), {"sub_pillar": "", "color": "", "emoji": ""}),
    "articles": Table(
        "id bigint, url string, title_hash string, headline string, summary_60 string, full_body string, source_summary string, when_info string, where_info string, what_info string, how_info string, image_url string, source_name string,"
        " pillar_id int, micro_tags array<string>, scope string, is_trending boolean, sentiment string, published_at timestamp_ntz, collected_at timestamp_ntz, ai_processed boolean, engagement bigint",
        ("url",), {"pillar_id": 1, "scope": "global", "is_trending": False, "sentiment": "neutral", "ai_processed": False, "engagement": 0},
    ),
    "user_preferences": Table("user_id bigint, topic_name string, pillar_id int, weight double", ("user_id", "topic_name"), {"weight": 1.0}),
    "user_interactions": Table("user_id bigint, article_id bigint, action string, timestamp timestamp_ntz"),
    "feeds": Table("user_id bigint, article_id bigint, score double, computed_at timestamp_ntz", ("user_id", "article_id"), {"score": 0.0}),
    "bookmarks": Table("user_id bigint, article_id bigint, saved_at timestamp_ntz", ("user_id", "article_id")),
    "sessions": Table("user_id bigint, session_date date, duration_sec bigint, last_seen timestamp_ntz", ("user_id", "session_date"), {"duration_sec": 0}),
    "reading_progress": Table("user_id bigint, article_id bigint, scroll_pct int, duration_sec bigint, completed boolean, started_at timestamp_ntz, updated_at timestamp_ntz", ("user_id", "article_id"), {"scroll_pct": 0, "duration_sec": 0, "completed": False}),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].schema)


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df in the columns, types and order of a stored table: missing columns are added, missing values get their defaults, others go."""
    table = TABLES[name]
    known = {f.name for f in table.schema}
    whole = empty(df.sparkSession, name).unionByName(df.select(*[c for c in df.columns if c in known]), allowMissingColumns=True)
    return whole.fillna(table.defaults).to(table.schema)
