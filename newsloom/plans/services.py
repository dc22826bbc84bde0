"""Queries that ask services: several calls at once in each task, and the cycle from raw items to enriched articles."""

from __future__ import annotations

import asyncio
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import browse, enrichment, providers
from ..session import shared_folder
from ..sources import adapters as A
from . import sql as S
from .composed import NEW, SLUGS, new_rows, repaired_sql
from .queries import HEADLINE, headlines
from .registry import query


def _answer(title: str) -> str:
    return json.dumps({"refined_title": title, "summary": "one two three four five six seven eight nine ten", "category": "arts", "topic_tags": [" t"]})


async def first_service(title: str, body: str) -> str | None:
    """By the length of the title: fails, has nothing to say, says what is no answer, or answers."""
    await asyncio.sleep(0.001)
    match len(title) % 5:
        case 0:
            raise ConnectionError
        case 1:
            return None
        case 2:
            return "no json"
    return f"```json\n{_answer(title + '!')}\n```"


def second_service(title: str, body: str) -> str | None:
    return _answer(title + "?") if len(title) % 2 == 0 else None


SERVICES = [providers.Provider("first", first_service), providers.Provider("second", second_service)]
#: These services take no pauses, and fail by their input alone: none is ever passed over.
PATIENT = providers.Limits(at_once=5, tries=2, pause=0.0, failures=1 << 60)
ANSWERS = """length(title) % 5 IN (3, 4) OR length(title) % 2 = 0 AS answered, title || CASE WHEN length(title) % 5 IN (3, 4) THEN '!' ELSE '?' END AS r_title, 'one two three four five six seven eight nine ten' AS r_summary, '' AS r_body,
  'arts' AS r_category, [' t'] AS r_tags, false AS r_trending, 'neutral' AS r_sentiment"""


@query(S.with_(f"b AS (SELECT doc_id, headline AS title, {S.clean_markup('text')} AS clean, [] AS micro_tags FROM ({HEADLINE}))", f"r AS (SELECT *, {ANSWERS} FROM b)", repaired_sql("r", "'tech'"))
       + """SELECT doc_id, refined AS refined_title, summary, category, CASE WHEN length(title) % 5 IN (3, 4) THEN 'first' WHEN length(title) % 2 = 0 THEN 'second' END AS answered_by,
CASE length(title) % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS calls,
concat_ws('; ', CASE length(title) % 5 WHEN 0 THEN 'first: ConnectionError; first: ConnectionError' WHEN 1 THEN 'first: no answer' WHEN 2 THEN 'first: no answer' END, CASE WHEN length(title) % 5 < 3 AND length(title) % 2 = 1 THEN 'second: no answer' END) AS failures FROM mended""")  # fmt: skip
def concurrent_answers(spark, d) -> DataFrame:
    """Two services asked by a window of five calls a task, each row for itself; what each said and failed of, and the answers mended."""
    rows = headlines(spark, d).select("doc_id", F.col("headline").alias("title"), text.clean_markup(F.col("text")).alias("body"), F.lit("tech").alias("category_default"))
    out, e = enrichment.repaired(providers.asked(rows, SERVICES, PATIENT), cleaned=True), "enriched"
    return out.select("doc_id", f"{e}.refined_title", f"{e}.summary", f"{e}.category", "answered_by", "calls", "failures")


@query(S.with_(NEW, SLUGS, "waiting AS (SELECT * FROM new_rows ORDER BY published_at DESC, url DESC LIMIT 50)",
               f"b AS (SELECT w.url AS doc_id, headline AS title, {S.clean_markup('full_body')} AS clean, coalesce(slug, 'tech') AS default_slug, pillar_id, micro_tags FROM waiting w LEFT JOIN slugs ON p = pillar_id)",
               f"r AS (SELECT *, {ANSWERS} FROM b)", repaired_sql("r", "default_slug"))
       + """, written AS (SELECT a.url, a.title_hash, coalesce(m.refined, a.headline) AS headline, coalesce(m.summary, a.summary_60) AS summary, coalesce(s.p, a.pillar_id)::INTEGER AS pillar_id,
array_to_string(CASE WHEN m.doc_id IS NULL THEN a.micro_tags ELSE list_filter(list_concat(m.tags, a.micro_tags), lambda x, i: list_position(list_concat(m.tags, a.micro_tags), x) = i)[1:10] END, '|') AS tags, m.doc_id IS NOT NULL AS ai_processed
FROM new_rows a LEFT JOIN mended m ON m.doc_id = a.url LEFT JOIN slugs s ON s.slug = m.category)
SELECT *, count(*) OVER (PARTITION BY pillar_id) AS n_of_pillar FROM written""")  # fmt: skip
def ingest_and_enrich(spark, d) -> DataFrame:
    """A whole cycle: both sources, without copies, stored; the newest 50 asked about and written back; and how many each pillar has then."""
    path, pillars = shared_folder(spark, "ingested"), A.DEMO.pillar_table(spark)
    new_rows(spark, d).withColumn("id", F.col("url")).write.parquet(path)
    fresh = spark.read.parquet(path)
    waiting = enrichment.to_enrich(fresh, fresh.where("ai_processed").select("id"))
    rows = browse.decorated(waiting, pillars, default=3).select("id", F.col("headline").alias("title"), text.clean_markup(F.col("full_body")).alias("body"), F.col("pillar_slug").alias("category_default"))
    written = enrichment.written_back(fresh, enrichment.repaired(providers.asked(rows, SERVICES, PATIENT, tasks=1), cleaned=True), pillars)
    counts = written.groupBy("pillar_id").agg(F.count("*").alias("n_of_pillar"))  # a row for each pillar
    shown = written.select("url", "title_hash", "headline", F.col("summary_60").alias("summary"), "pillar_id", F.array_join("micro_tags", "|").alias("tags"), "ai_processed")
    return shown.join(F.broadcast(counts), "pillar_id")
