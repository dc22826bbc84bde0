"""Queries that are made of several operators: what one request or one cycle of a service answers, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars, text
from ..operators import activity, browse, dedup, enrichment, markets, mutations
from ..operators.versioned import VersionedTable
from ..session import shared_folder
from ..sources import adapters as A
from ..sources import feeds, http
from . import sql as S
from .queries import HEADLINE, headlines, moment, prefs, read_articles
from .registry import query

STORED, INGESTED = 50, "2024-01-31 00:00:00"


# Ingestion: documents as the items of feeds, pages as the articles of JSON answers


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    none = {c: F.lit(None).cast(k) for c, k in (("content", "string"), ("media", "array<string>"), ("thumbnails", "array<string>"), ("enclosures", "array<struct<type string, url string>>"), ("links", "array<struct<type string, url string>>"))}
    docs = headlines(spark, d).select(F.concat(F.lit("f"), (F.col("doc_id") % 300).cast("string")).alias("feed"), F.floor(F.col("doc_id") / 300 + 1).cast("int").alias("pos"), F.col("headline").alias("title"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("link"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("published"))
    return docs.withColumns(none)


def json_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their cleaned text. Behind explode() it is worked out once: filters on the title would be put before it and clean again."""
    clean = F.explode(F.array(text.clean_markup(F.col("html"))))
    pages = A.table(spark, d, "pages").select(F.lit("json").alias("feed"), F.col("page_id").cast("int").alias("pos"), "url", clean.alias("body"))
    return pages.select("feed", "pos", F.substring("body", 1, 80).alias("title"), F.col("url").alias("link"), "body", F.lit("2024-01-15T10:00:00").alias("published"), F.lit("").alias("image"), F.col("body").alias("description"), F.lit("pages").alias("source_name"))


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Raw articles of both sources with their place in the order of arrival: feeds first, then answers."""
    at = F.lit(INGESTED).cast("timestamp_ntz")
    rss = feeds.raw_articles(feeds.capped(feed_items(spark, d)), A.DEMO, at, F.col("feed")).withColumn("source_rank", F.lit(0))
    answers = feeds.raw_articles(feeds.named(json_items(spark, d)), A.DEMO, at, F.col("source_name")).withColumn("source_rank", F.lit(1))
    return rss.unionByName(answers)


def stored(spark: SparkSession, d: str) -> DataFrame:
    """What the store has before the cycle: the first documents."""
    return headlines(spark, d).where(F.col("doc_id") < STORED).select(text.title_fingerprint(F.col("headline")).alias("title_hash"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))


def new_rows(spark: SparkSession, d: str) -> DataFrame:
    return dedup.new_articles(ingested(spark, d), stored(spark, d), [F.col("source_rank"), F.col("feed"), F.col("pos")])


def _clip(x: str, n: int) -> str:
    return f"substr({x}, 1, {n})"


def _raw(title: str, body: str, short: str) -> str:
    return f"""{S.fingerprint(title)} AS title_hash, {title} AS headline, {_clip(body, feeds.SUMMARY)} AS summary_60, {_clip(short, feeds.SOURCE_SUMMARY)} AS source_summary,
  {S.pillar_of(title, body, A.DEMO)} AS pillar_id, {S.scope_of(title, body, A.DEMO)} AS scope, {S.topics_in(f"{title} || ' ' || {body}", A.DEMO)} AS micro_tags"""


NEW = f"""rss AS (SELECT 'f' || (doc_id % 300)::VARCHAR AS feed, doc_id // 300 + 1 AS pos, {S.strip(S.or_empty('headline'))} AS title, 'u' || (doc_id % 700)::VARCHAR AS url, {S.clean_markup('text')} AS body FROM ({HEADLINE})),
pages1 AS (SELECT page_id AS pos, {S.strip("coalesce(url, '')")} AS url, {S.clean_markup('html')} AS body FROM pages),
both_sources AS (SELECT 0 AS source_rank, feed, pos, url, TIMESTAMP '{INGESTED}' AS published_at, body AS full_body, {_raw('title', 'body', 'body')} FROM rss WHERE title <> '' AND pos <= {feeds.ENTRIES_PER_FEED}
  UNION ALL SELECT 1, 'json', pos, url, TIMESTAMP '2024-01-15 10:00:00', body, {_raw('title', 'body', 'body')} FROM (SELECT *, {S.strip('substr(body, 1, 80)')} AS title FROM pages1) WHERE title <> '' AND url <> ''),
known AS (SELECT {S.fingerprint('headline')} AS title_hash, 'u' || doc_id::VARCHAR AS url FROM ({HEADLINE}) WHERE doc_id < {STORED}),
unique_ones AS (SELECT * FROM both_sources QUALIFY row_number() OVER (PARTITION BY title_hash ORDER BY source_rank, feed, pos) = 1),
fresh AS (SELECT * FROM unique_ones WHERE title_hash NOT IN (SELECT title_hash FROM known) AND url NOT IN (SELECT url FROM known)),
new_rows AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY url ORDER BY source_rank, feed, pos) = 1)"""


@query(S.with_(NEW) + f"SELECT url, title_hash, headline, summary_60, source_summary, pillar_id, scope, array_to_string(micro_tags, '|') AS tags, {S.moment('published_at')} AS published_at FROM new_rows")
def ingest_cycle(spark, d):
    """Both sources cleaned, classified, fingerprinted, without what is in the batch twice or in the store already."""
    return new_rows(spark, d).select("url", "title_hash", "headline", "summary_60", "source_summary", "pillar_id", "scope", F.array_join("micro_tags", "|").alias("tags"), moment("published_at"))


@query(S.with_(NEW) + """SELECT (SELECT count(*) FROM both_sources) AS n_raw, (SELECT count(*) FROM unique_ones) AS n_unique, (SELECT count(*) FROM new_rows) AS n_inserted, """ + ", ".join(f"(SELECT count(*) FROM new_rows WHERE pillar_id = {i}) AS n_pillar_{i}" for i in A.DEMO.pillars))
def ingest_counts(spark, d):
    """The counters of a cycle, and its new articles by pillar; what is counted of raw articles is worked out once."""
    path, order = shared_folder(spark, "counted"), ["source_rank", "feed", "pos"]
    ingested(spark, d).select(*order, "url", "title_hash", "pillar_id").write.parquet(path)
    came = spark.read.parquet(path)
    raw = came.agg(F.count("*").alias("n_raw"), F.count_distinct("title_hash").alias("n_unique"))
    new = dedup.new_articles(came, stored(spark, d), [F.col(c) for c in order]).agg(F.count("*").alias("n_inserted"), *(F.count_if(F.col("pillar_id") == i).alias(f"n_pillar_{i}") for i in A.DEMO.pillars))
    return raw.crossJoin(new)  # one row each


# Landed files: the tables written the way providers write, and read again by the sources


def escaped(x: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(character), F.lit(entity))
    return x


def landed(spark: SparkSession, lines: Column, rows: DataFrame, name: str) -> str:
    path = shared_folder(spark, name)
    rows.select(lines.alias("value")).write.text(path)
    return path


def fed(items: DataFrame, item: Column, opening: str, closing: str) -> DataFrame:
    """(feed, pos, ITEM) of the items put together into the bodies of feeds, in the order of their ids, and taken apart again."""
    each = items.select((F.col("doc_id") % 300).cast("string").alias("feed"), "doc_id", item.alias("x"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy("doc_id"))).where(F.col("n") <= feeds.ENTRIES_PER_FEED)
    listed = first.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("items"))
    return http.items_of(listed.select("feed", F.concat(F.lit(opening), F.array_join("items.x", ""), F.lit(closing)).alias("body")))


def shown_articles(raw: DataFrame) -> DataFrame:
    return raw.select("url", "title_hash", "headline", "summary_60", "source_summary", "image_url", "source_name", moment("published_at"))


def _landed_sql(title: str, body: str, short: str, url: str, image: str, name: str, published: str, where: str = "true") -> str:
    return f"""SELECT {url} AS url, {S.fingerprint(title)} AS title_hash, {title} AS headline, {_clip(body, feeds.SUMMARY)} AS summary_60, {_clip(short, feeds.SOURCE_SUMMARY)} AS source_summary, {image} AS image_url, {name} AS source_name,
  {published} AS published_at FROM (SELECT *, {S.squeeze('headline')} AS title, {S.squeeze('substr(text, 1, 600)')} AS body, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) AS pos FROM ({HEADLINE})) WHERE title <> '' AND {where}"""


def for_landing(spark: SparkSession, d: str) -> DataFrame:
    return headlines(spark, d).select("doc_id", text.squeeze(F.col("headline")).alias("title"), text.squeeze(F.substring("text", 1, 600)).alias("body"))


NAMESPACES = "xmlns:media='http://search.yahoo.com/mrss/' xmlns:content='http://purl.org/rss/1.0/modules/content/'"
IMAGES = "CASE doc_id % 4 WHEN 0 THEN 'http://m/' || doc_id WHEN 1 THEN 'http://t/' || doc_id WHEN 2 THEN 'http://e/' || doc_id ELSE 'http://i/' || doc_id END"
CLEANED = S.clean_markup("body || ' '")


@query(_landed_sql("title", CLEANED, CLEANED, "'http://x/' || doc_id", IMAGES, "'rss'", "CASE WHEN doc_id % 5 = 0 THEN '2024-01-31 00:00:00' ELSE '2024-01-02 03:04:05' END", f"pos <= {feeds.ENTRIES_PER_FEED}"))
def rss_feeds(spark, d):
    """Items of RSS feeds with their images from media, thumbnails, enclosures or the text."""
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    image = F.when(kind == 0, F.concat(F.lit("<media:content url='http://m/"), i, F.lit("'/>"))).when(kind == 1, F.concat(F.lit("<media:content url='ftp://m'/><media:thumbnail url='http://t/"), i, F.lit("'/>"))).when(
        kind == 2, F.concat(F.lit("<enclosure type='audio/x' url='http://a'/><enclosure type='image/x' url='http://e/"), i, F.lit("'/>"))
    ).otherwise("")
    picture = F.when(kind == 3, F.concat(F.lit("<img src='http://i/"), i, F.lit("'>"))).otherwise("")
    date = F.when(F.col("doc_id") % 5 == 0, "soon").otherwise("Tue, 02 Jan 2024 03:04:05 +0000")
    item = F.concat(F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>http://x/"), i, F.lit("</link><description>"), escaped(F.concat("body", F.lit(" "), picture)), F.lit("</description><pubDate>"), date, F.lit("</pubDate>"), image, F.lit("</item>"))
    items = fed(for_landing(spark, d), item, f"<rss {NAMESPACES}><channel>", "</channel></rss>")
    return shown_articles(feeds.raw_articles(feeds.capped(items), A.DEMO, F.lit(INGESTED).cast("timestamp_ntz"), F.lit("rss")))


@query(_landed_sql("title", S.clean_markup("body"), S.clean_markup("body"), "'http://x/' || doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'http://l/' || doc_id ELSE '' END", "'atom'", "'2024-01-03 04:05:06'", f"pos <= {feeds.ENTRIES_PER_FEED}"))
def atom_feeds(spark, d):
    """Entries of Atom feeds: the alternate link, a summary or a content, an image among the links."""
    i, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    tag = F.when(even, "summary").otherwise("content")
    links = F.concat(F.lit("<link rel='alternate' href='http://x/"), i, F.lit("'/><link rel='related' type='"), F.when(even, "image/png").otherwise("text/html"), F.lit("' href='http://l/"), i, F.lit("'/>"))
    entry = F.concat(F.lit("<entry><title>"), escaped(F.col("title")), F.lit("</title>"), links, F.lit("<"), tag, F.lit(">"), escaped(F.col("body")), F.lit("</"), tag, F.lit("><updated>2024-01-03T04:05:06Z</updated></entry>"))
    items = fed(for_landing(spark, d), entry, f"<feed {NAMESPACES}>", "</feed>")
    return shown_articles(feeds.raw_articles(feeds.capped(items), A.DEMO, F.lit(INGESTED).cast("timestamp_ntz"), F.lit("atom")))


@query(_landed_sql("title", "CASE WHEN doc_id % 3 = 0 THEN 'described' ELSE " + S.clean_markup("body") + " END", "'described'", "'http://x/' || doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'http://i/' || doc_id ELSE '' END", "CASE WHEN doc_id % 7 = 0 THEN 'NewsAPI' ELSE 'n' || (doc_id % 7) END", "'2024-01-04 05:06:07'", "doc_id % 5 <> 0"))
def json_landed(spark, d):
    """Articles of JSON answers: an empty content gives way to the description, removed ones are left out, an unnamed source has a name."""
    i = F.col("doc_id")
    article = F.struct(
        F.when(i % 5 == 0, F.concat(F.lit("was [Removed]"), "title")).otherwise(F.col("title")).alias("title"), F.when(i % 3 == 0, "").otherwise(F.col("body")).alias("content"), F.lit("described").alias("description"),
        F.concat(F.lit(" http://x/"), i.cast("string")).alias("url"), F.when(i % 2 == 0, F.concat(F.lit("http://i/"), i.cast("string"))).alias("urlToImage"), F.lit("2024-01-04T05:06:07Z").alias("publishedAt"),
        F.struct(F.when(i % 7 != 0, F.concat(F.lit("n"), (i % 7).cast("string"))).alias("name")).alias("source"),
    )
    path = landed(spark, F.to_json(F.struct(F.array(article).alias("articles"))), for_landing(spark, d), "json")
    answers = feeds.json_articles(spark, path, multi_line=False)
    return shown_articles(feeds.raw_articles(feeds.named(answers), A.DEMO, F.lit(INGESTED).cast("timestamp_ntz"), F.col("source_name")))


@query("SELECT 'p' || p_partkey::VARCHAR AS symbol, round(p_retailprice, 2) AS price, round(p_size / 7, 2) AS change, 0.0::DOUBLE AS change_pct, round(p_retailprice + p_size, 2) AS high, 0.0::DOUBLE AS low, CASE WHEN p_size % 2 = 0 THEN 0 ELSE round(p_retailprice / 3, 2) END::DOUBLE AS prev_close, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'USD' END AS currency FROM part")
def quotes_landed(spark, d):
    """Quotes from JSON answers; missing numbers are 0."""
    from ..sources import quotes

    p, size = F.col("p_retailprice"), F.col("p_size")
    quote = F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol"), p.alias("regularMarketPrice"), (size / 7).alias("regularMarketChange"), (p + size).alias("regularMarketDayHigh"), F.when(size % 2 != 0, p / 3).alias("regularMarketPreviousClose"), F.when(size % 3 != 0, "USD").alias("currency"))
    path = landed(spark, F.to_json(F.struct(F.struct(F.array(quote).alias("result")).alias("quoteResponse"))), A.table(spark, d, "part"), "quotes")
    return quotes.quotes(spark, path, multi_line=False)


# Enrichment


def varied_answers(rows: DataFrame, key: str = "doc_id", title: str = "title", body: str = "clean") -> Column:
    """Answers of all kinds, by the row's number: none, short, long and good ones, with known and unknown categories."""
    kind = F.col(key) % 7
    words, opening = text.words(F.col(body), 80), F.concat(F.col(title), F.lit(" "), F.col(title))

    def first(n: int) -> Column:
        return F.array_join(F.slice(words, 1, n), " ")

    given = F.struct(
        F.when(kind == 1, first(20)).when(kind == 2, F.concat(F.lit("New: "), F.col(title))).otherwise(F.col(title)).alias("refined_title"),
        F.when(kind == 1, first(80)).when(kind == 2, first(30)).when(kind == 3, "too short").when(kind == 4, opening).when(kind == 5, "").otherwise(first(12)).alias("summary"),
        F.when(kind == 2, first(60)).when(kind == 3, first(39)).when(kind == 5, None).otherwise("short body").alias("full_body"),
        F.when(kind == 1, "arts").when(kind == 2, "sports").when(kind == 3, "weather").when(kind == 4, None).otherwise("economy").alias("category"),
        F.when(kind == 1, F.lit([" a", "", "b ", "c", "d", "e", "f"])).when(kind == 2, F.lit(["Erha", "x"])).when(kind == 5, None).otherwise(F.lit(["y"])).alias("topic_tags"),
        (kind == 2).alias("is_trending"), F.when(kind == 3, "negative").when(kind == 4, None).otherwise("positive").alias("sentiment"), F.when(kind == 2, "today").alias("when_info"), F.lit(None).cast("string").alias("where_info"),
    )
    return F.when(kind != 0, given)


def varied_sql(key: str = "doc_id", title: str = "title", body: str = "clean") -> str:
    """The same answers as columns r_* and `answered`, in SQL."""

    def first(n: int) -> str:
        return f"array_to_string(({S.words(body)})[1:{n}], ' ')"

    k = f"{key} % 7"
    return f"""{k} <> 0 AS answered, CASE {k} WHEN 1 THEN {first(20)} WHEN 2 THEN 'New: ' || {title} ELSE {title} END AS r_title,
  CASE {k} WHEN 1 THEN {first(80)} WHEN 2 THEN {first(30)} WHEN 3 THEN 'too short' WHEN 4 THEN {title} || ' ' || {title} WHEN 5 THEN '' ELSE {first(12)} END AS r_summary,
  CASE {k} WHEN 2 THEN {first(60)} WHEN 3 THEN {first(39)} WHEN 5 THEN '' ELSE 'short body' END AS r_body, CASE {k} WHEN 1 THEN 'arts' WHEN 2 THEN 'sports' WHEN 3 THEN 'weather' WHEN 4 THEN '' ELSE 'economy' END AS r_category,
  CASE {k} WHEN 1 THEN [' a', '', 'b ', 'c', 'd', 'e', 'f'] WHEN 2 THEN ['Erha', 'x'] WHEN 5 THEN [] ELSE ['y'] END AS r_tags, {k} = 2 AS r_trending, CASE {k} WHEN 3 THEN 'negative' WHEN 4 THEN 'neutral' ELSE 'positive' END AS r_sentiment"""


def repaired_sql(base: str, default: str) -> str:
    """CTEs up to `mended`, from a relation of doc_id, title, clean and what varied_sql gives; all other columns of it stay."""
    later = S.strip(f"coalesce(array_to_string(({S.sentences('clean')})[2:3], ' '), '')")
    return f"""
m0 AS (SELECT *, {S.first_sentences('clean')} AS opening, {later} AS later, {S.truncate_words('clean', 180)} AS source FROM {base}),
m1 AS (SELECT *, CASE WHEN answered THEN r_title ELSE {S.truncate_words('title', 12)} END AS t0, CASE WHEN answered THEN r_summary ELSE {S.truncate_words("CASE WHEN opening = '' THEN title ELSE opening END", 55)} END AS s0,
  CASE WHEN answered THEN r_body WHEN source = '' THEN title ELSE source END AS b0 FROM m0),
m2 AS (SELECT *, CASE WHEN {S.word_count('t0')} > 14 THEN {S.truncate_words('t0', 12)} ELSE t0 END AS refined FROM m1),
m3 AS (SELECT *, CASE WHEN {S.word_count('s0')} < 10 THEN CASE WHEN opening = '' THEN refined ELSE opening END ELSE s0 END AS s1 FROM m2),
m4 AS (SELECT *, CASE WHEN {S.restates('s1', 'refined')} AND {S.word_count('later')} >= 15 AND NOT {S.restates('later', 'refined')} THEN later ELSE s1 END AS s2 FROM m3),
m5 AS (SELECT *, CASE WHEN {S.word_count('s2')} > 65 THEN {S.truncate_words('s2', 55)} ELSE s2 END AS summary FROM m4),
mended AS (SELECT * EXCLUDE (micro_tags), micro_tags, CASE WHEN {S.word_count('b0')} < 40 THEN CASE WHEN source = '' THEN summary ELSE source END ELSE b0 END AS long_body,
  CASE WHEN answered AND r_category IN ({', '.join(S.quoted(c) for c in enrichment.CATEGORIES)}) THEN r_category ELSE {default} END AS category,
  CASE WHEN answered THEN list_transform(list_filter(r_tags, lambda x: x <> ''), lambda x: trim(x))[1:5] ELSE [] END::VARCHAR[] AS tags, answered AND r_trending AS trending, CASE WHEN answered THEN r_sentiment ELSE 'neutral' END AS mood FROM m5)"""


def repair_rows(rows: DataFrame) -> DataFrame:
    cleaned = rows.withColumn("clean", text.clean_markup(F.col("body")))
    return enrichment.repaired(cleaned.withColumn("raw", varied_answers(cleaned)), body="clean", cleaned=True)


@query(S.with_(f"b AS (SELECT doc_id, headline AS title, {S.clean_markup('text')} AS clean, [] AS micro_tags FROM ({HEADLINE}))", f"r AS (SELECT *, {varied_sql()} FROM b)", repaired_sql("r", "'tech'"))
       + "SELECT doc_id, refined AS refined_title, summary, long_body AS full_body, category, array_to_string(tags, '|') AS tags, trending, mood FROM mended")
def validate_enrichment(spark, d):
    """Answers of all kinds, mended: titles and summaries too long, too short, or the same; bodies missing; unknown categories; untidy tags."""
    rows = headlines(spark, d).select("doc_id", F.col("headline").alias("title"), F.col("text").alias("body"), F.lit("tech").alias("category_default"))
    e = "enriched"
    return repair_rows(rows).select(
        "doc_id", f"{e}.refined_title", f"{e}.summary", f"{e}.full_body", f"{e}.category", F.array_join(f"{e}.topic_tags", "|").alias("tags"), F.col(f"{e}.is_trending").alias("trending"), F.col(f"{e}.sentiment").alias("mood")
    )


def no_provider(frame):
    raise ConnectionError


def half_provider(frame):
    """Answers, in a code fence, for titles of an even length; else something that is no answer."""
    import json

    texts = [f"```json\n{json.dumps({'refined_title': t + '!', 'summary': 'one two three four five six seven eight nine ten', 'category': 'arts', 'topic_tags': [' t']})}\n```" if len(t) % 2 == 0 else "no json" for t in frame["title"]]
    return frame["title"].map(dict(zip(frame["title"], texts)))


@query(S.with_(f"b AS (SELECT doc_id, headline AS title, {S.clean_markup('text')} AS clean, [] AS micro_tags FROM ({HEADLINE}))",
               "r AS (SELECT *, length(title) % 2 = 0 AS answered, title || '!' AS r_title, 'one two three four five six seven eight nine ten' AS r_summary, '' AS r_body, 'arts' AS r_category, [' t'] AS r_tags, false AS r_trending, 'neutral' AS r_sentiment FROM b)", repaired_sql("r", "'tech'"))
       + "SELECT doc_id, refined AS refined_title, summary, long_body AS full_body, category, array_to_string(tags, '|') AS tags FROM mended")
def provider_chain(spark, d):
    """A first provider that fails, a second one that answers for half of the rows, and the rules for the others."""
    rows = headlines(spark, d).select("doc_id", F.col("headline").alias("title"), text.clean_markup(F.col("text")).alias("body"), F.lit("tech").alias("category_default"))
    out, e = enrichment.repaired(enrichment.provided(rows, [no_provider, half_provider]), cleaned=True), "enriched"
    return out.select("doc_id", f"{e}.refined_title", f"{e}.summary", f"{e}.full_body", f"{e}.category", F.array_join(f"{e}.topic_tags", "|").alias("tags"))


SLUGS = "slugs(p, slug) AS (VALUES " + ", ".join(f"({i}, {S.quoted(s)})" for i, (_, s) in A.DEMO.pillars.items()) + ")"


@query(S.with_(S.articles(), SLUGS, """waiting AS (SELECT * FROM articles WHERE id % 3 <> 0 ORDER BY published_at DESC, id DESC LIMIT 50)""",
               f"b AS (SELECT w.id AS doc_id, headline AS title, {S.clean_markup('full_body')} AS clean, coalesce(slug, 'tech') AS default_slug, pillar_id, micro_tags FROM waiting w LEFT JOIN slugs ON p = pillar_id)",
               f"r AS (SELECT *, {varied_sql()} FROM b)", repaired_sql("r", "default_slug"))
       + """SELECT a.id, coalesce(m.refined, a.headline) AS headline, coalesce(m.summary, substr(a.full_body, 1, 40)) AS summary, coalesce(s.p, a.pillar_id)::INTEGER AS pillar_id,
array_to_string(CASE WHEN m.doc_id IS NULL THEN a.micro_tags ELSE list_filter(list_concat(m.tags, a.micro_tags), lambda x, i: list_position(list_concat(m.tags, a.micro_tags), x) = i)[1:10] END, '|') AS tags,
coalesce(m.trending, a.is_trending) AS is_trending, coalesce(m.mood, a.sentiment) AS sentiment, (m.doc_id IS NOT NULL OR a.id % 3 = 0) AS ai_processed
FROM articles a LEFT JOIN mended m ON m.doc_id = a.id LEFT JOIN slugs s ON s.slug = m.category""")  # fmt: skip
def enrichment_batch(spark, d):
    """The newest 50 articles that wait are answered for, mended and written back into all articles."""
    arts = A.articles(spark, d).withColumns({"ai_processed": F.col("id") % 3 == 0, "summary_60": F.substring("full_body", 1, 40)})
    waiting = A.with_classes(enrichment.to_enrich(A.articles(spark, d, classified=False), arts.where("ai_processed").select("id")))
    pillars = A.DEMO.pillar_table(spark)
    rows = browse.decorated(waiting, pillars, default=3).select("id", F.col("id").alias("doc_id"), F.col("headline").alias("title"), F.col("full_body").alias("body"), F.col("pillar_slug").alias("category_default"))
    out = enrichment.written_back(arts, repair_rows(rows).select("id", "enriched"), pillars)
    return out.select("id", "headline", F.col("summary_60").alias("summary"), "pillar_id", F.array_join("micro_tags", "|").alias("tags"), "is_trending", "sentiment", "ai_processed")


# One answer per user


@query(S.with_(S.articles(), S.beats(), S.daily(), S.progress()) + f""", users AS (SELECT DISTINCT user_id FROM daily),
times AS (SELECT user_id, coalesce(sum(duration_sec) FILTER (session_date = {S.NOW}::DATE), 0)::BIGINT AS today, coalesce(sum(duration_sec) FILTER (session_date >= {S.NOW}::DATE - 6), 0)::BIGINT AS week,
  count(*) FILTER (session_date BETWEEN {S.NOW}::DATE - 6 AND {S.NOW}::DATE AND duration_sec > 60) AS active FROM daily GROUP BY 1),
days AS (SELECT u.user_id, string_agg(day::VARCHAR || '=' || coalesce(duration_sec, 0)::VARCHAR, '|' ORDER BY day) AS daily_sec FROM users u CROSS JOIN (SELECT unnest(generate_series({S.NOW}::DATE - INTERVAL 6 DAY, {S.NOW}::DATE, INTERVAL 1 DAY))::DATE AS day) w
  LEFT JOIN daily ON daily.user_id = u.user_id AND session_date = day GROUP BY 1),
active_days AS (SELECT user_id, session_date, row_number() OVER (PARTITION BY user_id ORDER BY session_date DESC) AS n FROM daily WHERE duration_sec >= 60 QUALIFY n <= 180),
islands AS (SELECT user_id, max(session_date) AS last_day, count(*) AS days FROM active_days GROUP BY user_id, session_date + n::INTEGER),
streaks AS (SELECT user_id, coalesce(max(days) FILTER (last_day >= {S.NOW}::DATE - 1), 0) AS c, max(days) AS l FROM islands GROUP BY 1),
counts AS (SELECT user_id, count(*) FILTER (updated_at::DATE = {S.NOW}::DATE AND duration_sec >= 10) AS t, count(*) FILTER (updated_at::DATE >= {S.NOW}::DATE - 6 AND duration_sec >= 10) AS w, count(*) AS a FROM progress GROUP BY 1),
reads AS (SELECT user_id, pillar_id, count(*) AS n FROM progress JOIN articles ON articles.id = article_id WHERE updated_at::DATE >= {S.NOW}::DATE - 6 GROUP BY ALL),
filled AS (SELECT u.user_id, p.pillar_id, coalesce(n, 0) AS n FROM users u CROSS JOIN (SELECT unnest(range(1, 10))::INTEGER AS pillar_id) p LEFT JOIN reads r ON r.user_id = u.user_id AND r.pillar_id = p.pillar_id),
shares AS (SELECT *, round_even(n * 100.0 / greatest(1, sum(n) OVER (PARTITION BY user_id)), 0)::BIGINT AS pct FROM filled),
listed AS (SELECT user_id, string_agg(pillar_id::VARCHAR || '=' || n::VARCHAR || ',' || pct::VARCHAR, '|' ORDER BY pillar_id) AS categories, arg_min(pillar_id, (-n, pillar_id)) AS top FROM shares GROUP BY 1)
SELECT user_id, today AS time_today_sec, week AS time_week_sec, CASE WHEN week < 60 THEN week || 's' WHEN week < 3600 THEN (week // 60) || 'm' WHEN week % 3600 // 60 > 0 THEN (week // 3600) || 'h ' || (week % 3600 // 60) || 'm' ELSE (week // 3600) || 'h' END AS time_week_formatted,
CASE WHEN today < 60 THEN today || 's' WHEN today < 3600 THEN (today // 60) || 'm' WHEN today % 3600 // 60 > 0 THEN (today // 3600) || 'h ' || (today % 3600 // 60) || 'm' ELSE (today // 3600) || 'h' END AS time_today_formatted,
coalesce(c, 0) AS current_streak, coalesce(l, 0) AS longest_streak, t AS articles_today, w AS articles_week, a AS articles_total, daily_sec, categories, top AS top_category, round(week / greatest(1, active)::DOUBLE / 60, 1) AS avg_session_minutes, active AS active_days_week
FROM times JOIN days USING (user_id) JOIN counts USING (user_id) JOIN listed USING (user_id) LEFT JOIN streaks USING (user_id)""")  # fmt: skip
def reading_analytics(spark, d):
    """All that a profile shows of a user's reading, for every user."""
    beats = A.heartbeats(spark, d)
    progress = activity.reading_progress(beats)
    arts = read_articles(spark, d, activity.read_lately(progress, A.as_of()))
    found = activity.analytics(activity.daily_activity(beats), progress, arts, A.DEMO.pillar_table(spark), A.as_of())
    days = F.transform("daily_sec", lambda x: F.concat_ws("=", x["day"].cast("string"), x["duration_sec"].cast("string")))
    listed = F.transform("categories", lambda x: F.concat(x["pillar_id"].cast("string"), F.lit("="), x["reads"].cast("string"), F.lit(","), x["percent"].cast("string")))
    return found.withColumns({"daily_sec": F.array_join(days, "|"), "categories": F.array_join(listed, "|")})


@query(S.with_(S.articles(), S.actions(), S.preferences()) + """, done AS (SELECT user_id, count(*) FILTER (action = 'read') AS articles_read, count(*) FILTER (action = 'like') AS likes FROM actions GROUP BY 1),
marks AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, article_id FROM actions WHERE action = 'save' GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1),
listed AS (SELECT user_id, string_agg(topic_name || ':' || pillar_id::VARCHAR || ':' || round(weight * 10)::BIGINT::VARCHAR, '|' ORDER BY weight DESC, topic_name) AS preferences FROM preferences GROUP BY 1)
SELECT user_id, articles_read, likes, coalesce(n, 0) AS bookmarks, coalesce(preferences, '') AS preferences FROM done LEFT JOIN marks USING (user_id) LEFT JOIN listed USING (user_id)""")
def profile_page(spark, d):
    """Each user's counts, and the topics from the heaviest down with pillar and weight in tenths."""
    acts = A.interactions(spark, d)
    page = browse.profile_page(acts, prefs(spark, d), browse.bookmarks(acts))
    listed = F.transform("preferences", lambda p: F.concat_ws(":", p["topic_name"], p["pillar_id"].cast("string"), F.round(p["weight"] * 10).cast("long").cast("string")))
    return page.withColumn("preferences", F.array_join(listed, "|"))


@query(S.with_(S.articles()) + ", slugs(p, name, slug) AS (VALUES " + ", ".join(f"({i}, {S.quoted(n)}, {S.quoted(s)})" for i, (n, s) in A.DEMO.pillars.items()) + """)
SELECT id, '{"id":' || id || ',"refined_title":' || to_json(headline)::VARCHAR || ',"pillar":{"id":' || pillar_id || ',"name":' || to_json(name)::VARCHAR || ',"slug":' || to_json(slug)::VARCHAR || '},"micro_tags":' || to_json(micro_tags)::VARCHAR || ',"isTrending":' || is_trending || '}' AS body
FROM articles JOIN slugs ON p = pillar_id""")
def article_json(spark, d):
    """Articles as nested JSON."""
    return browse.as_json(browse.decorated(A.articles(spark, d), A.DEMO.pillar_table(spark)))


@query(f"""WITH t AS (SELECT doc_id, list_concat({S.topics_in('text', A.DEMO)}, [source, '"x\\' || chr(233) || chr(128512)]) AS tags FROM documents),
j AS (SELECT doc_id, tags, '[' || array_to_string(list_transform(tags, lambda x: to_json(x)::VARCHAR), ', ') || ']' AS whole FROM t)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(whole, '(?s).'), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\\u' || printf('%04x', unicode(c))
  ELSE '\\u' || printf('%04x', (unicode(c) - 65536) // 1024 + 55296) || '\\u' || printf('%04x', (unicode(c) - 65536) % 1024 + 56320) END), '') AS tags, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(tags, '|') END AS read_again FROM j""")
def tags_json(spark, d):
    """Tags as a JSON array in ASCII, and read again; what is no array is an empty one."""
    from ..functions.taxonomy import matched_topics

    tags = F.concat(matched_topics(F.col("text"), list(A.DEMO.topics)), F.array("source", F.lit('"x\\é\U0001f600')))
    written = A.table(spark, d, "documents").select("doc_id", scalars.ascii_json(tags).alias("tags"))
    read = scalars.parsed_tags(F.when(F.col("doc_id") % 5 == 0, "[bad").otherwise(F.col("tags")))
    return written.withColumn("read_again", F.array_join(read, "|"))


@query(f"""WITH titles AS (SELECT doc_id AS id, list_sort({S.token_set('headline')}) AS tokens FROM ({HEADLINE}))
SELECT id, min(id) OVER (PARTITION BY tokens) AS class_id, count(*) OVER (PARTITION BY tokens) AS n FROM titles WHERE len(tokens) > 0""")
def title_class_members(spark, d):
    """The class of each title by its words: the pairs of similar_title_classes are between such classes."""
    return dedup.class_members(headlines(spark, d).withColumnRenamed("doc_id", "id"))


# Markets


#: What the board shows of each class, in this order.
LABELS = [(c, i, x) for c, labels in (("stocks", ["s51", "s1", "s101", "s-none"]), ("forex", ["x2", "x52", "x102"]), ("metals", ["m3", "m2", "m6", "m4", "m9"]), ("crypto", ["C2", "C1", "C10"]), ("commodities", ["OIL", "GAS"])) for i, x in enumerate(labels)]


def _board_sql() -> str:
    def quotes(source: str) -> str:
        return f"SELECT label, round(coalesce(price, 0), 2) AS price, round(coalesce(price, 0) - coalesce(prev_close, 0), 2) AS change, CASE WHEN coalesce(prev_close, 0) = 0 THEN 0 ELSE round((price - prev_close) * 100 / prev_close, 2) END::DOUBLE AS change_pct FROM ({source})"

    def part(name: str, rest: int) -> str:
        return f"SELECT '{name}' || p_partkey::VARCHAR AS label, p_retailprice AS price, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 0 ELSE p_retailprice - p_size END AS prev_close FROM part WHERE p_partkey % 50 = {rest}"

    metals = """SELECT coalesce(a.label, b.label) AS label, coalesce(a.price, b.price) AS price, coalesce(b.change, 0) AS change, coalesce(b.change_pct, 0) AS change_pct
  FROM (SELECT 'm' || s_suppkey::VARCHAR AS label, CASE WHEN s_acctbal > 0 THEN round(1.0 / s_acctbal, 4) END AS price FROM supplier WHERE s_suppkey % 2 = 0) a
  FULL JOIN (SELECT 'm' || s_suppkey::VARCHAR AS label, s_acctbal AS price, 2.5 AS change, 3.5 AS change_pct FROM supplier WHERE s_suppkey % 3 = 0) b ON a.label = b.label"""
    return f"""WITH rows AS (SELECT 'stocks' AS asset_class, * FROM ({quotes(part('s', 1))}) UNION ALL SELECT 'forex', * FROM ({quotes(part('x', 2))})
  UNION ALL SELECT 'metals', label, price, change, change_pct FROM ({metals}) WHERE price IS NOT NULL
  UNION ALL SELECT 'crypto', upper('c' || s_suppkey::VARCHAR), round(coalesce(s_acctbal, 0), 2), NULL, round(coalesce(s_nationkey / 7, 0), 2) FROM supplier),
labels(asset_class, position, label) AS (VALUES {", ".join(f"({S.quoted(c)}, {i}, {S.quoted(x)})" for c, i, x in LABELS)}),
texts AS (SELECT asset_class, label || '=' || round(price * 10000)::BIGINT::VARCHAR || ',' || coalesce(round(change * 100)::BIGINT::VARCHAR, '') || ',' || round(change_pct * 100)::BIGINT::VARCHAR AS t, label FROM rows)
SELECT asset_class, count(t) AS n_quotes, string_agg(coalesce(t, label || '='), '|' ORDER BY position) AS quotes FROM labels LEFT JOIN texts USING (asset_class, label) GROUP BY 1"""


@query(_board_sql())
def market_board(spark, d):
    """Five classes of assets from their own sources, each with the labels that are shown; a label or a class without quotes stays, empty."""
    part, sup = A.table(spark, d, "part"), A.table(spark, d, "supplier")

    def listed(name: str, rest: int) -> DataFrame:
        before = F.when(F.col("p_size") % 10 == 0, None).when(F.col("p_size") % 10 == 1, 0.0).otherwise(F.col("p_retailprice") - F.col("p_size"))
        rows = part.where(F.col("p_partkey") % 50 == rest).select(F.concat(F.lit(name), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("price"), before.alias("prev_close"))
        return markets.quotes(rows).withColumnRenamed("symbol", "label")

    label = F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("label")
    primary = markets.metal_prices(sup.where("s_suppkey % 2 = 0").select(label.alias("symbol"), F.col("s_acctbal").alias("rate"))).select(F.col("symbol").alias("label"), "price", *(F.lit(None).cast("double").alias(c) for c in ("change", "change_pct")))
    futures = sup.where("s_suppkey % 3 = 0").select(label, F.col("s_acctbal").alias("price"), F.lit(2.5).alias("change"), F.lit(3.5).alias("change_pct"))
    coin = F.struct(F.col("s_acctbal").alias("usd"), F.lit(None).cast("double").alias("inr"), (F.col("s_nationkey") / 7).alias("usd_24h_change"), F.lit(0.0).alias("usd_market_cap"))
    coins = sup.select(F.create_map(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")), coin).alias("coins"))
    crypto = markets.crypto_quotes(coins, spark.createDataFrame([("c-none", "NONE")], "coin string, label string")).select(F.col("symbol").alias("label"), F.col("price_usd").alias("price"), F.lit(None).cast("double").alias("change"), "change_pct")
    metals = markets.with_fallback(primary, futures).fillna(0.0, ["change", "change_pct"]).where("price is not null")
    long = markets.board(stocks=listed("s", 1), forex=listed("x", 2), metals=metals, crypto=crypto)
    whole = markets.by_class(long, spark.createDataFrame(LABELS, "asset_class string, position int, label string"))
    number = F.transform("quotes", lambda q: F.concat(q["label"], F.lit("="), F.round(q["price"] * 10000).cast("long").cast("string"), F.lit(","), F.coalesce(F.round(q["change"] * 100).cast("long").cast("string"), F.lit("")), F.lit(","), F.round(q["change_pct"] * 100).cast("long").cast("string")))
    shown = F.zip_with(number, F.col("quotes"), lambda n, q: F.coalesce(n, F.concat(q["label"], F.lit("="))))
    return whole.select("asset_class", F.size(F.filter("quotes", lambda q: q["price"].isNotNull())).cast("long").alias("n_quotes"), F.array_join(shown, "|").alias("quotes"))


# Changes to tables


@query("""WITH a AS (SELECT o_custkey AS user_id, o_orderkey % 50 AS article_id, o_totalprice AS score, o_orderkey AS seq FROM orders),
old AS (SELECT * FROM a WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, article_id ORDER BY seq DESC) = 1),
new AS (SELECT * FROM a WHERE seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, article_id ORDER BY seq DESC) = 1)
SELECT user_id, article_id, score FROM new UNION ALL SELECT o.user_id, o.article_id, o.score FROM old o ANTI JOIN new n ON n.user_id = o.user_id AND n.article_id = o.article_id""")
def replace_by_key(spark, d):
    """Feed entries of a new run in place of those of an earlier one, by user and article."""
    a = A.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("article_id"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("seq"))
    keys = ["user_id", "article_id"]
    old = mutations.replaced_by_key(a.limit(0), a.where("seq % 3 = 0"), keys, ["seq"])
    return mutations.replaced_by_key(old, a.where("seq % 3 <> 0"), keys, ["seq"]).drop("seq")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'kept' ELSE {S.fingerprint('headline')} END AS title_hash FROM ({HEADLINE})")
def backfill_hashes(spark, d):
    """Fingerprints for articles whose own is null or empty."""
    rows = headlines(spark, d).withColumn("title_hash", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise("kept"))
    return mutations.backfilled(rows, "title_hash", text.title_fingerprint(F.col("headline"))).select("doc_id", "title_hash")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 7 END AS visits FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT -c_custkey, 'new', 1 FROM customer WHERE c_custkey % 10 = 0""")
def table_versions(spark, d):
    """Two tables of different columns in one, rows deleted by key, new ones appended, each state a version that is committed."""
    c = A.table(spark, d, "customer")
    stored = VersionedTable(spark, shared_folder(spark, "versions"), ["c_custkey"], {"visits": 0})
    stored.append(c.where("c_custkey % 2 = 0").select("c_custkey", "c_name"))
    stored.append(c.where("c_custkey % 2 = 1").select("c_custkey", "c_name", (F.col("c_custkey") % 7).alias("visits")))
    stored.delete(c.where("c_custkey % 5 = 0").select("c_custkey"))
    stored.append(c.where("c_custkey % 10 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(1).cast("bigint").alias("visits")))
    return stored.read()


# Streams


def beat_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import activity as stream

    raw = stream.heartbeat_stream(spark, d, A.table(spark, d, "events").schema, glob="events.parquet")
    return raw.select("event_id", "ts", "user_id", scalars.clamp(F.floor("value"), 0, 60).cast("long").alias("duration_sec"))


@query(S.with_(S.beats()) + "SELECT user_id, ts::DATE::VARCHAR AS session_date, sum(duration_sec)::BIGINT AS duration_sec FROM beats GROUP BY ALL")
def stream_daily_activity(spark, d):
    """Daily totals of a stream whose state is bounded by a watermark: each batch hands on what it changed."""
    from ..streaming import activity as stream

    out = stream.run_available(stream.daily_activity(beat_stream(spark, d), lateness="2 days"), shared_folder(spark, "daily"), keys=["user_id", "session_date"])
    return out.withColumn("session_date", F.col("session_date").cast("string"))


@query(S.with_(S.beats()) + """, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM beats),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
whole AS (SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS ended_at, sum(duration_sec)::BIGINT AS duration_sec, count(*) AS beats FROM runs GROUP BY user_id, run)
SELECT user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at, duration_sec, beats FROM whole WHERE ended_at <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_sessions(spark, d):
    """Sessions that a watermark of two days has closed."""
    from ..streaming import activity as stream

    out = stream.run_available(stream.sessions(beat_stream(spark, d)), shared_folder(spark, "sessions"))
    return out.select("user_id", moment("started_at"), moment("ended_at"), "duration_sec", "beats")


@query("SELECT event_id, user_id FROM events")
def stream_once(spark, d):
    """A stream in which every event comes twice, each once."""
    from ..streaming import activity as stream

    beats = beat_stream(spark, d)
    out = stream.run_available(stream.once(beats.union(beats), ["event_id"]), shared_folder(spark, "once"))
    return out.select("event_id", "user_id")
