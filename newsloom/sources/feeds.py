"""Landed feed files and JSON answers as rows of one raw-article shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.taxonomy import Taxonomy, matched_topics, pillar_of, scope_of

# Entries of a feed that count, characters of the two short texts, and what a JSON source without a name is called.
ENTRIES_PER_FEED, SUMMARY, SOURCE_SUMMARY, UNNAMED, REMOVED, NOWHERE = 36, 400, 200, "NewsAPI", "[Removed]", "Not specified"
_MEDIA = "`media:content` array<struct<_url string>>, `media:thumbnail` array<struct<_url string>>"
RSS_ITEM = f"title string, link string, description string, `content:encoded` string, pubDate string, enclosure array<struct<_type string, _url string>>, {_MEDIA}"
ATOM_ENTRY = f"title string, link array<struct<_rel string, _type string, _href string>>, summary string, content string, published string, updated string, {_MEDIA}"
#: The shape of an item of any kind of feed.
ITEM = "title string, link string, summary string, content string, published string, media array<string>, thumbnails array<string>, enclosures array<struct<type string, url string>>, links array<struct<type string, url string>>"
JSON_ARTICLES = "articles array<struct<title string, content string, description string, url string, urlToImage string, publishedAt string, source struct<name string>>>"


def rss_item(item: Column) -> Column:
    """A parsed RSS item as an ITEM."""
    return F.struct(
        item["title"].alias("title"), item["link"].alias("link"), item["description"].alias("summary"), item["content:encoded"].alias("content"), item["pubDate"].alias("published"),
        item["media:content"]["_url"].alias("media"), item["media:thumbnail"]["_url"].alias("thumbnails"),
        F.transform(item["enclosure"], lambda e: F.struct(e["_type"].alias("type"), e["_url"].alias("url"))).alias("enclosures"), F.lit(None).cast("array<struct<type string, url string>>").alias("links"),
    )


def atom_entry(entry: Column) -> Column:
    """A parsed Atom entry as an ITEM; its address is that of the alternate link, and a content stands in for a missing summary."""
    other = F.coalesce(entry["link"], F.array().cast("array<struct<_rel string, _type string, _href string>>"))
    named = F.get(F.filter(other, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]

    def listed(rel: str | None) -> Column:
        return F.transform(other if rel is None else F.filter(other, lambda x: x["_rel"] == rel), lambda x: F.struct(x["_type"].alias("type"), x["_href"].alias("url")))

    return F.struct(
        entry["title"].alias("title"), named.alias("link"), F.coalesce(entry["summary"], entry["content"]).alias("summary"), entry["content"].alias("content"), F.coalesce(entry["published"], entry["updated"]).alias("published"),
        entry["media:content"]["_url"].alias("media"), entry["media:thumbnail"]["_url"].alias("thumbnails"), listed("enclosure").alias("enclosures"), listed(None).alias("links"),
    )


def _items(spark: SparkSession, path: str, tag: str, schema: str, shaped) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    rows = rows.select(F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("__at"), shaped(F.struct("*")).alias("i"))
    return rows.select("feed", F.row_number().over(Window.partitionBy("feed").orderBy("__at")).alias("pos"), "i.*")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files: file, position in it (from 1), and ITEM."""
    return _items(spark, path, "item", RSS_ITEM, rss_item)


def atom_items(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed Atom files in the same shape."""
    return _items(spark, path, "entry", ATOM_ENTRY, atom_entry)


def json_articles(spark: SparkSession, path: str, unnamed: str = UNNAMED, multi_line: bool = True) -> DataFrame:
    """Articles of landed JSON answers (one to a file, or one to a line) with file, position (from 1) and the name of their source; removed ones are dropped."""
    each = spark.read.schema(JSON_ARTICLES).option("multiLine", multi_line).json(path).select(F.input_file_name().alias("feed"), F.posexplode("articles").alias("at", "a"))
    kept = each.where(~F.contains(F.coalesce("a.title", F.lit("")), F.lit(REMOVED)))
    content = F.when(F.col("a.content") != "", F.col("a.content"))
    return kept.select(
        "feed", (F.col("at") + 1).alias("pos"), "a.title", F.col("a.url").alias("link"), F.coalesce(content, "a.description", F.lit("")).alias("summary"), F.col("a.publishedAt").alias("published"),
        F.coalesce("a.urlToImage", F.lit("")).alias("image"), F.coalesce("a.description", F.lit("")).alias("description"), F.coalesce("a.source.name", F.lit(unnamed)).alias("source_name"),
    )


def named(items: DataFrame) -> DataFrame:
    """items with title and link trimmed; those without either go."""
    trimmed = items.withColumns({c: text.strip(F.coalesce(c, F.lit(""))) for c in ("title", "link")})
    return trimmed.where((F.col("title") != "") & (F.col("link") != ""))


def capped(items: DataFrame, most: int = ENTRIES_PER_FEED) -> DataFrame:
    """The first entries of each feed, those without title or address among them not replaced by later ones."""
    return named(items.where(F.col("pos") <= most))


def image_of(media: Column, thumbnails: Column, enclosures: Column, html: Column, links: Column) -> Column:
    """The first of these that is an http address: first media content, first thumbnail, image enclosure, image in the text, image link; else empty."""

    def http(url: Column) -> Column:
        return F.when(url.startswith("http"), url)

    def of_kind(listed: Column) -> Column:
        return F.get(F.filter(listed, lambda x: x["type"].startswith("image") & x["url"].startswith("http")), F.lit(0))["url"]

    in_text = text.first_image(html)
    return F.coalesce(http(F.get(media, F.lit(0))), http(F.get(thumbnails, F.lit(0))), of_kind(enclosures), F.when(in_text != "", in_text), of_kind(links), F.lit(""))


def published(value: Column, default: Column) -> Column:
    """The time in one of the usual forms, else the default."""
    rfc = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.try_to_timestamp(value), rfc, default.cast("timestamp")).cast("timestamp_ntz")


def raw_articles(items: DataFrame, taxonomy: Taxonomy, ingested_at: Column, source_name: Column) -> DataFrame:
    """The shape that is stored: title, cleaned text, fingerprint, pillar, tags, scope, image.

    items are ITEMs, or what json_articles gives, which bring their image and the text of source_summary along; a text that has been
    cleaned may come as `body` in place of the summary.
    """
    own = set(items.columns)
    image = F.col("image") if "image" in own else image_of(F.col("media"), F.col("thumbnails"), F.col("enclosures"), F.concat(*(F.coalesce(c, F.lit("")) for c in ("summary", "content"))), F.col("links"))
    title, body = F.col("title"), F.col("__body")
    short = F.col("description") if "description" in own else body
    cleaned = F.col("body") if "body" in own else text.clean_markup(F.col("summary"))
    return items.withColumns({"__body": cleaned, "__at": published(F.col("published"), ingested_at)}).select(
        F.col("link").alias("url"), text.title_fingerprint(title).alias("title_hash"), title.alias("headline"), F.substring(body, 1, SUMMARY).alias("summary_60"), body.alias("full_body"),
        F.substring(short, 1, SOURCE_SUMMARY).alias("source_summary"), F.date_format("__at", "yyyy-MM-dd'T'HH:mm:ss").alias("when_info"), F.lit(NOWHERE).alias("where_info"), title.alias("what_info"), F.lit("").alias("how_info"),
        image.alias("image_url"), source_name.alias("source_name"), pillar_of(title, body, taxonomy).alias("pillar_id"), matched_topics(F.concat_ws(" ", title, body), list(taxonomy.topics)).alias("micro_tags"),
        scope_of(title, body, taxonomy).alias("scope"), F.col("__at").alias("published_at"), F.lit(False).alias("ai_processed"), "feed", "pos",
    )
