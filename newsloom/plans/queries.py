"""The named queries over the synthetic tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..functions.taxonomy import matched_topics, pillar_of, scope_of
from ..operators import activity, browse, dedup, enrichment, feed, markets, mutations, patterns, preferences
from ..session import shared_folder
from ..sources import adapters as A
from . import sql as S
from .registry import query


def moment(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def read_articles(spark: SparkSession, d: str, reads: DataFrame) -> DataFrame:
    """The articles of these reads (article_id), classified: the others need no class."""
    return A.with_classes(A.articles(spark, d, classified=False).join(reads.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi"))


def prefs(spark: SparkSession, d: str) -> DataFrame:
    acts = A.interactions(spark, d)
    return preferences.learned_weights(acts, read_articles(spark, d, acts))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The articles that feeds choose from, classified once there are few."""
    newest = A.with_classes(feed.candidates(A.articles(spark, d, classified=False), A.as_of()))
    return newest.join(feed.engagement(A.interactions(spark, d)), "id", "left").withColumn("engagement", F.coalesce("engagement", F.lit(0)))


ARTICLES, PLAIN, ACTIONS, BEATS, DAILY, PROGRESS, PREFS, FEED = S.articles(), S.plain_articles(), S.actions(), S.beats(), S.daily(), S.progress(), S.preferences(), S.feed()
HEADLINE = f"SELECT doc_id, substr(({S.sentences('text')})[1], 1, 80) AS headline, text FROM documents"


def headlines(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", text.opening(F.col("text")).alias("headline"), "text")


# Text


@query(f"SELECT page_id, {S.clean_markup('html')} AS clean, {S.word_count(S.clean_markup('html'))} AS n_words FROM pages")
def clean_html_pages(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.clean_markup(F.col("html")).alias("clean")).withColumn("n_words", text.word_count(F.col("clean")))


@query(f"SELECT doc_id, {S.normalise_title('headline')} AS normal, {S.fingerprint('headline')} AS title_hash FROM ({HEADLINE})")
def title_fingerprint(spark, d):
    return headlines(spark, d).select("doc_id", text.normalise_title(F.col("headline")).alias("normal"), text.title_fingerprint(F.col("headline")).alias("title_hash"))


@query(f"SELECT doc_id, {S.word_count('text')} AS n_words, {S.truncate_words('text', 12)} AS short, {S.first_sentences('text')} AS opening FROM documents")
def word_counts_and_openings(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), text.truncate_words(F.col("text"), 12).alias("short"), text.first_sentences(F.col("text")).alias("opening"))


@query(f"SELECT doc_id, {S.restates(S.first_sentences('text'), 'headline')} AS restates FROM ({HEADLINE})")
def summary_restates_title(spark, d):
    return headlines(spark, d).select("doc_id", text.restates_title(text.first_sentences(F.col("text")), F.col("headline")).alias("restates"))


@query(f"""WITH titles AS (SELECT doc_id AS id, list_sort({S.token_set('headline')}) AS tokens FROM ({HEADLINE})),
reps AS (SELECT min(id) AS id, tokens FROM titles WHERE len(tokens) > 0 GROUP BY tokens)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))::DOUBLE, 6) AS similarity
FROM reps a JOIN reps b ON a.id < b.id WHERE len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))::DOUBLE >= 0.8""")  # fmt: skip
def similar_title_classes(spark, d):
    return dedup.similar_titles(headlines(spark, d).withColumnRenamed("doc_id", "id"))


@query(f"SELECT doc_id, {S.pillar_of('headline', 'text', A.DEMO)} AS pillar_id, {S.scope_of('headline', 'text', A.DEMO)} AS scope, array_to_string({S.topics_in('text', A.DEMO)}, '|') AS tags FROM ({HEADLINE})")
def classified(spark, d):
    return headlines(spark, d).select("doc_id", pillar_of(F.col("headline"), F.col("text"), A.DEMO).alias("pillar_id"), scope_of(F.col("headline"), F.col("text"), A.DEMO).alias("scope"), F.array_join(matched_topics(F.col("text"), list(A.DEMO.topics)), "|").alias("tags"))


@query("SELECT page_id, CASE WHEN regexp_extract(html, '<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1) LIKE 'http%' THEN regexp_extract(html, '<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1) ELSE '' END AS image FROM pages")
def page_images(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.first_image(F.col("html")).alias("image"))


@query("SELECT c_custkey, replace(replace(replace(lower(c_name), ' ', '-'), '&', 'and'), '+', 'plus') AS slug, split_part(c_name || '@' || c_mktsegment, '@', 1) AS local_part, sha256(c_name) AS digest FROM customer")
def names_and_digests(spark, d):
    c = A.table(spark, d, "customer")
    return c.select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.local_part(F.concat_ws("@", "c_name", "c_mktsegment")).alias("local_part"), scalars.salted_hash(F.col("c_name")).alias("digest"))


@query(f"""WITH a AS (SELECT doc_id, {S.topics_in('text', A.DEMO)} AS tags FROM documents)
SELECT doc_id, array_to_string((list_distinct_ordered)[1:10], '|') AS tags FROM (SELECT doc_id, list_filter(list_concat(list_reverse(tags), ['Erha', 'News']), lambda x, i: list_position(list_concat(list_reverse(tags), ['Erha', 'News']), x) = i) AS list_distinct_ordered FROM a)""")
def tags_merged(spark, d):
    tags = matched_topics(F.col("text"), list(A.DEMO.topics))
    return A.table(spark, d, "documents").select("doc_id", F.array_join(scalars.merged_tags(F.reverse(tags), F.lit(["Erha", "News"])), "|").alias("tags"))


# Deduplication and ingestion


@query(f"""WITH a AS (SELECT doc_id, text, {S.fingerprint('headline')} AS title_hash, 'u' || (doc_id % 700)::VARCHAR AS url FROM ({HEADLINE})),
once AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY title_hash ORDER BY doc_id) = 1),
fresh AS (SELECT * FROM once WHERE title_hash NOT IN (SELECT title_hash FROM a WHERE doc_id < 50) AND url NOT IN (SELECT url FROM a WHERE doc_id < 50))
SELECT doc_id, url, title_hash FROM fresh QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1""")
def dedup_and_insert(spark, d):
    a = headlines(spark, d).select("doc_id", text.title_fingerprint(F.col("headline")).alias("title_hash"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("url"))
    return dedup.new_articles(a, a.where("doc_id < 50"), [F.col("doc_id")]).select("doc_id", "url", "title_hash")


@query(f"""WITH raw AS (SELECT {S.fingerprint('headline')} AS title_hash, 0 AS src FROM ({HEADLINE}) UNION ALL SELECT {S.fingerprint(S.clean_markup('html'))}, 1 FROM pages)
SELECT count(*) AS n_raw, count(DISTINCT title_hash) AS n_unique, (count(*) - count(DISTINCT title_hash))::BIGINT AS n_dropped FROM raw""")
def ingest_funnel(spark, d):
    docs = headlines(spark, d).select(text.title_fingerprint(F.col("headline")).alias("title_hash"))
    both = docs.unionByName(A.table(spark, d, "pages").select(text.title_fingerprint(text.clean_markup(F.col("html"))).alias("title_hash")))
    return both.agg(F.count("*").alias("n_raw"), F.count_distinct("title_hash").alias("n_unique")).withColumn("n_dropped", F.col("n_raw") - F.col("n_unique"))


# Preferences and feed


@query(S.with_(ARTICLES, ACTIONS, PREFS) + "SELECT user_id, topic_name, pillar_id, weight FROM preferences")
def pref_weights(spark, d):
    return prefs(spark, d)


@query(S.with_(ARTICLES, ACTIONS, PREFS, FEED) + "SELECT user_id, article_id, score FROM feed")
def feed_scores(spark, d):
    return feed.scores(candidates(spark, d), prefs(spark, d), A.as_of())


@query(S.with_(ARTICLES, ACTIONS, PREFS, FEED) + """, ranked AS (SELECT f.user_id, f.article_id, f.score, a.headline, a.scope, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, published_at DESC, article_id DESC) AS rank FROM feed f JOIN articles a ON a.id = f.article_id WHERE a.scope = 'local'),
more AS (SELECT *, max(rank) OVER (PARTITION BY user_id) > 20 AS has_more FROM (SELECT * FROM ranked WHERE rank <= 21))
SELECT user_id, article_id, score, headline, rank::BIGINT AS rank, has_more FROM more WHERE rank > 10 AND rank <= 20""")
def feed_page(spark, d):
    scored = feed.scores(candidates(spark, d), prefs(spark, d), A.as_of(), keep=("headline", "scope", "published_at"))
    shown = feed.page(scored, number=2, scope="local")
    return shown.select("user_id", "article_id", "score", "headline", F.col("rank").cast("long").alias("rank"), "has_more")


@query(S.with_(ARTICLES, ACTIONS, PREFS, FEED) + """, page AS (SELECT f.article_id AS id, f.score, a.headline FROM feed f JOIN articles a ON a.id = f.article_id WHERE f.user_id = 7 AND a.scope = 'nowhere' ORDER BY score DESC, a.published_at DESC, a.id DESC LIMIT 10),
recent AS (SELECT id, 1.0::DOUBLE AS score, headline FROM articles ORDER BY published_at DESC, id DESC LIMIT 10)
SELECT * FROM page WHERE (SELECT count(*) FROM page) >= 5 UNION ALL SELECT * FROM recent WHERE (SELECT count(*) FROM page) < 5""")
def feed_page_fallback(spark, d):
    mine = prefs(spark, d).where("user_id = 7")
    scored = feed.scores(candidates(spark, d), mine, A.as_of(), keep=("headline", "scope", "published_at")).where("scope = 'nowhere'")
    page = scored.orderBy(F.desc("score"), F.desc("published_at"), F.desc("article_id")).limit(10).select(F.col("article_id").alias("id"), "score", "headline")
    recent = A.articles(spark, d, classified=False).orderBy(*browse.newest()).limit(10).select("id", F.lit(1.0).alias("score"), "headline")
    return feed.page_or_recent(page, recent)


@query(f"SELECT doc_id, round(1 / (1 + ln(1 + date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 337 % 720)::INTEGER), {S.NOW}) / 3.6e9 / 4)), 6) AS recency, round(ln(1 + n_chars::DOUBLE) * 0.1, 6) AS boost, (('0x' || substr(md5(doc_id::VARCHAR || ':' || source), 1, 8))::BIGINT % 100) / 1000.0::DOUBLE AS bucket FROM documents")
def score_parts(spark, d):
    a = A.table(spark, d, "documents").withColumn("p", A.published_at(F.col("doc_id")))
    return a.select("doc_id", F.round(scalars.recency(F.col("p"), A.as_of()), 6).alias("recency"), F.round(scalars.engagement_boost(F.col("n_chars")), 6).alias("boost"), scalars.serendipity(F.col("doc_id"), F.col("source")).alias("bucket"))


# Browsing


@query(S.with_(ARTICLES) + """, shown AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id DESC) AS rank FROM (SELECT * FROM articles WHERE scope = 'local' AND pillar_id = 6 ORDER BY published_at DESC, id DESC LIMIT 21)),
more AS (SELECT *, (SELECT max(rank) FROM shown) > 20 AS has_more FROM shown)
SELECT id, headline, pillar_id, rank::BIGINT AS rank, has_more FROM more WHERE rank <= 20""")
def explore_page(spark, d):
    shown = browse.explore(A.articles(spark, d), A.DEMO, page=1, scope="local", category="Wellbeing")
    return shown.select("id", "headline", "pillar_id", F.col("rank").cast("long").alias("rank"), "has_more")


@query(S.with_(PLAIN) + f"SELECT id, headline, {S.moment('published_at')} AS published_at FROM articles WHERE is_trending ORDER BY articles.published_at DESC, id DESC LIMIT 30")
def trending(spark, d):
    return browse.trending(A.articles(spark, d, classified=False)).select("id", "headline", moment("published_at"))


@query(S.with_(PLAIN) + "SELECT id, headline FROM articles WHERE contains(lower(headline), 'license') OR contains(lower(full_body), 'license') ORDER BY published_at DESC, id DESC LIMIT 25")
def search_literal(spark, d):
    return browse.search(A.articles(spark, d, classified=False), "License").select("id", "headline")


@query(S.with_(ARTICLES) + ", dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.quoted(n)}, {S.quoted(s)})" for i, (n, s) in A.DEMO.pillars.items() if i != 5) + f") t(p, name, slug)) SELECT id, coalesce(name, {S.quoted(A.DEMO.pillars[1][0])}) AS pillar_name, coalesce(slug, {S.quoted(A.DEMO.pillars[1][1])}) AS pillar_slug FROM articles LEFT JOIN dim ON p = pillar_id")
def decorated(spark, d):
    dim = A.DEMO.pillar_table(spark).where("pillar_id <> 5")
    return browse.decorated(A.articles(spark, d), dim).select("id", "pillar_name", "pillar_slug")


def _notified(match: str) -> str:
    return S.with_(ARTICLES, ACTIONS, PREFS) + f""", heaviest AS (SELECT user_id, topic_name FROM preferences QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, topic_name) <= 5),
names AS (SELECT DISTINCT topic_name FROM preferences),
best AS (SELECT topic_name, id, headline FROM names JOIN articles ON {match} QUALIFY row_number() OVER (PARTITION BY topic_name ORDER BY published_at DESC, id DESC) <= 2)
SELECT user_id, topic_name, id AS article_id, headline FROM heaviest JOIN best USING (topic_name)"""


@query(_notified("list_contains(micro_tags, topic_name)"))
def notifications(spark, d):
    return browse.notifications(prefs(spark, d), A.articles(spark, d)).drop("published_at")


@query(_notified("contains(lower(array_to_string(micro_tags, '\",\"')), lower(topic_name)) AND regexp_full_match(topic_name, '[ -~]*')"))
def notifications_loose(spark, d):
    """Texts are read for their tags once, and weights learned once: both are stored. Pillars are not asked for."""
    path = shared_folder(spark, "notified")
    A.articles(spark, d).select("id", "headline", "published_at", "micro_tags").write.parquet(f"{path}/articles")
    articles = spark.read.parquet(f"{path}/articles")
    learned = preferences.learned_weights(A.interactions(spark, d), articles.withColumn("pillar_id", F.lit(None).cast("int")))
    learned.select("user_id", "topic_name", "weight").write.parquet(f"{path}/weights")
    return browse.notifications(spark.read.parquet(f"{path}/weights"), articles, loose=True).drop("published_at")


@query(f"""WITH words AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 3)
SELECT word, count(*) AS n_headlines, min(doc_id) AS first_id FROM words JOIN ({HEADLINE}) ON contains(lower(headline), word) GROUP BY word""")
def keyword_hits(spark, d):
    """In how many headlines each word of the benchmark stands, also within other words: some thousand words in one pass."""
    words = A.table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where(F.char_length("w") >= 3).select(F.lower("w").alias("word")).distinct()
    texts = headlines(spark, d).select("doc_id", F.lower("headline").alias("headline"))
    return patterns.found_in(texts, "headline", words, "word").groupBy("word").agg(F.count("*").alias("n_headlines"), F.min("doc_id").alias("first_id"))


@query(S.with_(PLAIN, ACTIONS) + f"SELECT s.user_id, s.article_id, {S.moment('s.saved_at')} AS saved_at, a.headline FROM (SELECT user_id, article_id, max(ts) AS saved_at FROM actions WHERE action = 'save' GROUP BY ALL HAVING count(*) % 2 = 1) s JOIN articles a ON a.id = s.article_id")
def bookmarks_list(spark, d):
    marks = browse.bookmarks(A.interactions(spark, d))
    return marks.join(A.articles(spark, d, classified=False).select(F.col("id").alias("article_id"), "headline"), "article_id").select("user_id", "article_id", moment("saved_at"), "headline")


@query(S.with_(ARTICLES, ACTIONS, PREFS) + """, marks AS (SELECT user_id, article_id FROM actions WHERE action = 'save' GROUP BY ALL HAVING count(*) % 2 = 1),
done AS (SELECT user_id, count(*) FILTER (action = 'read') AS n_read, count(*) FILTER (action = 'like') AS n_liked, count(*) AS n_actions FROM actions GROUP BY 1)
SELECT user_id, n_read, n_liked, n_actions, coalesce(n_topics, 0) AS n_topics, coalesce(n_bookmarks, 0) AS n_bookmarks, top_weight FROM done
LEFT JOIN (SELECT user_id, count(*) AS n_topics, round(max(weight), 2) AS top_weight FROM preferences GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n_bookmarks FROM marks GROUP BY 1) USING (user_id)""")
def profile_stats(spark, d):
    acts = A.interactions(spark, d)
    return browse.profile(acts, prefs(spark, d), browse.bookmarks(acts))


@query(S.with_(ARTICLES) + ", dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.quoted(n)})" for i, (n, _) in A.DEMO.pillars.items()) + ") t(pillar_id, name)) SELECT pillar_id, name, count(id) AS n_articles FROM dim LEFT JOIN articles USING (pillar_id) GROUP BY ALL")
def pillar_counts(spark, d):
    return browse.pillar_counts(A.articles(spark, d), A.DEMO.pillar_table(spark))


@query(S.with_(PLAIN) + "SELECT count(*) AS n_articles, count(*) FILTER (is_trending) AS n_trending, count(*) FILTER (sentiment = 'negative') AS n_negative, (SELECT count(DISTINCT user_id) FROM events) AS n_users FROM articles")
def health_rollup(spark, d):
    return browse.health(A.articles(spark, d, classified=False), A.table(spark, d, "events"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.quoted(n)}, {S.quoted('|'.join(t for t, p in A.DEMO.topics.items() if p == i))})" for i, (n, _) in A.DEMO.pillars.items()) + ") t(pillar_id, name, topics)")
def topic_tree(spark, d):
    return browse.topic_tree(A.DEMO.topic_table(spark), A.DEMO.pillar_table(spark))


@query("SELECT * FROM (VALUES " + ", ".join(f"({S.quoted(t)}, {p}, {S.quoted(t.lower())})" for t, p in A.DEMO.topics.items() if "er" in t.lower()) + ") t(name, pillar_id, slug)")
def topic_search(spark, d):
    return browse.topic_search(A.DEMO.topic_table(spark), "ER").select("name", "pillar_id", "slug")


@query(S.with_(PLAIN, ACTIONS) + ", r AS (SELECT article_id AS id, count(*) AS n FROM actions WHERE action = 'read' GROUP BY 1) SELECT id, headline, coalesce(n, 0)::BIGINT AS engagement, greatest(coalesce(n, 0) - 1, 0)::BIGINT AS shown_engagement FROM articles LEFT JOIN r USING (id)")
def article_details(spark, d):
    return browse.details(A.articles(spark, d, classified=False), A.interactions(spark, d)).select("id", "headline", "engagement", "shown_engagement")


@query(S.with_(PLAIN) + "SELECT id, headline FROM articles ORDER BY published_at DESC, id DESC LIMIT 25 OFFSET 40")
def recents_offset(spark, d):
    return browse.recents(A.articles(spark, d, classified=False), 40, 25).select("id", "headline")


# Activity


@query(S.with_(BEATS, DAILY) + f"SELECT user_id, session_date::VARCHAR AS session_date, duration_sec, {S.moment('last_seen')} AS last_seen FROM daily")
def daily_activity(spark, d):
    return activity.daily_activity(A.heartbeats(spark, d)).select("user_id", F.col("session_date").cast("string").alias("session_date"), "duration_sec", moment("last_seen"))


@query(S.with_(BEATS, DAILY) + f"SELECT u.user_id, day::DATE::VARCHAR AS day, coalesce(duration_sec, 0) AS duration_sec FROM (SELECT DISTINCT user_id FROM daily) u CROSS JOIN (SELECT unnest(generate_series({S.NOW}::DATE - INTERVAL 6 DAY, {S.NOW}::DATE, INTERVAL 1 DAY))::DATE AS day) w LEFT JOIN daily ON daily.user_id = u.user_id AND session_date = day")
def week_gap_filled(spark, d):
    return activity.week(activity.daily_activity(A.heartbeats(spark, d)), A.as_of()).withColumn("day", F.col("day").cast("string"))


@query(S.with_(BEATS, DAILY) + f""", active AS (SELECT user_id, session_date, row_number() OVER (PARTITION BY user_id ORDER BY session_date DESC) AS n FROM daily WHERE duration_sec >= 60 QUALIFY n <= 180),
islands AS (SELECT user_id, max(session_date) AS last_day, count(*) AS days FROM active GROUP BY user_id, session_date + n::INTEGER)
SELECT u.user_id, coalesce(max(days) FILTER (last_day >= {S.NOW}::DATE - 1), 0) AS current_streak, coalesce(max(days), 0) AS longest_streak FROM (SELECT DISTINCT user_id FROM daily) u LEFT JOIN islands i USING (user_id) GROUP BY 1""")
def streaks(spark, d):
    return activity.streaks(activity.daily_activity(A.heartbeats(spark, d)), A.as_of())


@query(S.with_(BEATS, PROGRESS) + f"SELECT user_id, article_id, scroll_pct, duration_sec, completed, {S.moment('started_at')} AS started_at, {S.moment('updated_at')} AS updated_at FROM progress")
def progress_completion(spark, d):
    return activity.reading_progress(A.heartbeats(spark, d)).select("user_id", "article_id", "scroll_pct", "duration_sec", "completed", moment("started_at"), moment("updated_at"))


@query(S.with_(ARTICLES, BEATS, PROGRESS) + f""", counts AS (SELECT user_id, pillar_id, count(*) AS reads FROM progress JOIN articles ON articles.id = article_id WHERE updated_at::DATE >= {S.NOW}::DATE - 6 GROUP BY ALL),
filled AS (SELECT u.user_id, p.pillar_id, coalesce(reads, 0) AS reads FROM (SELECT DISTINCT user_id FROM progress) u CROSS JOIN (SELECT unnest(range(1, 10))::INTEGER AS pillar_id) p LEFT JOIN counts c ON c.user_id = u.user_id AND c.pillar_id = p.pillar_id)
SELECT user_id, pillar_id, reads, round_even(reads * 100.0 / greatest(1, sum(reads) OVER (PARTITION BY user_id)), 0)::BIGINT AS percent, (row_number() OVER (PARTITION BY user_id ORDER BY reads DESC, pillar_id) = 1 AND reads > 0) AS is_top FROM filled""")
def category_breakdown(spark, d):
    progress = activity.reading_progress(A.heartbeats(spark, d))
    return activity.categories(progress, read_articles(spark, d, activity.read_lately(progress, A.as_of())), A.DEMO.pillar_table(spark), A.as_of())


@query(S.with_(BEATS, DAILY) + f"SELECT user_id, sum(duration_sec)::BIGINT AS time_week, count(*) FILTER (duration_sec > 60) AS active_days, round(sum(duration_sec)::BIGINT / greatest(1, count(*) FILTER (duration_sec > 60))::DOUBLE / 60, 1) AS avg_minutes FROM daily WHERE session_date >= {S.NOW}::DATE - 6 GROUP BY 1")
def avg_session_minutes(spark, d):
    return activity.average_minutes(activity.daily_activity(A.heartbeats(spark, d)), A.as_of())


@query(S.with_(PLAIN, BEATS, PROGRESS) + f"""SELECT user_id, article_id, headline, scroll_pct, duration_sec AS read_sec, {S.moment('updated_at')} AS last_read FROM
(SELECT * FROM progress WHERE NOT completed AND scroll_pct BETWEEN 10 AND 79 AND updated_at >= {S.NOW} - INTERVAL 3 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, article_id DESC) = 1) JOIN articles ON articles.id = article_id""")
def continue_reading(spark, d):
    found = activity.unfinished(activity.reading_progress(A.heartbeats(spark, d)), A.articles(spark, d, classified=False), A.as_of())
    return found.withColumn("last_read", F.date_format("last_read", "yyyy-MM-dd HH:mm:ss"))


@query(S.with_(ARTICLES, BEATS, PROGRESS) + f"""SELECT user_id, article_id, headline, pillar_id, scroll_pct, completed, {S.moment('updated_at')} AS updated_at FROM
(SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, article_id DESC) <= 10) JOIN articles ON articles.id = article_id""")
def recent_activity(spark, d):
    progress = activity.latest_reads(activity.reading_progress(A.heartbeats(spark, d)))
    found = activity.recent_reads(progress, read_articles(spark, d, progress))
    return found.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(S.with_(BEATS, DAILY) + """, s AS (SELECT user_id, (sum(duration_sec) * 7 % 9000)::BIGINT AS sec FROM daily GROUP BY 1)
SELECT user_id, sec, CASE WHEN sec < 60 THEN sec || 's' WHEN sec < 3600 THEN (sec // 60) || 'm' WHEN sec % 3600 // 60 > 0 THEN (sec // 3600) || 'h ' || (sec % 3600 // 60) || 'm' ELSE (sec // 3600) || 'h' END AS shown FROM s""")
def duration_format(spark, d):
    s = activity.daily_activity(A.heartbeats(spark, d)).groupBy("user_id").agg((F.sum("duration_sec") * 7 % 9000).cast("long").alias("sec"))
    return s.withColumn("shown", scalars.duration_text(F.col("sec")))


# Markets: series of prices from order lines

CANDLES = "candles AS (SELECT l_partkey % 40 AS symbol, l_shipdate AS day, l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS close FROM lineitem)"
ORDER = ("day", "l_orderkey", "l_linenumber")


def candles(spark: SparkSession, d: str) -> DataFrame:
    line = A.table(spark, d, "lineitem")
    return line.select((F.col("l_partkey") % 40).alias("symbol"), F.col("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("close"))


@query(S.with_(CANDLES) + "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC) AS n, round(close, 2) AS close FROM candles WHERE close IS NOT NULL QUALIFY n <= 20")
def price_tail(spark, d):
    return markets.spark_lines(candles(spark, d), order=ORDER)


@query(S.with_(CANDLES) + "SELECT symbol, l_orderkey, l_linenumber, round(close - lag(close) OVER (PARTITION BY symbol ORDER BY day, l_orderkey, l_linenumber), 2) AS change FROM candles WHERE close IS NOT NULL")
def close_to_close(spark, d):
    return markets.close_to_close(candles(spark, d), order=ORDER[1:]).select("symbol", "l_orderkey", "l_linenumber", "change")


QUOTES = "SELECT p_partkey AS symbol, p_retailprice AS price, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 0 ELSE p_retailprice - p_size END AS prev_close FROM part"


@query(f"SELECT symbol, round(coalesce(price, 0), 2) AS price, round(coalesce(price, 0) - coalesce(prev_close, 0), 2) AS change, CASE WHEN coalesce(prev_close, 0) = 0 THEN 0 ELSE round((price - prev_close) * 100 / prev_close, 2) END::DOUBLE AS change_pct FROM ({QUOTES})")
def quote_derivation(spark, d):
    before = F.when(F.col("p_size") % 10 == 0, None).when(F.col("p_size") % 10 == 1, 0.0).otherwise(F.col("p_retailprice") - F.col("p_size"))
    return markets.quotes(A.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), before.alias("prev_close")))


@query("""WITH first AS (SELECT s_suppkey AS label, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS price, CASE WHEN s_suppkey % 2 = 0 THEN 1.5 END AS change, NULL::DOUBLE AS change_pct FROM supplier WHERE s_suppkey % 5 <> 0),
second AS (SELECT s_suppkey AS label, s_acctbal / 2 AS price, 2.5 AS change, 3.5 AS change_pct FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT coalesce(a.label, b.label) AS label, coalesce(a.price, b.price)::DOUBLE AS price, coalesce(a.change, b.change)::DOUBLE AS change, coalesce(a.change_pct, b.change_pct)::DOUBLE AS change_pct,
round(coalesce(a.price, b.price) * 0.3215 * 84.5, 0)::DOUBLE AS price_inr FROM first a FULL JOIN second b ON a.label = b.label""")
def metal_board(spark, d):
    s = A.table(spark, d, "supplier")
    first = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("label"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("price"), F.when(F.col("s_suppkey") % 2 == 0, 1.5).alias("change"), F.lit(None).cast("double").alias("change_pct"))
    second = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("label"), (F.col("s_acctbal") / 2).alias("price"), F.lit(2.5).alias("change"), F.lit(3.5).alias("change_pct"))
    forex = spark.createDataFrame([("USD/INR", 84.5), ("EUR/INR", 91.0)], "label string, price double")
    return markets.in_rupees(markets.with_fallback(first, second), forex)


@query("SELECT s_suppkey AS symbol, CASE WHEN s_acctbal > 0 THEN round(1.0 / s_acctbal, 4) END AS price FROM supplier")
def metal_inverse(spark, d):
    return markets.metal_prices(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("rate")))


@query("""WITH snaps AS (SELECT CASE user_id % 5 WHEN 0 THEN 'stocks' WHEN 1 THEN 'crypto' WHEN 2 THEN 'metals' WHEN 3 THEN 'forex' ELSE 'commodities' END AS asset_class, ts AS fetched_at, CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS payload, event_id FROM events),
latest AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY asset_class ORDER BY fetched_at DESC) = 1), m AS (SELECT max(ts) AS t FROM events)
SELECT asset_class, payload FROM latest, m WHERE t <= fetched_at + to_seconds(CASE asset_class WHEN 'stocks' THEN 60 WHEN 'crypto' THEN 45 WHEN 'metals' THEN 180 WHEN 'forex' THEN 90 ELSE 120 END) AND payload NOT IN ('', '{}')""")
def ttl_snapshot(spark, d):
    e = A.table(spark, d, "events")
    kinds = F.element_at(F.lit(["stocks", "crypto", "metals", "forex", "commodities"]), (F.col("user_id") % 5 + 1).cast("int"))
    snaps = e.select(kinds.alias("asset_class"), F.col("ts").alias("fetched_at"), F.when(F.col("event_type") == "error", "{}").otherwise(F.col("props")).alias("payload"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return markets.fresh(snaps.crossJoin(F.broadcast(now)), F.col("now")).select("asset_class", "payload")


# Changes to tables


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Name ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def partial_update(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("Name "), F.col("c_custkey").cast("string")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "CHANGED").otherwise("").alias("c_mktsegment"))
    return mutations.patched(c, patch, "c_custkey", ["c_name", "c_mktsegment"], skip_empty=True)


@query(S.with_(ARTICLES, ACTIONS, PREFS) + """, chosen AS (SELECT DISTINCT user_id, 'Topic ' || (user_id % 4) AS topic_name, (user_id % 9 + 1)::INTEGER AS pillar_id FROM events WHERE user_id % 10 = 0)
SELECT user_id, topic_name, pillar_id, weight FROM preferences WHERE user_id % 10 <> 0 UNION ALL SELECT user_id, topic_name, pillar_id, 1.0 FROM chosen""")
def replace_user_topics(spark, d):
    chosen = A.table(spark, d, "events").where("user_id % 10 = 0").select("user_id", F.concat(F.lit("Topic "), (F.col("user_id") % 4).cast("string")).alias("topic_name"), (F.col("user_id") % 9 + 1).cast("int").alias("pillar_id"))
    return preferences.replaced_topics(prefs(spark, d), chosen)


@query(S.with_(BEATS) + "SELECT user_id, article_id, sum(duration_sec)::BIGINT AS duration_sec FROM beats GROUP BY ALL")
def upsert_counter(spark, d):
    b = A.heartbeats(spark, d)
    return mutations.upserted_sum(b.where("event_id % 2 = 0"), b.where("event_id % 2 = 1"), ["user_id", "article_id"], "duration_sec")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def insert_if_absent(spark, d):
    store = A.table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return mutations.insert_if_absent(store, A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [F.col("o_orderkey")])


# Enrichment


@query(f"""WITH b AS (SELECT doc_id, headline AS title, {S.clean_markup('text')} AS clean FROM ({HEADLINE})),
f AS (SELECT *, {S.first_sentences('clean')} AS opening FROM b)
SELECT doc_id, {S.truncate_words('title', 12)} AS refined_title, {S.truncate_words("CASE WHEN opening = '' THEN title ELSE opening END", 55)} AS summary,
CASE WHEN {S.truncate_words('clean', 180)} = '' THEN title ELSE {S.truncate_words('clean', 180)} END AS full_body FROM f""")
def enrich_by_rules(spark, d):
    e = enrichment.by_rules(F.col("headline"), F.col("text"), F.lit("tech"))
    return headlines(spark, d).select("doc_id", e.alias("e")).select("doc_id", "e.refined_title", "e.summary", "e.full_body")
