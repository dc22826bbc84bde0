"""Stored layouts, feeds by deltas, postings and totals of days against plain ways to the same rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import browse, feed, feed_delta, layout, rollups, search_index
from newsloom.operators.preferences import learned_weights
from newsloom.operators.versioned import VersionedTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Layout


@pytest.fixture
def clustered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_ROWS", 100)
    articles = schemas.conformed(spark.range(400).selectExpr("id", "concat('h', id * 2) AS title_hash", "concat('u', id) AS url", "concat('t', id) AS headline"), "articles")
    marks = schemas.conformed(spark.range(1000).selectExpr("id % 7 AS user_id", "id % 410 AS article_id", "timestamp_ntz'2024-01-01 00:00:00' AS saved_at"), "bookmarks")
    made = layout.stored_together(spark, f"file://{tmp_path}", {"articles": articles, "bookmarks": marks}, f"t{random.randrange(10**9)}")
    yield made
    for t in made.values():
        t.drop()


def test_clustered_tables_meet_without_a_shuffle(spark, clustered, no_broadcast):
    marks, articles = clustered["bookmarks"].read(), clustered["articles"].read()
    joined = marks.join(articles.select(F.col("id").alias("article_id"), "headline"), "article_id")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert rows(joined.select("user_id", "article_id", "headline")) == sorted(((i % 7, i % 410, f"t{i % 410}") for i in range(1000) if i % 410 < 400), key=repr)


def scanned(df):
    """Rows that come out, and rows that the scan reads for them."""
    df = df.select("headline")
    executed = df._jdf.queryExecution().executedPlan()
    n = len(list(executed.executeCollect()))
    return n, executed.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_lookup_opens_one_bucket(spark, clustered):
    """Ids of every bucket span about the same range, so only the bucket tells that other files hold no 17."""
    articles = clustered["articles"]
    own = spark.table(articles.name).where(F.pmod(F.hash("id"), F.lit(16)) == spark.range(17, 18).select(F.pmod(F.hash("id"), F.lit(16))).first()[0]).count()
    assert scanned(articles.lookup(id=17)) == (1, own) and own < 60
    assert [r["headline"] for r in articles.lookup(id=17).collect()] == ["t17"] and articles.lookup(id=9999).isEmpty()


def test_bloom_filters_leave_row_groups_out(spark, clustered):
    """A value within the range of every file, and in none, is not read from any; one that is there from few files."""
    hit, looked = scanned(clustered["articles"].lookup(title_hash="h400"))
    assert scanned(clustered["articles"].lookup(title_hash="h401")) == (0, 0) and hit == 1 and looked < 100


def test_a_hot_key_is_read_by_files(spark, tmp_path):
    skewed = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("article_id"), "id")
    t = layout.ClusteredTable(spark, f"hot{random.randrange(10**9)}", f"file://{tmp_path}/hot", layout.Layout(("article_id",), ("article_id",))).write(skewed, 16)
    files = spark.read.parquet(t.path).where("article_id = 1").select("_metadata.file_name").distinct().count()
    assert t.hot() and 1 < files <= layout.SPLITS and sum(t.bucket_rows()) == 3000
    assert "Bucketed: true" not in plan(t.read()) and rows(t.read()) == rows(skewed) and rows(spark.table(t.name)) == rows(skewed)
    t.drop()


def test_clustered_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, None)], "article_id long, v int")
    t = layout.ClusteredTable(spark, f"odd{random.randrange(10**9)}", f"file://{tmp_path}/odd", layout.Layout(("article_id",), ("v",), ("v",))).write(odd, 4)
    assert rows(t.read()) == rows(odd)
    t.write(odd.limit(0), 2)
    assert rows(t.read()) == [] and not t.hot()
    t.drop()


def test_buckets_are_powers_of_two():
    assert [layout.buckets_for(n) for n in (0, 1, 1_000_000, 1_000_001, 5_000_000, 10**13)] == [1, 1, 1, 2, 8, layout.MOST_BUCKETS]


# Feeds

START = datetime.datetime(2024, 1, 10)


def moments(days):
    return F.lit(START + datetime.timedelta(days=days)).cast("timestamp_ntz")


@pytest.fixture
def world(spark):
    rng = random.Random(5)
    topics = ["Alpha", "alpha", "Beta", "Gamma", "Delta"]
    articles = spark.createDataFrame([(i, START + datetime.timedelta(hours=rng.randrange(-160, 96)), rng.random() < 0.2, rng.randrange(1, 4), rng.sample(topics, rng.randrange(0, 4))) for i in range(120)], "id long, published_at timestamp_ntz, is_trending boolean, pillar_id int, micro_tags array<string>")
    acts = [(e, START + datetime.timedelta(hours=rng.randrange(-100, 0)), rng.randrange(20), rng.randrange(120), rng.choice(["read", "like", "save", "dislike"])) for e in range(300)]
    acts += [(1000 + e, START + datetime.timedelta(hours=24 * (1 + e // 12) - rng.randrange(1, 23)), rng.choice([3, 4, 21 + e // 12]), rng.randrange(120), rng.choice(["like", "dislike", "save"])) for e in range(36)]
    actions = spark.createDataFrame(acts, "event_id long, ts timestamp_ntz, user_id long, article_id long, action string")
    return articles.cache(), actions.cache()


def test_feeds_by_deltas_equal_whole_ones_after_each(spark, world, tmp_path):
    articles, actions = world

    def now(day):
        until = moments(day)
        return actions.where(F.col("ts") < until), feed.candidates(articles.where(F.col("published_at") <= until), until, most=40)

    known, newest = now(0)
    kept = feed_delta.first(known, articles, newest).stored(spark, f"file://{tmp_path}/0")
    for day in (1, 2, 3):
        before, (known, newest) = kept, now(day)
        fresh_actions = known.where(F.col("ts") >= moments(day - 1))
        kept = feed_delta.refreshed(before, fresh_actions, known, articles, newest).stored(spark, f"file://{tmp_path}/{day}")
        engaged = newest.join(feed.engagement(known), "id", "left").withColumn("engagement", F.coalesce("engagement", F.lit(0)))
        whole = learned_weights(known, articles)
        assert rows(kept.preferences) == rows(whole)
        assert rows(feed_delta.shown(kept, engaged, moments(day))) == rows(feed.scores(engaged, whole, moments(day)))
        users = {r["user_id"] for r in fresh_actions.collect()}
        old, new = ({r["id"] for r in x.candidates.collect()} for x in (before, kept))
        pairs = kept.pairs.collect()
        assert old != new and all(p["fresh"] == (p["user_id"] in users or p["article_id"] not in old) for p in pairs)
        assert 0 < sum(p["fresh"] for p in pairs) < len(pairs) and {p["article_id"] for p in pairs} <= new


def test_a_refresh_without_news_scores_nothing(spark, world, tmp_path):
    articles, actions = world
    newest = feed.candidates(articles, moments(4), most=40)
    kept = feed_delta.first(actions, articles, newest).stored(spark, f"file://{tmp_path}/0")
    again = feed_delta.refreshed(kept, actions.limit(0), actions, articles, newest)
    assert again.pairs.where("fresh").isEmpty() and rows(again.pairs.drop("fresh").select("user_id", "article_id", "interest")) == rows(kept.pairs.drop("fresh").select("user_id", "article_id", "interest"))


# Search


def articles_of(spark, texts):
    return spark.createDataFrame([(i, h, b, START + datetime.timedelta(hours=i % 5)) for i, (h, b) in enumerate(texts)], "id long, headline string, full_body string, published_at timestamp_ntz")


def test_searches_equal_plain_ones(spark, tmp_path):
    rng = random.Random(2)
    words = ["Über", "aaa", "aab", "ba", "日本語の", "x%y_z", "a.b", "end", "😀a😁b"]
    long = "q" * (search_index.PIECE - 2) + "Needle" + "q" * 9000
    articles = articles_of(spark, [(" ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(120)] + [(None, None), ("", ""), ("one", None), (None, long)])
    asked = ["aaa", "AAA", "über", "a a", "本語の", "%y_", "a.b", "needle", "no such", "😀a😁", "a😁b", "end aaa", "b", "ba", "é", "aaaa", "one", None, "", "aaa"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    index = search_index.indexed(articles, f"file://{tmp_path}/index")
    got = {}
    for r in search_index.search_each(index, articles, queries, most=7).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    want = {q: [r["id"] for r in browse.search(articles, q, most=7).collect()] for q in set(asked) - {None, ""}}
    assert got == {q: ids for q, ids in want.items() if ids} and got["needle"] == [123]
    told = {r["query"]: (r["n_candidates"], r["n_hits"]) for r in search_index.report(index, articles, queries).collect()}
    assert told["needle"] == (1, 1) and "no such" not in told and all(c >= h for c, h in told.values())


def test_search_of_nothing(spark, tmp_path):
    articles = articles_of(spark, [("a title", "a body")])
    index = search_index.indexed(articles.limit(0), f"file://{tmp_path}/index")
    queries = spark.createDataFrame([("title",), ("a",)], "query string")
    assert search_index.hits(index, articles.limit(0), queries).isEmpty()
    full = search_index.indexed(articles, f"file://{tmp_path}/full")
    assert search_index.hits(full, articles, queries.limit(0)).isEmpty()
    assert rows(search_index.hits(full, articles, queries)) == [("a", 0), ("title", 0)]


def test_no_search_pairs_all_with_all(spark, tmp_path):
    articles = articles_of(spark, [("a title", "a body")])
    index = search_index.indexed(articles, f"file://{tmp_path}/index")
    text = plan(search_index.hits(index, articles, spark.createDataFrame([("title",), ("a",)], "query string")))
    assert "NestedLoop" not in text and "Cartesian" not in text


# Days


def some_actions(spark, n, users, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(START + datetime.timedelta(hours=rng.randrange(500)), rng.randrange(users), rng.choice(["read", "save", None]), rng.choice([5, None])) for _ in range(n)], "ts timestamp_ntz, user_id long, action string, duration_sec long")


def test_weeks_of_days_equal_those_of_actions(spark, tmp_path):
    acts = some_actions(spark, 900, 80).cache()
    days = VersionedTable(spark, f"file://{tmp_path}/days", ["day"])
    part = F.pmod(F.hash("user_id", "ts"), F.lit(3))
    for k in (0, 1, 2, 1):  # the last of them a second time
        rollups.added(days, acts.where(part == k), ("actions", k))
    want = acts.groupBy(F.trunc("ts", "week").alias("span")).agg(F.count("*"), F.count_if(F.col("action") == "read"), F.count_if(F.col("action") == "save"), F.sum(F.coalesce("duration_sec", F.lit(0))), F.count_distinct("user_id"))
    assert rows(rollups.spans(days.read(), "week")) == rows(want)
    assert days.read().count() == acts.select(F.to_date("ts")).distinct().count()


def test_late_days_change_their_own_files_only(spark, tmp_path):
    days = VersionedTable(spark, f"file://{tmp_path}/days", ["day"])
    states = rollups.day_states(some_actions(spark, 2000, 50))
    for later in (False, True):
        days.append(states.where((F.col("day") > F.lit(START.date() + datetime.timedelta(days=9))) == later))
    before = set(days.snapshot().files)
    late = spark.createDataFrame([(START, 7, "read", 5)], "ts timestamp_ntz, user_id long, action string, duration_sec long")
    first = rollups.told(days.read()).where(F.col("day") == F.lit(START.date())).first()
    rollups.added(days, late, ("late", 0))
    assert rollups.told(days.read()).where(F.col("day") == F.lit(START.date())).first()["n_reads"] == first["n_reads"] + 1
    assert len(before) == 2 and len(before & set(days.snapshot().files)) == 1


def test_many_users_within_the_stated_error(spark):
    acts = spark.range(100_000).select(F.lit(START).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("read").alias("action"), F.lit(1).cast("long").alias("duration_sec"))
    states = rollups.day_states(acts.where("user_id < 60000")).unionByName(rollups.day_states(acts.where("user_id >= 40000")))
    one = rollups.told(rollups.merged(states)).first()
    assert one["n_actions"] == 120_000 and abs(one["n_users"] - 100_000) < 4 * 2 ** (-rollups.LOG_ENTRIES / 2) * 100_000


def test_weeks_count_more_users_than_a_sketch_tells_apart(spark, tmp_path):
    acts = spark.range(60_000).select(F.lit(START).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("read").alias("action"), F.lit(1).cast("long").alias("duration_sec"))
    days, users = VersionedTable(spark, f"file://{tmp_path}/days", ["day"]), VersionedTable(spark, f"file://{tmp_path}/users", ["user_id", "day"])
    for number, part in ((0, "user_id < 40000"), (1, "user_id >= 30000"), (1, "user_id >= 30000")):
        rollups.added(days, acts.where(part), ("actions", number))
        rollups.users_added(users, acts.where(part), ("actions", number))
    one = rollups.spans(days.read(), "week", users.read()).collect()
    assert [(r["n_actions"], r["n_users"]) for r in one] == [(70_000, 60_000)]


def test_days_of_nothing(spark):
    none = some_actions(spark, 1, 1).limit(0)
    assert rollups.day_states(none).isEmpty() and rollups.spans(rollups.day_states(none), "week").isEmpty()
