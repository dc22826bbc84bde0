"""Operators whose cases the tables don't hold."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from newsloom.operators import activity, dedup, enrichment, feed, markets, mutations, preferences
from newsloom.sources import feeds
from newsloom.sources.adapters import DEMO
from newsloom.streaming import activity as stream


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def beats(spark, rows):
    return spark.createDataFrame([(u, a, dt.datetime.fromisoformat(t), s, p) for u, a, t, s, p in rows], "user_id long, article_id long, ts timestamp_ntz, duration_sec long, scroll_pct int")


def test_first_wins_then_store(spark):
    batch = spark.createDataFrame([(1, "h1", "u1"), (2, "h1", "u2"), (3, "h2", "u9"), (4, "h3", "u3"), (5, "h4", "u3"), (6, "h9", "u5")], "seq int, title_hash string, url string")
    store = spark.createDataFrame([("h9", "u8"), ("h0", "u9")], "title_hash string, url string")
    assert sorted(r["seq"] for r in dedup.new_articles(batch, store, [F.col("seq")]).collect()) == [1, 4]


def test_completion_and_streak(spark):
    one = beats(spark, [(1, 1, "2024-01-30 10:00:00", 60, 80), (2, 1, "2024-01-30 10:00:00", 30, 80), (2, 1, "2024-01-30 10:01:00", 29, 5)])
    done = {r["user_id"]: r["completed"] for r in activity.reading_progress(one).collect()}
    assert done == {1: False, 2: True}
    assert all(r["completed"] for r in activity.reading_progress(one, strict_completion=True).collect())
    days = beats(spark, [(1, 1, f"2024-01-{d:02d} 10:00:00", 60, 1) for d in (10, 11, 12, 29, 30)] + [(2, 1, "2024-01-29 10:00:00", 60, 1), (3, 1, "2024-01-31 01:00:00", 59, 1)])
    found = {r["user_id"]: (r["current_streak"], r["longest_streak"]) for r in activity.streaks(activity.daily_activity(days), as_of()).collect()}
    assert found == {1: (2, 3), 2: (0, 1), 3: (0, 0)}


def test_weights_are_clamped_at_every_step(spark):
    order = ["dislike"] * 5 + ["save"] * 12 + ["dislike", "read"]
    actions = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, 0, i), 1, 7, a) for i, a in enumerate(order)], "event_id long, ts timestamp_ntz, user_id long, article_id long, action string")
    articles = spark.createDataFrame([(7, 3, ["A", "B", "C", "D"])], "id long, pillar_id int, micro_tags array<string>")
    w = 10
    for a in order:
        w = max(1, min(50, w + preferences.DELTAS[a]))
    whole = preferences.learned_weights(actions, articles).collect()
    assert {r["topic_name"]: r["weight"] for r in whole} == dict.fromkeys("ABC", w / 10)
    for seconds in (1, 3, 7):
        assert preferences.learned_weights(actions, articles, seconds).collect()[0]["weight"] == w / 10


def test_pages_are_disjoint_and_cover(spark):
    articles = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), "local", 1) for i in range(7)], "id long, published_at timestamp_ntz, scope string, pillar_id int")
    rows = spark.createDataFrame([(1, i, 1.0) for i in range(7)], "user_id long, article_id long, score double")
    pages = [[r["article_id"] for r in feed.page(rows, articles, number=n, size=3).orderBy("rank").collect()] for n in (1, 2, 3, 4)]
    assert pages == [[6, 5, 4], [3, 2, 1], [0], []]


def test_markets(spark):
    raw = spark.createDataFrame([({"bitcoin": {"usd": 1.234, "inr": None, "usd_24h_change": 2.0, "usd_market_cap": 5.9}, "doge": {"usd": None, "inr": 1.0, "usd_24h_change": None, "usd_market_cap": None}},)], "coins map<string, struct<usd: double, inr: double, usd_24h_change: double, usd_market_cap: double>>")
    labels = spark.createDataFrame([("bitcoin", "BTC")], "coin string, label string")
    got = {r["symbol"]: (r["price_usd"], r["price_inr"], r["market_cap_usd"]) for r in markets.crypto_quotes(raw, labels).collect()}
    assert got == {"BTC": (1.23, 0.0, 5), "DOGE": (0.0, 1.0, 0)}
    none = spark.createDataFrame([], "label string, price double")
    metals = spark.createDataFrame([("gold", 2000.0)], "label string, price double")
    assert markets.in_rupees(metals, none).first()["price_inr"] == round(2000 * 0.3215 * 83)
    board = markets.board(stocks=spark.createDataFrame([("A", 1.0, 0.0, 0.0)], "label string, price double, change double, change_pct double"))
    assert board.first()["asset_class"] == "stocks"


def test_mutations(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(2, "b", 5)], "id int, x string, y int")
    assert {tuple(r) for r in mutations.evolved(old, new, {"y": 0}).collect()} == {(1, "a", 0), (2, "b", 5)}
    assert mutations.without(new, old, ["id"]).count() == 1
    assert mutations.replaced_set(old, spark.createDataFrame([(1, "z"), (1, "z")], "id int, x string"), "id", ["id", "x"]).count() == 1
    assert spark.read.parquet(mutations.swap(spark, old, str(tmp_path), 1)).count() == 1


def test_enrichment_chain(spark):
    rows = spark.createDataFrame([("T one", "Body text."), ("T two", "Body text.")], "title string, body string").withColumn("category_default", F.lit("tech"))

    def broken(frame):
        raise RuntimeError

    def some(frame):
        return pd.Series(['```json\n{"refined_title": "R", "summary": "' + "w " * 70 + '", "full_body": "", "category": "arts", "topic_tags": ["x", " y "]}\n```' if t == "T one" else "no json" for t in frame["title"]], index=frame.index)

    got = {r["title"]: r["enriched"] for r in enrichment.repaired(enrichment.provided(rows, [broken, some])).collect()}
    assert got["T one"]["category"] == "arts" and got["T one"]["topic_tags"] == ["x", "y"] and len(got["T one"]["summary"].split()) == 55
    assert got["T two"]["category"] == "tech" and got["T two"]["summary"] == "T two" and got["T two"]["full_body"] == "Body text."


MEDIA = "xmlns:media='http://search.yahoo.com/mrss/' xmlns:content='http://purl.org/rss/1.0/modules/content/'"


def test_feed_files(spark, tmp_path):
    items = "".join(f"<item><title> T{i} &amp; more </title><link>http://x/{i}</link><description>&lt;img src='http://i/{i}.png'&gt; {'body ' * 100}</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>" for i in range(40))
    (tmp_path / "f.xml").write_text(f"<rss><channel><item><title> </title><link>http://x/none</link></item>{items}</channel></rss>")
    raw = feeds.raw_articles(feeds.capped(feeds.rss_items(spark, str(tmp_path / "f.xml"))), DEMO, as_of(), F.lit("feed"))
    rows = raw.orderBy("pos").collect()
    assert len(rows) == 35 and [r["pos"] for r in rows] == list(range(2, 37))  # the entry without a title counts
    first = rows[0]
    assert first["image_url"] == "http://i/0.png" and first["headline"] == first["what_info"] == "T0 & more" and first["published_at"] == dt.datetime(2024, 1, 2, 3, 4, 5) and first["when_info"] == "2024-01-02T03:04:05"
    assert (len(first["summary_60"]), len(first["source_summary"]), first["full_body"][:9]) == (400, 200, "body body")
    (tmp_path / "a.json").write_text('{"articles": [{"title": "A", "url": " http://a ", "content": "", "description": "<b>d</b>", "publishedAt": "bad", "source": {"name": "S"}}, {"title": "Gone [Removed]", "url": "http://b"}, {"title": "C", "url": "http://c", "content": "cc", "urlToImage": "http://i/c"}, {"title": null, "url": "http://d"}]}')
    got = feeds.raw_articles(feeds.named(feeds.json_articles(spark, str(tmp_path / "a.json"))), DEMO, as_of(), F.col("source_name")).orderBy("pos").collect()
    assert [(r["pos"], r["url"], r["source_name"], r["full_body"], r["source_summary"], r["image_url"], r["published_at"]) for r in got] == [(1, "http://a", "S", "d", "<b>d</b>", "", dt.datetime(2024, 1, 31)), (3, "http://c", "NewsAPI", "cc", "", "http://i/c", dt.datetime(2024, 1, 31))]


def test_images_of_feed_items(spark, tmp_path):
    parts = [
        "<media:content url='http://m/1'/><media:thumbnail url='http://t/1'/>", "<media:content url='ftp://m/2'/><media:content url='http://m/2b'/><media:thumbnail url='http://t/2'/>", "<enclosure type='audio/mp3' url='http://e/3a'/><enclosure type='image/png' url='http://e/3'/>",
        "<content:encoded>&lt;p&gt;&lt;img class='x' src=\"http://c/4\"&gt;</content:encoded>", "<description>&lt;img src='/relative'&gt;</description>", "",
    ]
    items = "".join(f"<item><title>T{i}</title><link>http://x/{i}</link>{x}</item>" for i, x in enumerate(parts))
    (tmp_path / "f.xml").write_text(f"<rss {MEDIA}><channel>{items}</channel></rss>")
    rows = feeds.raw_articles(feeds.capped(feeds.rss_items(spark, str(tmp_path / "f.xml"))), DEMO, as_of(), F.lit("feed")).orderBy("pos").collect()
    assert [r["image_url"] for r in rows] == ["http://m/1", "http://t/2", "http://e/3", "http://c/4", "", ""]


def test_atom_files(spark, tmp_path):
    entry = "<entry><title type='html'>One &amp;amp; two</title><link rel='alternate' href='http://x/1'/><link rel='enclosure' type='image/jpeg' href='http://i/1'/>{}<updated>2024-01-03T04:05:06Z</updated></entry>"
    (tmp_path / "f.xml").write_text(f"<feed {MEDIA}>{entry.format('<summary>short</summary><content>long</content>')}{entry.format('<content>only</content>')}<entry><title>no link</title></entry></feed>")
    rows = feeds.raw_articles(feeds.capped(feeds.atom_items(spark, str(tmp_path / "f.xml"))), DEMO, as_of(), F.lit("feed")).orderBy("pos").collect()
    assert [(r["url"], r["full_body"], r["image_url"], r["published_at"]) for r in rows] == [("http://x/1", body, "http://i/1", dt.datetime(2024, 1, 3, 4, 5, 6)) for body in ("short", "only")]


def test_quote_files(spark, tmp_path):
    from newsloom.sources import quotes

    (tmp_path / "q.json").write_text('{"quoteResponse": {"result": [{"symbol": "A", "regularMarketPrice": 1.234, "regularMarketDayHigh": 2.0, "currency": "USD"}, {"symbol": "B"}]}}')
    assert [tuple(r) for r in quotes.quotes(spark, str(tmp_path / "q.json")).orderBy("symbol").collect()] == [("A", 1.23, 0.0, 0.0, 2.0, 0.0, 0.0, "USD"), ("B", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "")]
    (tmp_path / "c.json").write_text('{"chart": {"result": [{"meta": {"symbol": "A"}, "indicators": {"quote": [{"close": [1.0, null, 3.456]}]}}]}}')
    assert [tuple(r) for r in markets.spark_lines(quotes.candles(spark, str(tmp_path / "c.json")), points=5).orderBy("n").collect()] == [("A", 1, 3.46), ("A", 2, 1.0)]
    (tmp_path / "x.json").write_text('{"bitcoin": {"usd": 2.5, "inr": 200.0}}')
    labels = spark.createDataFrame([("bitcoin", "BTC")], "coin string, label string")
    assert markets.crypto_quotes(quotes.coins(spark, str(tmp_path / "x.json")), labels).first()["symbol"] == "BTC"
    (tmp_path / "m.json").write_text('{"rates": {"XAU": 0.0005, "XAG": 0}}')
    assert {r["symbol"]: r["price"] for r in markets.metal_prices(quotes.rates(spark, str(tmp_path / "m.json"))).collect()} == {"XAU": 2000.0, "XAG": None}
    (tmp_path / "none.json").write_text('{"error": 1}')
    assert quotes.quotes(spark, str(tmp_path / "none.json")).count() == 0 and quotes.candles(spark, str(tmp_path / "none.json")).count() == 0


def test_schemas(spark):
    from newsloom import schemas

    rows = schemas.conformed(spark.createDataFrame([("u", None, 7)], "url string, pillar_id int, other int"), "articles")
    assert rows.columns == [f.name for f in schemas.TABLES["articles"].schema]
    assert (rows.first()["url"], rows.first()["pillar_id"], rows.first()["ai_processed"], rows.first()["scope"]) == ("u", 1, False, "global")
    assert all(schemas.empty(spark, name).count() == 0 for name in schemas.TABLES)


def test_page_or_recent(spark):
    shape = "id int, score double"
    recent = spark.createDataFrame([(9, 1.0)], shape)
    for n, expected in ((0, [9]), (4, [9]), (5, [0, 1, 2, 3, 4])):
        own = spark.createDataFrame([(i, 2.0) for i in range(n)], shape)
        assert sorted(r["id"] for r in feed.page_or_recent(own, recent).collect()) == expected


def test_close_to_close_over_days(spark):
    rows = [("a", 1, 1, 1.0), ("a", 1, 2, None), ("a", 1, 3, 2.5), ("a", 3, 1, None), ("a", 4, 1, 2.0), ("b", 4, 1, 7.0)]
    got = markets.close_to_close(spark.createDataFrame(rows, "symbol string, day int, at int, close double"))
    assert sorted((r["symbol"], r["day"], r["at"], r["change"]) for r in got.collect()) == [("a", 1, 1, None), ("a", 1, 3, 1.5), ("a", 4, 1, -0.5), ("b", 4, 1, None)]


def test_written_back(spark):
    store = spark.createDataFrame([(1, "old", 4, ["x", "y"], False), (2, "same", 5, None, False)], "id int, headline string, pillar_id int, micro_tags array<string>, ai_processed boolean")
    rows = spark.createDataFrame([(1, "A title", "Body text.", "tech")], "id int, title string, body string, category_default string").withColumn("raw", F.from_json(F.lit('{"refined_title": "R", "category": "arts", "topic_tags": [" y", "z"]}'), enrichment.SCHEMA))
    out = enrichment.written_back(store, enrichment.repaired(rows), DEMO.pillar_table(spark)).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "R", 4, ["y", "z", "x"], True), (2, "same", 5, None, False)]
    assert DEMO.pillar_of_slug("arts") == 4


def test_live_feeds(spark, tmp_path):
    from newsloom.sources import http

    for k in range(12):
        (tmp_path / f"{k}.xml").write_text(f"<rss><channel><title>c</title><item><title>A{k}</title><link>http://a/{k}</link><description>d</description></item><item><title>B</title><link>http://b/{k}</link></item></channel></rss>")
    found = feeds.capped(http.items_of(http.pulled(spark, [*(f"file://{tmp_path}/{k}.xml" for k in range(12)), "file:///nowhere.xml"])))
    assert found.count() == 24 and found.where("pos = 1").count() == 12
    assert feeds.raw_articles(found, DEMO, as_of(), F.col("feed")).count() == 24


def test_stream_equals_batch(spark, tmp_path):
    rows = beats(spark, [(u, 1, f"2024-01-{d:02d} 10:00:{d:02d}", u + d, 1) for u in (1, 2) for d in (1, 2, 3)])
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    live = stream.run_available(stream.daily_activity(stream.heartbeat_stream(spark, str(tmp_path / "in"), rows.schema)), str(tmp_path / "out"), keys=["user_id", "session_date"])
    assert {tuple(r) for r in live.collect()} == {(r["user_id"], r["session_date"], r["duration_sec"]) for r in activity.daily_activity(rows).collect()}


def test_stream_over_several_runs(spark, tmp_path):
    """What comes later changes the rows that it belongs to; what comes too late is dropped with its state."""
    shape = beats(spark, []).schema
    days = lambda: stream.run_available(stream.daily_activity(stream.heartbeat_stream(spark, str(tmp_path / "in"), shape), lateness="1 day"), str(tmp_path / "out"), keys=["user_id", "session_date"])
    beats(spark, [(1, 1, "2024-01-01 10:00:00", 5, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r["duration_sec"] for r in days().collect()] == [5]
    beats(spark, [(1, 1, "2024-01-01 11:00:00", 6, 1), (1, 1, "2024-01-09 10:00:00", 7, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["duration_sec"] for r in days().collect()) == [7, 11]
    beats(spark, [(1, 1, "2024-01-01 12:00:00", 9, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["duration_sec"] for r in days().collect()) == [7, 11]


def test_stream_at_an_interval(spark, tmp_path):
    rows = beats(spark, [(1, 1, "2024-01-01 10:00:00", 5, 1), (1, 1, "2024-01-09 10:00:00", 7, 1)])
    rows.write.parquet(str(tmp_path / "in"))
    running = stream.run_every(stream.daily_activity(stream.heartbeat_stream(spark, str(tmp_path / "in"), rows.schema), lateness="1 day"), str(tmp_path / "days"), str(tmp_path / "checkpoint"), interval="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert [r["duration_sec"] for r in spark.read.parquet(str(tmp_path / "days")).collect()] == [5]


def test_scores_and_cleaned_pages_are_worked_out_once(spark):
    from newsloom.plans import composed, queries
    from newsloom.sources import feeds

    d = "/root/testdata/sf0.001"
    frames = {
        "md5(": feed.scores(queries.candidates(spark, d), queries.prefs(spark, d), F.lit("2024-01-31").cast("timestamp_ntz")),
        "(?i)read more at": feeds.raw_articles(feeds.named(composed.json_items(spark, d)), composed.A.DEMO, F.lit("2024-01-31").cast("timestamp_ntz"), F.col("source_name")),
    }
    for what, df in frames.items():
        assert df._jdf.queryExecution().optimizedPlan().toString().count(what) == 1, what


def test_a_cleaned_body_is_not_cleaned_again(spark):
    rows = spark.createDataFrame([("t", "one &amp; two", "tech")], "title string, body string, category_default string")
    rows = rows.withColumn("raw", F.from_json(F.lit(None).cast("string"), enrichment.SCHEMA))
    assert enrichment.repaired(rows, cleaned=True).first()["enriched"]["full_body"] == "one &amp; two"
