"""Many words at once against contains(); feeds that fail in every way."""

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from newsloom.operators import browse, patterns
from newsloom.sources import http as live


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_ten_thousand_words_as_contains_says(spark):
    """Overlaps, words in words, words over the ends of pieces, letters beyond the plane, short and repeated words."""
    rng = random.Random(3)
    letters = "abcdeé日🙂 "
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)})
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(60)] + ["x" * 255 + "abcdabcd" + "y" * 600, "", None, "aaaa"]
    got = patterns.found_in(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "body", spark.createDataFrame([(w,) for w in [*words, *words[:50], "", None, "abcdabcd"]], "word string"), "word")
    assert got.columns == ["id", "body", "word"]
    found = pairs(got.select("id", "word"))
    assert found == sorted({(i, w) for i, t in enumerate(texts) for w in [*words, "abcdabcd"] if t and w in t}) and len(found) > 1000


def test_no_pair_is_looked_at_that_shares_nothing(spark):
    texts, words = spark.range(1000).select("id", F.concat(F.lit("text number "), "id").alias("t")), spark.range(500).select(F.concat(F.lit("number "), "id").alias("w"))
    plan = patterns.found_in(texts, "t", words, "w")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert patterns.found_in(texts, "t", words.limit(0), "w").count() == 0 and patterns.found_in(texts.limit(0), "t", words, "w").count() == 0


def test_loose_notifications_by_hand(spark):
    articles = spark.createDataFrame([(k, f"h{k}", k, [["AI", "Main"], ["maintenance"], ["Ünï"], [], None, ["AI", "Main"]][k % 6]) for k in range(60)], "id long, headline string, published_at int, micro_tags array<string>")
    topics = ["AI", "main", "Ünï", "nothing", '", "', "u00dc"]
    wanted = spark.createDataFrame([(1, t, 1.0 + k) for k, t in enumerate(topics)], "user_id long, topic_name string, weight double")
    got = browse.notifications(wanted, articles, topics=6, loose=True)
    found = {}
    for r in got.collect():
        found.setdefault(r["topic_name"], []).append(r["article_id"])
    assert {t: sorted(x) for t, x in found.items()} == {"AI": [55, 59], "main": [55, 59], '", "': [54, 59], "u00dc": [50, 56]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


class Feeds(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        match self.path:
            case "/good":
                self.send_response(200)
                self.end_headers()
                self.wfile.write("<rss>é</rss>".encode())
            case "/cut":
                self.send_response(200)
                self.send_header("Content-Length", "5000")
                self.end_headers()
                self.wfile.write(b"<rss>")
            case "/none":
                self.send_response(204)
                self.end_headers()
            case "/line":
                self.wfile.write(b"nonsense\r\n\r\n")
            case _:
                self.send_error(500)

    def log_message(self, *args):
        pass


@pytest.fixture
def served():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Feeds)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_feed_that_fails_in_any_way_keeps_none_from_being_read(spark, served):
    urls = [f"{served}/cut", f"{served}/good", f"{served}/none", f"{served}/line", f"{served}/broken", "no scheme", "http://[bad", "file:///nowhere.xml", f"{served}/good?again"]
    got = {r["feed"]: (r["body"], r["failure"]) for r in live.asked_for(spark, urls).collect()}
    assert got[f"{served}/good"] == ("<rss>é</rss>", None)
    assert [got[u][1] for u in urls[:1] + urls[2:8]] == ["IncompleteRead", "status 204", "BadStatusLine", "HTTPError", "ValueError", "ValueError", "URLError"]
    assert {r["feed"] for r in live.pulled(spark, urls).collect()} == {f"{served}/good"}
