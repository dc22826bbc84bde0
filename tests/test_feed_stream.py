"""Feeds as a stream: changed, unchanged, failing and vanished ones over several triggers, conditional questions, replays."""

import http.server
import json
import threading

import pytest

from newsloom.sources import feed_stream as fs
from newsloom.sources import feeds
from newsloom.streaming.activity import run_available


def rss(*keys, guid=False):
    return "<rss><channel>" + "".join(f"<item><title>t {k}</title>" + (f"<guid>g{k}</guid><link>http://x/{k}?again</link>" if guid else f"<link>http://x/{k}</link>") + f"<description>body {k}</description></item>" for k in keys) + "</channel></rss>"


def atom(*keys):
    return "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join(f"<entry><title>t {k}</title><link rel='alternate' href='http://x/{k}'/><summary>s</summary></entry>" for k in keys) + "</feed>"


class Folder:
    def __init__(self, path):
        self.path = path

    def put(self, **bodies):
        for name, body in bodies.items():
            file = self.path / f"{name}.xml"
            file.unlink(missing_ok=True) if body is None else file.write_text(body, encoding="utf-8")

    def url(self, name):
        return (self.path / f"{name}.xml").as_uri()


def poll(spark, tmp, urls, **options):
    """One run of the query: what came with it, as (feed's file, titles) or (feed's file, failure)."""
    answers = fs.asked(spark, urls, str(tmp / "landing"), seconds=0, **options)
    batches = []

    def keep(batch, number):
        batches.append((number, [(r["feed"].rsplit("/", 1)[-1], r["failure"]) for r in batch.where("failure is not null").collect()], [(r["feed"].rsplit("/", 1)[-1], r["title"]) for r in fs.new_items(batch).collect()]))

    answers.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sorted(x for b in batches for x in b[1]), sorted(x for b in batches for x in b[2])


def test_each_entry_once_over_changes_failures_and_gaps(spark, tmp_path):
    site = Folder(tmp_path)
    urls = [site.url(n) for n in ("changing", "still", "failing", "gone", "atoms")]
    site.put(changing=rss(1, 2), still=rss(3), failing="<rss><channel>", gone=rss(5, 6), atoms=atom("é", "日"))
    failed, came = poll(spark, tmp_path, urls)
    assert failed == [("failing.xml", "ParseError")]
    assert came == sorted([("changing.xml", "t 1"), ("changing.xml", "t 2"), ("still.xml", "t 3"), ("gone.xml", "t 5"), ("gone.xml", "t 6"), ("atoms.xml", "t é"), ("atoms.xml", "t 日")])
    assert poll(spark, tmp_path, urls) == ([("failing.xml", "ParseError")], [])
    site.put(changing=rss(7, 1, 2), failing=rss(4), gone=None, atoms=atom("日", "new"))
    assert poll(spark, tmp_path, urls) == ([("gone.xml", "URLError")], [("atoms.xml", "t new"), ("changing.xml", "t 7"), ("failing.xml", "t 4")])
    site.put(gone=rss(6, 8), changing=rss(2), atoms=atom("é", "日"))  # what it had before is known still; é comes back
    assert poll(spark, tmp_path, urls) == ([], [("gone.xml", "t 8")])
    added = Folder(tmp_path)
    added.put(later=rss(9))
    assert poll(spark, tmp_path, [added.url("later"), *urls[1:]]) == ([], [("later.xml", "t 9")])
    kept = [len(list(d.iterdir())) for d in (tmp_path / "landing" / fs.ANSWERS).iterdir()]
    assert max(kept) <= 2 and len(list((tmp_path / "landing" / fs.TURNS).iterdir())) <= 2


def test_a_bounded_number_of_feeds_for_each_trigger(spark, tmp_path):
    site = Folder(tmp_path)
    site.put(**{f"f{k}": rss(k) for k in range(7)})
    urls = [site.url(f"f{k}") for k in range(7)]
    runs = [poll(spark, tmp_path, urls, feeds_per_trigger=3)[1] for _ in range(4)]
    assert [[t for _, t in r] for r in runs] == [["t 0", "t 1", "t 2"], ["t 3", "t 4", "t 5"], ["t 6"], []]
    with pytest.raises(ValueError):
        fs.asked(spark, urls, str(tmp_path / "landing"), feeds_per_trigger=0)


def test_no_feeds(spark, tmp_path):
    assert poll(spark, tmp_path, []) == ([], [])


def test_a_turn_that_is_run_again_gives_the_same_rows(spark, tmp_path):
    """The feed changes after the turn, and the batch's commit is lost: the entries of the turn come again, the change with the next."""
    site = Folder(tmp_path)
    site.put(a=rss(1, 2))
    assert poll(spark, tmp_path, [site.url("a")])[1] == [("a.xml", "t 1"), ("a.xml", "t 2")]
    site.put(a=rss(3, 1))
    for lost in (tmp_path / "checkpoint" / "commits").iterdir():
        lost.unlink()
    again = [poll(spark, tmp_path, [site.url("a")])[1] for _ in range(2)]
    assert again == [[("a.xml", "t 1"), ("a.xml", "t 2")], [("a.xml", "t 3")]]


def test_turns_of_the_reader(tmp_path):
    reader = fs.FeedStreamReader([f"u{k}" for k in range(5)], str(tmp_path), 2, 3600)
    assert reader.latestOffset() == reader.latestOffset() == {"turn": 1}  # the second question comes too soon
    assert fs.FeedStreamReader([], str(tmp_path), 2, 3600).latestOffset() == {"turn": 2}

    def turns(a, b):
        return {u: t for p in reader.partitions({"turn": a}, {"turn": b}) for u, t in p.asked}

    assert turns(0, 1) == {"u0": 1, "u1": 1} and turns(1, 2) == {"u2": 2, "u3": 2} and turns(2, 3) == {"u4": 3, "u0": 3}
    assert turns(0, 1000) == turns(997, 1000) and set(turns(0, 1000)) == set(reader.urls) and turns(4, 4) == {}


def test_answers_as_they_are_landed():
    first = fs.next_answer({}, rss(*range(50)), None, "e", "m")
    assert first["fresh"] == list(range(1, feeds.ENTRIES_PER_FEED + 1))  # what is further down counts once it has moved up
    same = fs.next_answer(first, rss(*range(50)), None, "e2", None)
    assert (same["body"], same["fresh"], same["etag"], same["count"]) == (None, [], "e2", 2)
    assert fs.next_answer(first, rss(49, 0), None, None, None)["fresh"] == [1]
    assert fs.next_answer(same, None, None, "e2", None) == {**same, "body": None}
    late = first
    for _ in range(fs.REMEMBERED):
        late = fs.next_answer(late, rss(99), None, None, None)
    assert len(late["known"]) == 1 and fs.next_answer(late, rss(0), None, None, None)["fresh"] == [1]
    assert fs.next_answer({}, rss(1, guid=True), None, None, None)["known"] != fs.next_answer({}, rss(1), None, None, None)["known"]
    assert fs.next_answer({}, rss(1, 1), None, None, None)["fresh"] == [1] and fs.next_answer({}, "", None, None, None)["failure"] == "ParseError"
    assert fs.next_answer({}, rss(), None, None, None)["body"] is None


def test_the_first_of_two_tries_is_the_one_that_counts(tmp_path):
    landing = fs.Landing(f"file:{tmp_path}/at")
    assert landing.written("x/000000000003", {"n": 1}) == landing.written("x/000000000003", {"n": 2}) == {"n": 1}
    assert landing.numbers("x") == [3] and landing.numbers("none") == [] and json.loads((tmp_path / "at/x/000000000003").read_text()) == {"n": 1}
    landing.removed("x", [3], 4)
    landing.removed("x", [3], 4)
    assert landing.numbers("x") == []


class Validated(http.server.BaseHTTPRequestHandler):
    tag, seen = '"1"', []

    def do_GET(self):  # noqa: N802
        self.seen.append(self.headers.get("If-None-Match"))
        if self.headers.get("If-None-Match") == self.tag:
            self.send_response(304)
            self.end_headers()
            return
        self.send_response(200)
        self.send_header("ETag", self.tag)
        self.end_headers()
        self.wfile.write(rss(self.tag.strip('"')).encode())

    def log_message(self, *args):
        pass


def test_questions_are_conditional(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Validated)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = [f"http://127.0.0.1:{server.server_port}/feed"]
        runs = [poll(spark, tmp_path, url) for _ in range(2)]
        Validated.tag = '"2"'
        runs += [poll(spark, tmp_path, url) for _ in range(2)]
    finally:
        server.shutdown()
    assert runs == [([], [("feed", "t 1")]), ([], []), ([], [("feed", "t 2")]), ([], [])]
    assert Validated.seen == [None, '"1"', '"1"', '"2"']


def test_rows_of_a_stream_are_raw_articles(spark, tmp_path):
    from pyspark.sql import functions as F

    from newsloom.sources import adapters

    site = Folder(tmp_path)
    site.put(a=rss(1, 2))
    items = feeds.capped(fs.new_items(fs.asked(spark, [site.url("a")], str(tmp_path / "landing"), seconds=0)))
    raw = feeds.raw_articles(items, adapters.DEMO, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), F.lit("rss"))
    rows = run_available(raw, str(tmp_path / "out")).collect()
    assert sorted((r["url"], r["headline"], r["full_body"]) for r in rows) == [("http://x/1", "t 1", "body 1"), ("http://x/2", "t 2", "body 2")]
