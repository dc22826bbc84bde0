"""Calls of services: several at once, each row for itself, deadlines, pauses, services that are passed over."""

import asyncio
import itertools
import json
import time

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.operators.providers import Limits, Provider, Window, asked, is_answer

QUICK = Limits(at_once=5, tries=2, pause=0.001, failures=1000)


def answer(title, **more):
    return json.dumps({"refined_title": title} | more)


def said(providers, limits, titles, batch=7):
    """title -> (answer, by, calls, failures), over batches of some rows."""
    batches = [pa.RecordBatch.from_pydict({"title": titles[k : k + batch], "body": ["b" * 9000] * len(titles[k : k + batch])}) for k in range(0, len(titles), batch)]
    rows = list(itertools.chain.from_iterable(b.to_pylist() for b in Window(providers, limits).run(iter(batches), "title", "body")))
    assert len(rows) == len(titles)
    return {r["title"]: (r["__json"], r["answered_by"], r["calls"], r["failures"]) for r in rows}


class Counted:
    """How many calls are in flight at once, of an async and of a plain function."""

    def __init__(self, seconds):
        self.seconds, self.now, self.most = seconds, 0, 0

    async def wait(self, title, body):
        self.now += 1
        self.most = max(self.most, self.now)
        await asyncio.sleep(self.seconds)
        self.now -= 1
        return answer(title)

    def block(self, title, body):
        self.now += 1
        self.most = max(self.most, self.now)
        time.sleep(self.seconds)
        self.now -= 1
        return answer(title)


def test_fifty_slow_rows_take_a_fifth_of_the_time_and_never_more_than_five_at_once():
    for kind in ("wait", "block"):
        counted = Counted(0.1)
        began = time.perf_counter()
        got = said([Provider("p", getattr(counted, kind))], QUICK, [f"t{k}" for k in range(50)])
        took = time.perf_counter() - began
        assert all(got[f"t{k}"][0] == answer(f"t{k}") for k in range(50))
        assert counted.most == 5 and 0.95 < took < 4  # one after the other they would take five seconds


def test_calls_do_not_fail_of_time_that_batches_and_answers_take():
    async def call(title, body):
        await asyncio.sleep(0.02 * (1 + int(title[1:]) % 4))  # so that some are in flight whenever a batch ends
        return answer(title)

    def batches():
        for k in range(3):
            time.sleep(0.6)  # as long as what comes before takes for a batch
            yield pa.RecordBatch.from_pydict({"title": [f"t{k * 7 + i}" for i in range(7)], "body": ["b"] * 7})

    found = []
    for batch in Window([Provider("p", call, deadline=0.3)], QUICK).run(batches(), "title", "body"):
        found += batch.to_pylist()
        time.sleep(0.6)  # and what comes after
    assert len(found) == 21 and all((r["calls"], r["failures"]) == (1, "") for r in found)


def test_a_slow_row_holds_up_its_own_batch_alone():
    async def call(title, body):
        await asyncio.sleep(1.0 if title == "t0" else 0.01)
        return answer(title)

    batches = (pa.RecordBatch.from_pydict({"title": [f"t{k}"], "body": [None]}) for k in range(40))
    order = [b.column("title")[0].as_py() for b in Window([Provider("p", call)], QUICK).run(batches, "title", "body")]
    assert order[-1] == "t0" and len(order) == 40


def test_one_failing_row_fails_alone():
    def call(title, body):
        if title == "t13":
            raise KeyError("a programming error")
        return answer(title, where_info=str(len(body)))

    got = said([Provider("p", call, body_chars=2000)], QUICK, [f"t{k}" for k in range(30)])
    assert got.pop("t13") == (None, None, 2, "p: KeyError; p: KeyError")
    assert {(r[1], r[2], r[3], json.loads(r[0])["where_info"]) for r in got.values()} == {("p", 1, "", "2000")}


def test_the_next_is_asked_and_failures_are_told():
    def first(title, body):
        return {"t0": None, "t1": "no json", "t2": "[1]", "t3": "```json\n" + answer("x") + "\n```", "t4": json.dumps({"summary": "no title"})}[title]

    got = said([Provider("a", first), Provider("b", lambda t, b: answer(t) if t != "t4" else None)], QUICK, [f"t{k}" for k in range(5)])
    assert [got[f"t{k}"][1:] for k in range(5)] == [("b", 2, "a: no answer")] * 3 + [("a", 1, "")] + [(None, 2, "a: no answer; b: no answer")]
    assert not is_answer("") and is_answer(' ```\n{"refined_title": ""}\n``` ')


def test_deadlines_and_pauses():
    tries = []

    async def slow_at_first(title, body):
        tries.append(time.perf_counter())
        if len(tries) == 1:
            await asyncio.sleep(60)
        return answer(title)

    got = said([Provider("p", slow_at_first, deadline=0.2)], Limits(tries=2, pause=0.2), ["t"])
    assert got["t"][1:] == ("p", 2, "p: TimeoutError") and 0.28 < tries[1] - tries[0] < 5

    def stuck(title, body):
        time.sleep(1.5)
        return answer(title)

    began = time.perf_counter()
    counted = Counted(0)
    got = said([Provider("p", stuck, deadline=0.1), Provider("q", counted.wait)], Limits(at_once=2, tries=1), ["t0", "t1", "t2"])
    # Threads can't be stopped: their places are free again when they return, and the other service gets them.
    assert {r[1:] for r in got.values()} == {("q", 2, "p: TimeoutError")} and 1.4 < time.perf_counter() - began < 6 and counted.most <= 2


def test_a_service_that_keeps_failing_is_passed_over_and_tried_again():
    calls = []

    async def down(title, body):
        calls.append(title)
        if len(calls) <= 6:
            raise ConnectionError
        return answer(title)

    async def other(title, body):
        await asyncio.sleep(0.02)
        return answer(title)

    got = said([Provider("down", down), Provider("other", other)], Limits(at_once=1, tries=1, pause=0, failures=4, rest=0.3), [f"t{k:02d}" for k in range(60)])
    by = [got[f"t{k:02d}"][1:] for k in range(60)]
    assert by[:4] == [("other", 2, "down: ConnectionError")] * 4 and by[4] == ("other", 1, "down: resting")
    assert by[-1] == ("down", 1, "") and 7 <= len(calls) < 50


def test_asked_in_spark(spark):
    rows = spark.range(60).select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("string").alias("body"), F.array("id").alias("x")).repartition(3)

    def call(title, body):
        assert body == ""
        if title == "t7":
            raise ConnectionError
        return answer(title, topic_tags=["a"])

    got = asked(rows, [Provider("p", call)], QUICK, tasks=2)
    found = {r["id"]: r for r in got.collect()}
    assert got.columns == ["id", "title", "body", "x", "answered_by", "calls", "failures", "raw"] and len(found) == 60
    assert found[7]["raw"] is None and found[8]["raw"]["refined_title"] == "t8" and found[8]["raw"]["topic_tags"] == ["a"] and found[8]["x"] == [8]
    assert asked(rows.limit(0), [Provider("p", call)], QUICK).count() == 0 and asked(rows, [], QUICK).where("raw is null").count() == 60
