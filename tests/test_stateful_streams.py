"""Streams with state of their own against the batch operators, out of order, over restarts, and with what they keep counted."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import activity, preferences
from newsloom.operators.versioned import VersionedTable
from newsloom.streaming import stateful
from newsloom.streaming.activity import run_available

ACTIONS = "event_id long, ts timestamp, user_id long, article_id long, action string"


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(k, 1 + k % 9, [f"t{k % 4}", f"t{k % 7}", "t0", "beyond"][: k % 5]) for k in range(20)], "id long, pillar_id int, micro_tags array<string>")


def made(seed, n, days):
    rng = random.Random(seed)
    kinds = list(preferences.DELTAS)
    return [(k, 1_700_000_000 + int(k * days * 86_400 / n), rng.randrange(6), rng.randrange(22), rng.choice(kinds)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, s long, user_id long, article_id long, action string").withColumn("ts", F.timestamp_seconds("s")).select("event_id", "ts", "user_id", "article_id", "action")


def test_weights_out_of_order_over_restarts(spark, articles, tmp_path):
    """Five runs, each a day apart of its neighbours at most; events of one time; repeated ones; state goes as the watermark moves."""
    rows = made(3, 900, 20)
    rows += [(1000 + k, rows[k * 9][1], rows[k * 9][2], k % 20, "dislike") for k in range(60)]  # ties in time
    rng = random.Random(9)
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(-0.9, 0.9) * 43_200)
    waiting, out = [], None
    for k in range(5):
        part = late[k * len(late) // 5 : (k + 1) * len(late) // 5]
        frame(spark, [*part, *part[:5]]).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ACTIONS).parquet(f"{tmp_path}/in")
        weights = stateful.learned_weights(stateful.preference_steps(stream, articles), lateness="1 day")
        out = stateful.with_rocks(spark, lambda w=weights: run_available(w, str(tmp_path), keys=["user_id", "topic_name"]))
        so_far = preferences.learned_weights(frame(spark, late[: (k + 1) * len(late) // 5]), articles)
        expected = sorted(map(tuple, so_far.select("user_id", "topic_name", "pillar_id", "weight").collect()))
        assert sorted((r["user_id"], r["topic_name"], r["pillar_id"], round(r["weight"], 6)) for r in out.collect()) == expected
        state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "waiting").load()
        waiting.append(state.count())
    assert max(waiting) <= 3 * len(rows) / 20 and waiting[-1] < len(rows) / 6  # what waits are days, not all that came
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != stateful.ROCKS


def test_steps_later_than_the_lateness_and_without_a_time_are_dropped(spark, articles, tmp_path):
    first, second = [(1, 1_700_500_000, 1, 3, "like")], [(2, 1_700_000_000, 1, 3, "save"), (3, 1_700_500_100, 1, 3, "save")]
    for part in (first, second):
        frame(spark, part).unionByName(frame(spark, [(9, 1, 1, 3, "save")]).withColumn("ts", F.lit(None).cast("timestamp"))).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ACTIONS).parquet(f"{tmp_path}/in")
        out = stateful.with_rocks(spark, lambda s=stream: run_available(stateful.learned_weights(stateful.preference_steps(s, articles), "1 hour"), str(tmp_path), keys=["user_id", "topic_name"]))
    assert {r["topic_name"]: r["weight"] for r in out.collect()} == {"t3": 2.6, "t0": 1.8}  # t3 stands twice in the article


def test_progress_in_batches_is_progress_of_all(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.randrange(5), rng.randrange(8), rng.randrange(101), rng.randrange(60), 1_700_000_000 + rng.randrange(10**6)) for k in range(400)]
    beats = spark.createDataFrame(rows, "event_id long, user_id long, article_id long, scroll_pct int, duration_sec long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    table = VersionedTable(spark, f"{tmp_path}/table", ["user_id", "article_id"])
    for k in range(4):
        beats.where(F.col("event_id") % 4 == k).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.progress_into(spark.readStream.schema(beats.schema).parquet(f"{tmp_path}/in"), table, "beats", f"{tmp_path}/checkpoint")
    columns = ["user_id", "article_id", "scroll_pct", "duration_sec", "completed", "started_at", "updated_at"]
    for strict in (False, True):
        expected = activity.reading_progress(beats, strict).select(columns)
        assert sorted(map(tuple, stateful.progress_of(table, strict).select(columns).collect())) == sorted(map(tuple, expected.collect()))
    versions = table.versions()
    # The stream's checkpoint is lost and all comes again under the numbers it had: batch 0 is known already, so nothing changes.
    stateful.progress_into(spark.readStream.schema(beats.schema).parquet(f"{tmp_path}/in"), table, "beats", f"{tmp_path}/lost")
    assert table.versions() == versions


def test_articles_are_inserted_once(spark, tmp_path):
    kind = "source_rank int, title_hash string, url string, headline string"
    runs = [[(1, "a", "u1", "second"), (0, "a", "u2", "first"), (0, "b", "u9", "stored address"), (0, "c", "u3", "c")], [(0, "c", "u4", "copy"), (0, "d", "u3", "same address"), (0, "e", "u5", "new")], [(0, "e", "u5", "new")]]
    table = VersionedTable(spark, f"{tmp_path}/table", ["title_hash"])
    table.append(spark.createDataFrame([(0, "z", "u9", "old")], kind))
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in/{k}")
        stateful.articles_into(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"), table, "articles", f"{tmp_path}/checkpoint", [F.col("source_rank"), F.col("url")])
    assert sorted(r["headline"] for r in table.read().collect()) == ["c", "first", "new", "old"]
    assert table.snapshot().batches == {"articles": 2}
