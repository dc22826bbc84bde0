"""What the stream of preference weights keeps of a user, and how often it asks for it."""

import random

from pyspark.sql import functions as F

from newsloom.streaming import stateful
from newsloom.streaming.activity import run_available


class Counted:
    """A handle whose states are its own; each call to one is one message between Python and the JVM."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getValueState(self, name, schema):  # noqa: N802
        return State(self, name)

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        self.handle.calls += 1
        return self.name in self.handle.kept

    def get(self):
        self.handle.calls += 1
        return self.handle.kept.get(self.name)

    def update(self, value):
        self.handle.calls += 1
        self.handle.kept[self.name] = value

    put = update

    def clear(self):
        self.handle.calls += 1
        self.handle.kept.pop(self.name, None)


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_user_costs_few_calls_to_the_state():
    handle, weights = Counted(), stateful._Weights()
    weights.init(handle)
    rows = [(1, None, [k * 1_000_000, k, 3, 5], ["a", "b"][: 1 + k % 2]) for k in (3, 1, 2, 1)]
    out = list(weights.handleInputRows((1,), iter(rows), Time(0)))
    assert sorted(map(tuple, out)) == [(1, "a", 5, 1.9), (1, "b", 5, 1.6)] and handle.calls <= 4
    handle.calls = 0
    assert list(weights.handleExpiredTimer((1,), Time(2000), None)) == [] and handle.calls <= 5
    assert [s[1] for s in handle.kept["waiting"][0]] == [3] and dict(zip(handle.kept["weights"][0], handle.kept["weights"][2])) == {"a": 16, "b": 13}
    handle.calls = 0
    out = list(weights.handleInputRows((1,), iter([(1, None, [2_500_000, 9, -4, 7], ["c"])]), Time(2000)))
    assert sorted(map(tuple, out)) == [(1, "a", 5, 1.9), (1, "b", 5, 1.6), (1, "c", 7, 0.6)] and handle.calls <= 4


def test_what_waits_is_one_value_of_a_user_and_no_longer_than_the_lateness(spark, tmp_path):
    articles = spark.createDataFrame([(k, 1 + k % 9, [f"t{k % 4}", f"t{k % 7}"]) for k in range(20)], "id long, pillar_id int, micro_tags array<string>")
    rng = random.Random(4)
    rows = [(k, 1_700_000_000 + k * 2_400, rng.randrange(6), rng.randrange(20), "like") for k in range(720)]  # 20 days
    for part in (rows[:360], rows[360:]):
        actions = spark.createDataFrame(part, "event_id long, s long, user_id long, article_id long, action string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        actions.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(actions.schema).parquet(f"{tmp_path}/in")
        weights = stateful.learned_weights(stateful.preference_steps(stream, articles), lateness="1 day")
        stateful.with_rocks(spark, lambda w=weights: run_available(w, str(tmp_path), keys=["user_id", "topic_name"]))
        state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "waiting").load()
        users, steps = state.agg(F.count("*"), F.sum(F.size("value.step"))).first()
        assert 0 < users <= 6 and 0 < steps <= 36 + 1
