"""Totals of days that are stored and added up, so that longer spans are read from days and not from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versioned import VersionedTable

#: Users are counted exactly up to 2^LOG_ENTRIES, and beyond with a standard error of 2^(-LOG_ENTRIES / 2): 0.8 percent.
LOG_ENTRIES = 14
#: Seconds that add up, and the sketch of users.
SUMS, USERS = ("n_actions", "n_reads", "n_saves", "duration_sec"), "users"


def day_states(actions: DataFrame) -> DataFrame:
    """(day, n_actions, n_reads, n_saves, duration_sec, users) of actions (ts, user_id, action, duration_sec).

    Null actions count as actions only, null seconds as none; rows without a time are of the day null. Every task adds up
    its own rows first, so a day of any size is one row of each task's.
    """
    return actions.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_actions"), F.count_if(F.col("action") == "read").alias("n_reads"), F.count_if(F.col("action") == "save").alias("n_saves"),
        F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("long").alias("duration_sec"), F.theta_sketch_agg("user_id", LOG_ENTRIES).alias(USERS),
    )


def merged(states: DataFrame, *by) -> DataFrame:
    """States of longer spans, or of the same ones from several parts; without `by` one row of all."""
    return states.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS), F.theta_union_agg(USERS, LOG_ENTRIES).alias(USERS))


def told(states: DataFrame) -> DataFrame:
    """states with the number of users in place of the sketch."""
    return states.withColumn("n_users", F.theta_sketch_estimate(USERS)).drop(USERS)


def added(table: VersionedTable, actions: DataFrame, batch: tuple[str, int]) -> int:
    """Add a batch of actions, late ones among them, to the stored days (keyed by day): files without one of its days stay.

    A batch that has been added already adds nothing.
    """
    new = day_states(actions).where("day is not null")
    return table.merge(new, lambda old, rows: merged(old.unionByName(rows), "day"), batch=batch)


def users_added(table: VersionedTable, actions: DataFrame, batch: tuple[str, int]) -> int:
    """Add who was there on which day to a table (keyed by user_id and day), for spans whose users have to be exact however many they are.

    A user may come again with another batch of the same day; a batch that has been added already adds nothing.
    """
    return table.append(actions.select("user_id", F.to_date("ts").alias("day")).where("user_id is not null and day is not null").distinct(), batch)


def spans(states: DataFrame, unit: str, users: DataFrame | None = None) -> DataFrame:
    """(span, ..., n_users) by week, month ...: what is read is a row for each day.

    With users (user_id, day) these are counted, which is exact; else the sketches tell how many there are.
    """
    span = F.trunc("day", unit).alias("span")
    out = merged(states, span)
    if users is None:
        return told(out)
    counts = users.groupBy(span).agg(F.count_distinct("user_id").alias("n_users"))  # a row for each span
    return out.drop(USERS).join(counts, "span", "left").withColumn("n_users", F.coalesce("n_users", F.lit(0)))
