"""Reading analytics: daily activity, streaks, completion, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import duration_text

# Seconds of an active day for streaks and for averages, days that the longest streak looks at, scroll of a finished read, seconds of a read.
STREAK_SECONDS, ACTIVE_SECONDS, STREAK_DAYS, FINISHED, READ_SECONDS = 60, 60, 180, 80, 10


def daily_activity(beats: DataFrame) -> DataFrame:
    """(user_id, session_date, duration_sec, last_seen): seconds of each user and day."""
    return beats.groupBy("user_id", F.to_date("ts").alias("session_date")).agg(F.sum("duration_sec").alias("duration_sec"), F.max("ts").alias("last_seen"))


def reading_progress(beats: DataFrame, strict_completion: bool = False) -> DataFrame:
    """(user_id, article_id, scroll_pct, duration_sec, completed, started_at, updated_at).

    A read is complete at FINISHED percent, by default only once a second heartbeat came.
    """
    done = F.max("scroll_pct") >= FINISHED
    if not strict_completion:
        done = done & (F.count("*") >= 2)
    return beats.groupBy("user_id", "article_id").agg(
        F.max("scroll_pct").alias("scroll_pct"), F.sum("duration_sec").alias("duration_sec"), done.alias("completed"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at")
    )


def week(daily: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, day, duration_sec) of the seven days up to as_of, without gaps."""
    days = daily.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.date_sub(F.to_date(as_of), 6), F.to_date(as_of))).alias("day"))
    return days.join(daily.select("user_id", F.col("session_date").alias("day"), "duration_sec"), ["user_id", "day"], "left").withColumn("duration_sec", F.coalesce("duration_sec", F.lit(0)).cast("long"))


def _islands(daily: DataFrame) -> DataFrame:
    """Runs of active days on end: (user_id, last_day, days)."""
    active = daily.where(F.col("duration_sec") >= STREAK_SECONDS).select("user_id", "session_date")
    latest = active.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("session_date")))).where(F.col("n") <= STREAK_DAYS)
    return latest.groupBy("user_id", F.date_add("session_date", F.col("n").cast("int")).alias("island")).agg(F.max("session_date").alias("last_day"), F.count("*").alias("days"))


def streaks(daily: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, current_streak, longest_streak); a current one ends at as_of or the day before."""
    islands = _islands(daily)
    current = F.max(F.when(F.col("last_day") >= F.date_sub(F.to_date(as_of), 1), F.col("days")))
    found = islands.groupBy("user_id").agg(current.alias("c"), F.max("days").alias("l"))
    return daily.select("user_id").distinct().join(found, "user_id", "left").select("user_id", F.coalesce("c", F.lit(0)).cast("long").alias("current_streak"), F.coalesce("l", F.lit(0)).cast("long").alias("longest_streak"))


def read_lately(progress: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Reads of the last days up to as_of."""
    return progress.where(F.to_date("updated_at") >= F.date_sub(F.to_date(as_of), days - 1))


def categories(progress: DataFrame, articles: DataFrame, pillars: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(user_id, pillar_id, reads, percent, is_top): reads of the last days by pillar, pillars without any included."""
    recent = read_lately(progress, as_of, days).join(articles.select(F.col("id").alias("article_id"), "pillar_id"), "article_id")
    counts = recent.groupBy("user_id", "pillar_id").agg(F.count("*").alias("reads"))
    grid = progress.select("user_id").distinct().crossJoin(F.broadcast(pillars.select("pillar_id")))  # a dimension of a few rows
    filled = grid.join(counts, ["user_id", "pillar_id"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)).cast("long"))
    user = Window.partitionBy("user_id")
    total = F.greatest(F.lit(1), F.sum("reads").over(user))
    top = (F.row_number().over(user.orderBy(F.desc("reads"), "pillar_id")) == 1) & (F.col("reads") > 0)
    return filled.select("user_id", "pillar_id", "reads", F.bround(F.col("reads") * 100.0 / total, 0).cast("long").alias("percent"), top.alias("is_top"))


def average_minutes(daily: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, time_week, active_days, avg_minutes) of the last seven days."""
    recent = daily.where(F.col("session_date") >= F.date_sub(F.to_date(as_of), 6))
    sums = recent.groupBy("user_id").agg(F.sum("duration_sec").alias("time_week"), F.count_if(F.col("duration_sec") > ACTIVE_SECONDS).alias("active_days"))
    return sums.withColumn("avg_minutes", F.round(F.col("time_week") / F.greatest(F.lit(1), F.col("active_days")) / 60, 1))


def unfinished(progress: DataFrame, articles: DataFrame, as_of: Column, low: int = 10, high: int = 79, days: int = 3) -> DataFrame:
    """Each user's latest read of the last days that is under way: (user_id, article_id, headline, scroll_pct, read_sec, last_read)."""
    open_reads = progress.where(~F.col("completed") & F.col("scroll_pct").between(low, high) & (F.col("updated_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    latest = open_reads.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("article_id")))).where("n = 1")
    return latest.join(articles.select(F.col("id").alias("article_id"), "headline"), "article_id").select("user_id", "article_id", "headline", "scroll_pct", F.col("duration_sec").alias("read_sec"), F.col("updated_at").alias("last_read"))


def latest_reads(progress: DataFrame, most: int = 10) -> DataFrame:
    """Each user's latest reads."""
    return progress.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("article_id")))).where(F.col("n") <= most).drop("n")


def recent_reads(latest: DataFrame, articles: DataFrame) -> DataFrame:
    """The latest reads with their articles."""
    return latest.join(articles.select(F.col("id").alias("article_id"), "headline", "pillar_id"), "article_id").select("user_id", "article_id", "headline", "pillar_id", "scroll_pct", "completed", "updated_at")


def analytics(daily: DataFrame, progress: DataFrame, articles: DataFrame, pillars: DataFrame, as_of: Column) -> DataFrame:
    """One row per user with all that a profile shows of the reading: time, streaks, articles, the week's days and categories.

    Users are those with any activity. The two nested columns are arrays of structs, in the order of days and of pillars; the top
    category is the first of the most read ones, also where nothing was read.
    """
    today, first = F.to_date(as_of), F.date_sub(F.to_date(as_of), 6)
    days = week(daily, as_of).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "duration_sec"))).alias("daily_sec"))
    late = F.col("session_date") >= first
    times = daily.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(F.col("session_date") == today, F.col("duration_sec"))), F.lit(0)).alias("time_today_sec"),
        F.coalesce(F.sum(F.when(late, F.col("duration_sec"))), F.lit(0)).alias("time_week_sec"),
        F.count_if(late & (F.col("session_date") <= today) & (F.col("duration_sec") > ACTIVE_SECONDS)).alias("active_days_week"),
    )
    read = F.to_date("updated_at")
    counts = progress.groupBy("user_id").agg(
        F.count_if((read == today) & (F.col("duration_sec") >= READ_SECONDS)).alias("articles_today"), F.count_if((read >= first) & (F.col("duration_sec") >= READ_SECONDS)).alias("articles_week"), F.count("*").alias("articles_total")
    )
    listed = categories(progress, articles, pillars, as_of).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pillar_id", "reads", "percent"))).alias("categories"))
    most = F.array_max(F.transform("categories", lambda c: c["reads"]))
    top = F.get(F.filter("categories", lambda c: c["reads"] == most), F.lit(0))["pillar_id"]
    out = times.join(days, "user_id").join(streaks(daily, as_of), "user_id").join(counts, "user_id", "left").join(listed, "user_id", "left")
    return out.select(
        "user_id", "time_today_sec", duration_text(F.col("time_today_sec")).alias("time_today_formatted"), "time_week_sec", duration_text(F.col("time_week_sec")).alias("time_week_formatted"), "current_streak", "longest_streak",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("articles_today", "articles_week", "articles_total")), "daily_sec", "categories", top.alias("top_category"),
        F.round(F.col("time_week_sec") / F.greatest(F.lit(1), F.col("active_days_week")) / 60, 1).alias("avg_session_minutes"), "active_days_week",
    )
