"""Heartbeats as a stream: daily activity, sessions, and each event once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def heartbeat_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def timed(beats: DataFrame, lateness: str) -> DataFrame:
    return beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def daily_activity(beats: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(user_id, session_date, duration_sec) by event time; a day's state goes once the watermark has passed it."""
    days = timed(beats, lateness).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum("duration_sec").alias("duration_sec"))
    return days.select("user_id", F.to_date("w.start").alias("session_date"), "duration_sec")


def sessions(beats: DataFrame, gap: str = "30 minutes", lateness: str = "2 days") -> DataFrame:
    """(user_id, started_at, ended_at, duration_sec, beats): runs of heartbeats without a longer gap; the end is a gap after the last one."""
    runs = timed(beats, lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.sum("duration_sec").alias("duration_sec"), F.count("*").alias("beats"))
    return runs.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "duration_sec", "beats")


def once(events: DataFrame, key: list[str], lateness: str = "2 days") -> DataFrame:
    """Each event once, if its copies come no later than the lateness after it; keys leave the state with the watermark."""
    return timed(events, lateness).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, folder: str, keys: list[str] | None = None) -> DataFrame:
    """All input that is there now, as Parquet under the folder, read again.

    With keys, each batch writes the rows that it changed, and of a key the row of its last batch counts. Without, rows are
    written once, when the watermark has passed them. A batch that is run again after a failure overwrites its own rows.
    """
    result, spark = f"{folder}/result", stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result}/batch={number}")

    query = stream.writeStream.outputMode("update" if keys else "append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.option("basePath", result).parquet(result)
    if not keys:
        return rows.drop("batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def run_every(stream: DataFrame, path: str, checkpoint: str, interval: str = "25 minutes"):
    """Closed rows appended to Parquet at an interval; the file sink commits each batch once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
