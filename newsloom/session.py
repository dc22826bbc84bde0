"""The session settings that results depend on, and those that suit large inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(name: str = "newsloom", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores where its files give fewer than half as many, as one large row group does.

    Only for tables whose rows take long to work on: a large input has splits enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    Where it is unset, a temporary folder will do for a local master, whose executors are on this machine; on a cluster that is
    an error.
    """
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return tempfile.mkdtemp(prefix="newsloom-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
