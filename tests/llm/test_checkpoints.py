import time

from pyspark.sql import functions as F

from newsloom.llm.common import checkpoint
from newsloom.llm.components import connected_components

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def left_behind(spark, before: set[str]) -> set[str]:
    """Shuffle files that are there beyond those of before; they are removed in the background."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = checkpoint(df)
    assert not left_behind(spark, before)
    assert spark.conf.get(CLEANUP, None) == setting
    assert {r["k"]: r["n"] for r in kept.collect()} == {r["k"]: r["n"] for r in df.collect()} == {r["k"]: r["n"] for r in checkpoint(df).collect()}


def test_components_leave_no_shuffle_files(spark):
    links = spark.range(1, 400).where("id % 50 <> 0").select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    before = shuffle_files(spark)
    roots = connected_components(links)
    assert not left_behind(spark, before)
    assert all(r["root"] == r["u"] // 50 * 50 for r in roots.collect()) and roots.count() == 392
