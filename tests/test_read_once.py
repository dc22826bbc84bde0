"""What is costly to work out is worked out once for all that reads it."""

import pytest
from pyspark.sql import functions as F

from newsloom.plans import QUERIES
from newsloom.sources import adapters

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """Of a type, a function that passes values through, which no plan moves or repeats in one branch; and how many were."""
    n = spark.sparkContext.accumulator(0)

    def through(value):
        n.add(1)
        return value

    return lambda kind: F.udf(through, kind).asNondeterministic(), n


def test_texts_of_loose_notifications_are_read_once(spark, monkeypatch, counted):
    through, n = counted
    plain = adapters.table
    monkeypatch.setattr(adapters, "table", lambda spark, d, name: plain(spark, d, name).withColumn("text", through("string")("text")) if name == "documents" else plain(spark, d, name))
    rows = QUERIES["notifications_loose"](spark, DATA).count()
    assert rows > 100 and n.value == spark.read.parquet(f"{DATA}/documents.parquet").count()
