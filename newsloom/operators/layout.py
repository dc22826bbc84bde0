"""Stored tables laid out by the key they are joined and looked up by, in place of indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bucket should hold, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 4096
#: A bucket this many times as large as the mean is too large to be one task's.
HOT = 4.0
#: Files that a hot key's rows of one bucket are dealt over.
SPLITS = 8


@dataclass(frozen=True)
class Layout:
    """Columns that rows are put in buckets by, those they are sorted by in a bucket, and those with Bloom filters."""

    by: tuple[str, ...]
    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()


#: By what the stored tables are found.
LAYOUTS = {
    "articles": Layout(("id",), ("id",), ("title_hash", "url")),
    "bookmarks": Layout(("article_id",), ("article_id", "user_id")),
    "feeds": Layout(("article_id",), ("article_id", "user_id")),
    "reading_progress": Layout(("article_id",), ("article_id", "user_id")),
    "user_preferences": Layout(("user_id",), ("user_id", "topic_name")),
}


def rows_by_bucket(df: DataFrame, layout: Layout) -> list[int]:
    """Rows of each of MOST_BUCKETS buckets, in one pass; those of fewer buckets are sums of these."""
    sizes = df.groupBy(F.pmod(F.hash(*layout.by), F.lit(MOST_BUCKETS)).alias("__bucket")).agg(F.count("*").alias("__n"))
    out = [0] * MOST_BUCKETS
    for r in sizes.collect():  # MOST_BUCKETS rows at most
        out[r["__bucket"]] = r["__n"]
    return out


def buckets_for(rows: int) -> int:
    """A power of two, so that tables of different sizes still have buckets that fit each other."""
    buckets = 1
    while buckets < MOST_BUCKETS and rows > buckets * BUCKET_ROWS:
        buckets *= 2
    return buckets


class ClusteredTable:
    """A table in buckets of its key, sorted in each, under a folder that all executors see.

    Two such tables with equal numbers of buckets meet without a shuffle; a condition on the key opens one bucket, and in it the
    row groups whose range or Bloom filter allows the value. Nulls in the key are a bucket's rows like others.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, layout: Layout):
        self.spark, self.name, self.path, self.layout = spark, name, path, layout

    def write(self, df: DataFrame, buckets: int, sizes: list[int] | None = None) -> ClusteredTable:
        """df in so many buckets (a power of two), each written by one task; a hot one by several, told by the rows of each bucket."""
        sizes = sizes or rows_by_bucket(df, self.layout)
        rows = [sum(sizes[b::buckets]) for b in range(buckets)]
        hot = [b for b, n in enumerate(rows) if buckets > 1 and n > HOT * sum(rows) / buckets]  # fewer than buckets / HOT
        bucket = F.pmod(F.hash(*self.layout.by), F.lit(buckets))
        rest = [c for c in df.columns if c not in self.layout.by]
        salt = F.when(bucket.isin(hot), F.pmod(F.xxhash64(*rest), F.lit(SPLITS))).otherwise(F.lit(0)) if hot and rest else F.lit(0)
        out = df.repartition(buckets + SPLITS * len(hot), bucket, salt).write.format("parquet").mode("overwrite").option("path", self.path).bucketBy(buckets, *self.layout.by)
        if self.layout.sort:
            out = out.sortBy(*self.layout.sort)
        for c in self.layout.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.saveAsTable(self.name)
        return self

    def _files(self) -> DataFrame:
        return self.spark.read.schema(self.spark.table(self.name).schema).parquet(self.path)

    def bucket_rows(self) -> list[int]:
        """Rows of each bucket that has any, from the files' footers: a number for each bucket comes to the driver."""
        number = F.regexp_extract("_metadata.file_name", r"_(\d+)(?:\.c\d+)?\.", 1)
        return [r["n"] for r in self._files().groupBy(number.alias("bucket")).agg(F.count("*").alias("n")).collect()]

    def hot(self) -> bool:
        rows = self.bucket_rows()
        return bool(rows) and max(rows) > HOT * sum(rows) / len(rows)

    def lookup(self, **values: object) -> DataFrame:
        """The rows with these values; one bucket is opened if they are those of the key."""
        found = self.spark.table(self.name)
        for c, v in values.items():
            found = found.where(F.col(c) == v)
        return found

    def read(self) -> DataFrame:
        """The table in its buckets; where one is hot, by its files, so that the join shuffles and AQE splits the key."""
        return self._files() if self.hot() else self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def stored_together(spark: SparkSession, folder: str, tables: dict[str, DataFrame], prefix: str) -> dict[str, ClusteredTable]:
    """Stored tables by name, each in its layout and all with as many buckets as the largest needs, so that they meet without a shuffle."""
    sizes = {name: rows_by_bucket(df, LAYOUTS[name]) for name, df in tables.items()}
    buckets = buckets_for(max(map(sum, sizes.values())))
    return {name: ClusteredTable(spark, f"{prefix}_{name}", f"{folder}/{name}", LAYOUTS[name]).write(df, buckets, sizes[name]) for name, df in tables.items()}
