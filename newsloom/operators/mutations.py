"""Changes to tables as new tables: Parquet is not updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import first_wins


def insert_if_absent(store: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows whose key the store doesn't have, the first of each key."""
    return first_wins(rows.join(store.select(key).distinct(), key, "left_anti"), key, order)


def patched(store: DataFrame, patch: DataFrame, key: str, columns: list[str], skip_empty: bool = False) -> DataFrame:
    """store with the patch's values in those columns; a null (or, if asked, an empty one) changes nothing."""
    new = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = store.join(new, key, "left")
    for c in columns:
        value = F.col(f"__{c}")
        joined = joined.withColumn(c, F.coalesce(F.when(value != "", value) if skip_empty else value, F.col(c)))
    return joined.select(store.columns)


def without(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return store.join(keys.select(on).distinct(), on, "left_anti")


def replaced_set(store: DataFrame, rows: DataFrame, owner: str, unique: list[str]) -> DataFrame:
    """store with all rows of the owners in `rows` replaced by `rows`, each unique key once."""
    return without(store, rows, [owner]).unionByName(rows.dropDuplicates(unique))


def upserted_sum(store: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums by key over what is stored and what comes."""
    return store.select(*keys, value).unionByName(rows.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def replaced_by_key(store: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """store with a row for each key of `rows`, in place of the one it has: of several with one key the last in the order.

    Rows of one key come down to one in each task before they are shuffled.
    """
    values = [c for c in store.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__row")).select(*keys, "__row.*")
    return without(store, last, keys).unionByName(last)


def backfilled(store: DataFrame, column: str, value: Column) -> DataFrame:
    """store with the value where the column is null or empty."""
    missing = F.col(column).isNull() | (F.col(column) == "")
    return store.withColumn(column, F.when(missing, value).otherwise(F.col(column)))


def evolved(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Both tables in one, with defaults in columns that one of them lacks."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.fillna({c: v for c, v in defaults.items() if c in both.columns})


def swap(spark, df: DataFrame, path: str, version: int) -> str:
    """Writes df as a new version beside the older ones and returns its path; readers change over when they are told it."""
    out = f"{path}/v={version}"
    df.write.mode("overwrite").parquet(out)
    return out
