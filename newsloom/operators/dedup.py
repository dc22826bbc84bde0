"""Duplicates of articles: exact by title hash and address, near by word sets of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import token_set


def first_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of rows with one key the first in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def new_articles(batch: DataFrame, store: DataFrame, order: list[Column], hash_col: str = "title_hash", url_col: str = "url") -> DataFrame:
    """Rows of the batch to insert: first of each title hash, then not in the store by hash nor by address, first of each address."""
    once = first_wins(batch, hash_col, order)
    unknown = once.join(store.select(hash_col).distinct(), hash_col, "left_anti").join(store.select(url_col).distinct(), url_col, "left_anti")
    return first_wins(unknown, url_col, order).select(batch.columns)


def similar_titles(articles: DataFrame, threshold: float = 0.8, id_col: str = "id", title_col: str = "headline") -> DataFrame:
    """(a, b, similarity) of all pairs of different titles whose word sets are alike by Jaccard, by prefix filtering.

    Titles of one word set are compared once, as a class under their smallest id. Two sets as alike as asked share a word
    among the first of either in the order from rare to frequent words; only those words are joined on, so frequent words
    make no candidates. Members of a class are in `class_members`.
    """
    classes = title_classes(articles, id_col, title_col).where(F.size("tokens") > 0)
    reps = classes.groupBy("tokens").agg(F.min("id").alias("id"))
    exploded = reps.select("id", "tokens", F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count("*").alias("df"))
    ordered = exploded.join(frequency, "token").withColumn("n", F.size("tokens")).withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "token")))
    prefix = ordered.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "token", "tokens", "n")
    a, b = prefix.select("token", *(F.col(c).alias(f"a_{c}") for c in ("id", "tokens", "n"))), prefix.select("token", *(F.col(c).alias(f"b_{c}") for c in ("id", "tokens", "n")))
    met = a.join(b, "token").where((F.col("a_id") < F.col("b_id")) & (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold)).dropDuplicates(["a_id", "b_id"])
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    found = met.withColumn("similarity", both / (F.col("a_n") + F.col("b_n") - both)).where(F.col("similarity") >= threshold)
    return found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("similarity", 6).alias("similarity"))


def class_members(articles: DataFrame, id_col: str = "id", title_col: str = "headline") -> DataFrame:
    """(id, class_id, n): each title with the smallest id of its word set and how many titles have it; titles without words have no class."""
    members = title_classes(articles, id_col, title_col).where(F.size("tokens") > 0)
    return members.join(members.groupBy("tokens").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "tokens").select("id", "class_id", "n")


def title_classes(articles: DataFrame, id_col: str = "id", title_col: str = "headline") -> DataFrame:
    """(id, tokens): the sorted word set of each title."""
    return articles.select(F.col(id_col).alias("id"), F.array_sort(token_set(F.col(title_col))).alias("tokens"))
