"""Many words searched in many texts at once: an equality join on short stretches of characters, verified on the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the stretch that a word is found by (all of a shorter word), and of the pieces that texts are cut in.
GRAM, PIECE = 4, 256


def _grams(text: Column, size: Column) -> Column:
    """The distinct stretches of so many characters; none of a shorter text."""
    count = F.char_length(text) - size + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda at: F.substring(text, at, size)))).otherwise(F.array().cast("array<string>"))


def anchored(words: DataFrame, word: str) -> DataFrame:
    """(word, size, gram) of every distinct word: of its stretches of `size` characters the one that fewest words have, then the first."""
    known = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct().withColumn("size", F.least(F.char_length("word"), F.lit(GRAM)))
    each = known.select("word", "size", F.explode(_grams(F.col("word"), F.col("size"))).alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("n"))
    return each.join(shared, "gram").groupBy("word", "size").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def found_in(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """texts with each of the words that stands in the text, also within or across other words, as a column of the word's name.

    As contains() says, for all pairs at once, without looking at a pair that shares no stretch: texts are cut in overlapping
    pieces, the pieces' stretches join the words' own ones by equality, and what meets is verified. Null texts and null or empty words
    are in no pair; words given twice count once, and so do rows of texts that are alike
    in all columns. How the join runs is Spark's choice by the size of the words.
    """
    anchors = anchored(words, word)
    known = anchors.agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.max(F.char_length("word")).alias("longest")).first()  # sizes: GRAM at most
    sizes, longest = known["sizes"], known["longest"]
    if not sizes:
        return texts.withColumn(word, F.lit(None).cast("string")).limit(0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("__text"), F.lit(1)), F.lit(PIECE)))
    whole = texts.withColumn("__text", F.col(text))
    pieces = whole.where(F.col("__text").isNotNull()).withColumn("__at", start).withColumn("__piece", F.substring("__text", F.col("__at"), F.lit(PIECE + longest - 1))).drop("__text", "__at")
    grams = F.array_distinct(F.concat(*[_grams(F.col("__piece"), F.lit(s)) for s in sizes]))
    met = pieces.withColumn("__gram", F.explode(grams)).join(anchors.select(F.col("word").alias(word), F.col("gram").alias("__gram")), "__gram")
    return met.where(F.contains(F.col("__piece"), F.col(word))).drop("__gram", "__piece").dropDuplicates()
