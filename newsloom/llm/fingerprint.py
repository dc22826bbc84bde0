"""Operator 9 (native): canonical exact digests of documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_of

#: Documents per block of neighbouring ids; blocks at most; sampled rows that a bound between blocks is set by.
BLOCK_ROWS, MOST_BLOCKS, ROWS_PER_BOUND = 2000, 1_000_000, 100
#: Buckets of several rows whose 8-byte keys are broadcast at most; beyond, texts are shuffled to them.
BROADCAST_BUCKETS = 1_000_000
SEED = 9


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, each stretch of white space one space, none at the ends.

    Normaliser and folding are those of ICU, which Spark ships for its collations; they are called as static methods by SQL.
    """

    def normal(x: Column) -> Column:
        return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    return F.btrim(F.regexp_replace(normal(folded), r"(?U)\s+", " "))


def hash_lanes(canon: Column) -> tuple[Column, Column]:
    """Two 64-bit lanes of XXH64: the text's hash, and its hash continued from that of another value."""
    return F.xxhash64(canon), F.xxhash64(F.lit(1), canon)


def wide_hash(canon: Column) -> Column:
    """Both lanes as 32 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(lane), 16, "0") for lane in hash_lanes(canon))))


def _place(bounds: Column) -> Column:
    """How many of the bounds (in order) are at or before the row (k, h)."""
    return F.size(F.filter(bounds, lambda b: b <= F.struct("k", "h"))).cast("long")


def _every(rows: Column, parts: int) -> Column:
    """The bounds that cut an ordered array of sampled rows into so many parts of one size."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(max(1, parts - 1))), lambda i: F.get(rows, F.floor(F.size(rows) * i / parts).cast("int"))))


def blocks_by_rank(keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """The bounds of blocks within each coarse range (coarse, bounds), those of the ranges (one row), and the blocks of a range.

    Bounds come from samples of the rows (k, h) themselves, so blocks hold about BLOCK_ROWS rows however ids are spread, and an id
    of many rows is cut by its texts' hashes. They are set in two levels: of a coarse range only a sample of a size that the
    parameters give is held at once. Both levels have about the square root of the number of blocks, so the table is bounded by
    MOST_BLOCKS.
    """
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    coarse = max(1, math.isqrt(blocks))
    fine = -(-blocks // coarse)

    def drawn(rows: DataFrame, wanted: int, seed: int) -> DataFrame:
        return rows.sample(min(1.0, wanted * ROWS_PER_BOUND / max(1, n)), seed=seed)

    ordered = F.sort_array(F.collect_list(F.struct("k", "h")))
    first = checkpoint(drawn(keys, coarse, SEED).agg(_every(ordered, coarse).alias("all_coarse")))
    placed = drawn(keys, blocks, SEED + 1).crossJoin(F.broadcast(first)).withColumn("coarse", _place(F.col("all_coarse")))
    second = placed.groupBy("coarse").agg(_every(ordered, fine).alias("bounds"))
    every = first.select(F.explode(F.sequence(F.lit(0).cast("long"), F.size("all_coarse").cast("long"))).alias("coarse"))
    none = F.array().cast("array<struct<k: bigint, h: bigint>>")
    return checkpoint(every.join(second, "coarse", "left").select("coarse", F.coalesce("bounds", none).alias("bounds"))), first, fine


def with_next_text(docs: DataFrame) -> DataFrame:
    """docs (id, text) with next_text: the text of the next row in descending order of id; after the last, the first's.

    A null id counts as the smallest. Rows of one id are ordered by a hash of the text, and of one hash by the text. Rows are
    dealt to blocks of neighbouring ids, so no task orders the whole table. The first row of each block also goes to the block
    before it, behind its last row.
    """
    keyed = docs.withColumns({"k": F.bitwise_not(F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))), "h": F.xxhash64("text")})
    keys = checkpoint(keyed.select("k", "h"))
    n = keys.count()
    bounds, first, fine = blocks_by_rank(keys, n)

    def in_blocks(rows: DataFrame) -> DataFrame:
        coarse = rows.crossJoin(F.broadcast(first)).withColumn("coarse", _place(F.col("all_coarse"))).drop("all_coarse")
        return coarse.join(F.broadcast(bounds), "coarse").withColumn("block", F.col("coarse") * (fine + 1) + _place(F.col("bounds"))).drop("bounds")

    # The first row of each block, and the block before: within a coarse range by a window, over its edge by one row of each range.
    heads = in_blocks(keys).groupBy("coarse", "block").agg(F.min(F.struct("k", "h")).alias("head"))
    heads = checkpoint(heads.withColumn("before", F.lag("block").over(Window.partitionBy("coarse").orderBy("block"))))
    last = [(r["coarse"], r["block"]) for r in heads.groupBy("coarse").agg(F.max("block").alias("block")).orderBy("coarse").collect()]
    over = docs.sparkSession.createDataFrame([(c, last[i - 1][1]) for i, (c, _) in enumerate(last)], "coarse long, edge long")
    to = heads.join(F.broadcast(over), "coarse").select("block", F.col("head.k").alias("k"), F.col("head.h").alias("h"), F.coalesce("before", "edge").alias("to"))
    dealt = in_blocks(keyed)
    # Heads are as many as blocks, which MOST_BLOCKS bounds. Rows alike in id and hash come down to the smallest text.
    extra = dealt.join(F.broadcast(to), ["block", "k", "h"]).groupBy("to").agg(F.min("text").alias("text"))
    none = [F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("h")]
    rows = dealt.select(F.lit(False).alias("extra"), F.col("block").alias("to"), "id", "k", "h", "text").unionByName(extra.select(F.lit(True).alias("extra"), "to", *none, "text"))
    order = Window.partitionBy("to").orderBy("extra", "k", "h", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).where("not extra").select("id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """text with its last third (floor, in code points) replaced by as many first ones of the following text, or all of it."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Two fingerprints are alike (1.0) if they are equal and else not (0.0). Null and empty texts are the empty text. Texts
    of equal wide hashes are compared byte by byte; in a bucket where they differ, fingerprints are lengthened by part of the
    canonical text's SHA-256, so equal fingerprints mean equal canonical texts. One document alone is its own next one.
    """
    base = with_next_text(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    base = base.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    canon = base.select("id", "text", "edited", canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("next_text")).alias("x"))
    found = checkpoint(
        canon.select(
            "id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            wide_hash(F.col("c")).alias("h"),
            hash_lanes(F.col("c"))[0].alias("bucket"),
            wide_hash(F.col("e")).alias("eh"),
            F.substring(F.sha2(F.col("c").cast("binary"), 256), 1, 16).alias("long_h"),
            F.substring(F.sha2(F.col("e").cast("binary"), 256), 1, 16).alias("long_eh"),
            (F.col("c") == F.col("e")).cast("double").alias("near_edited"),
            (F.col("c") == F.col("x")).cast("double").alias("near_next"),
        )
    )
    clashing = colliding_buckets(docs, found, text_col)
    longer = found.join(clashing.select("h", F.lit("-").alias("l")), "h", "left").join(clashing.select(F.col("h").alias("eh"), F.lit("-").alias("el")), "eh", "left")
    return longer.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.concat("h", F.coalesce(F.concat("l", "long_h"), F.lit(""))).alias("fingerprint"),
        F.concat("eh", F.coalesce(F.concat("el", "long_eh"), F.lit(""))).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def colliding_buckets(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(h) of the buckets in which texts differ: those of documents by bytes, those of edited texts by SHA-256.

    Only buckets of several rows are looked at. The smallest and the largest canonical text of a bucket are aggregated before
    they are shuffled, so a bucket that holds a third of all rows reaches one task as one row of each partition.
    """
    several = checkpoint(found.groupBy("bucket").count().where("count > 1").select("bucket"))
    if several.count() <= BROADCAST_BUCKETS:
        several = F.broadcast(several)
    texts = docs.select(canonical(text_of(text_col)).alias("c")).withColumn("bucket", hash_lanes(F.col("c"))[0])
    members = texts.join(several, "bucket", "left_semi").select(wide_hash(F.col("c")).alias("h"), "c")
    by_bytes = members.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("h")
    every = found.select("h", F.col("long_h").alias("s")).union(found.select(F.col("eh").alias("h"), F.col("long_eh").alias("s")))
    by_digest = every.groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("h")
    return checkpoint(by_bytes.union(by_digest).distinct())
