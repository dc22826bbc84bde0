"""Operator 10: near duplicates by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, ship_package, slices_by_bytes, text_of
from .components import connected_components
from .embedding_dedup import _forest

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BATCH_BYTES = 4 << 20
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str, words_each: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every shingle, repeats included. Words are between ASCII white space; A-Z count as lower case."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :])]


def majority(hashes: list[int]) -> int:
    """Signed 64-bit number whose bits are those set in over half of the hashes; 0 for none."""
    if not hashes:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    numbers = np.array(hashes, dtype=np.uint64).astype("<u8")
    for i in range(0, len(numbers), BLOCK):
        part = numbers[i : i + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(numbers), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp (long) of every row. A text of fewer words than a shingle is one shingle; without words, fp is 0."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                found = [majority(shingle_hashes(t, words_each)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _key(tag: int, segment: Column, detail: Column, exact: Column) -> Column:
    """tag, the 32 bits of a segment with or without a wildcard, 6 bits of detail and 16 exact bits, in one number."""
    return F.shiftleft(segment.cast("long"), 28).bitwiseOR(F.shiftleft(detail.cast("long"), 20)).bitwiseOR(F.shiftleft(exact.cast("long"), 3)).bitwiseOR(F.lit(tag))


def signatures(found: DataFrame) -> DataFrame:
    """(key, side, fp): two fingerprints that differ in one or two bits share a key on different sides.

    A fingerprint is cut into two segments of 32 bits, fewer than the three that would leave one exact, so of two
    fingerprints with two differing bits a segment differs by one bit at most. Index entries are segments with one bit
    deleted; a key also holds an exact 16-bit half of what remains, so buckets stay small when many fingerprints agree in a
    whole segment. With (a, b) the differing bits in the first and second segment:
    - one bit deleted from the first, an exact half of the second: a = 1, b <= 1
    - a segment exact and an exact half of the other: b (or a) >= 1 bits that all lie in the other half
    - a segment exact and one bit deleted from the first half of the other: one bit in each of its halves
    The two texts of a link differ in the deleted bit, so entries with it set only need to meet those without.
    """
    bits32 = F.lit(0xFFFFFFFF).cast("long")
    low = F.col("fp").bitwiseAND(bits32)
    high = F.shiftrightunsigned("fp", 32).bitwiseAND(bits32)

    def half(segment: Column, which: int) -> Column:
        return F.shiftrightunsigned(segment, 16 * which).bitwiseAND(F.lit(0xFFFF).cast("long"))

    def without(value: Column, at: Column) -> Column:
        return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), at)))

    def bit(value: Column, at: Column) -> Column:
        return F.call_function("shiftrightunsigned", value, at).bitwiseAND(F.lit(1).cast("long")).cast("int")

    def entry(tag: int, segment: Column, detail: Column, exact: Column, side: Column) -> Column:
        return F.struct(_key(tag, segment, detail, exact).alias("key"), side.alias("side"))

    def one_from_first(exact: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda p: entry(exact, without(high, p), p, half(low, exact), bit(high, p)))

    def other_half(tag: int, same: Column, other: Column, exact: int, side: int) -> Column:
        return entry(tag, same, F.lit(exact), half(other, exact), F.lit(side))

    def one_in_each(tag: int, same: Column, other: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: entry(tag, same, p, without(half(other, 0), p), bit(other, p)))

    lists = [one_from_first(0), one_from_first(1)]
    for at, (same, other) in enumerate(((high, low), (low, high))):
        lists += [F.array(*[other_half(2 + at, same, other, exact, side) for exact in (0, 1) for side in (0, 1)]), one_in_each(4 + at, same, other)]
    return found.select("fp", F.explode(F.concat(*lists)).alias("e")).select("e.key", "e.side", "fp")


def near_links(found: DataFrame) -> DataFrame:
    """All pairs (u > v) of distinct fingerprints in `found` (fp, each once) that differ in one or two bits."""
    # One row becomes a hundred: dealt out first, so that few small partitions don't make few large tasks. Another hash than the
    # aggregation's is needed for that, or the planner takes the rows to lie right already.
    index = signatures(found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp", F.lit(SEED))))
    left = index.where("side = 0").select("key", F.col("fp").alias("a"))
    right = index.where("side = 1").select("key", F.col("fp").alias("b"))
    # A hundred times as large as the fingerprints, by whose size it would be broadcast.
    close = left.hint("merge").join(right, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    return close.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS) -> DataFrame:
    """id, fp, component (the smallest id reachable over links, its own included) of every row.

    Rows of equal fingerprints form one class, so a group of copies of any size is one vertex. Null and empty texts have
    fingerprint 0 and link like any other. A null id never names a component unless no other id is in it.
    """
    found = checkpoint(fingerprints(docs, id_col, text_col, words_each))
    classes = found.groupBy("fp").agg(F.min("id").alias("first"))
    linked = connected_components(near_links(classes.select("fp")))
    rooted = classes.join(linked.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return found.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


# Near copies by similarity: SimHash fingerprints within two bits and MinHash keys of the shingles find candidates, shingles decide.

COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Smallest hashes that one key is made of, and how many of the pairs at the very similarity asked for are to share a key.
KEY_HASHES, TARGET = 5, 0.9995
#: Members of a bucket up to which all its pairs become rows. Of a larger one each member first meets so many of the others.
PAIRED, REPRESENTATIVES = 16, 2
#: Members and shingles of a block; what a larger bucket has not linked is compared block by block.
BLOCK_ROWS, BLOCK_SHINGLES, BLOCK_CODES = 512, 1 << 19, 4096
BROADCAST_IDS = 1_000_000


def keys_for(similarity: float) -> int:
    """How many keys meet the target: two texts share one with the similarity to the power of KEY_HASHES, whatever the kind of edit."""
    found = min(1 - 1e-9, max(0.05, similarity) ** KEY_HASHES)
    return math.ceil(math.log(1 - TARGET) / math.log(1 - found))


def distinct_shingles(text: str, words_each: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words_each), dtype=np.uint64))


def copy_profiles(docs: DataFrame, n_keys: int, words_each: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, exact (128 bits of hash of the words), fp (SimHash), size (distinct shingles), keys array<long> (none without words), of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        rng = np.random.default_rng(SEED)
        n = n_keys * KEY_HASHES
        flips, factors, mixed, marks = (rng.integers(0, 1 << 64, size=k, dtype=np.uint64) for k in (n, n, n, n_keys))
        factors, mixed = factors | np.uint64(1), mixed | np.uint64(1)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                exact, fp, size, found = [], [], [], []
                for text in part.column("text").to_pylist():
                    fp.append(majority(shingle_hashes(text)))
                    exact.append(xxh3_128_digest(b" ".join(text.encode("utf-8", "replace").lower().split())))
                    own = distinct_shingles(text, words_each)
                    size.append(len(own))
                    if not len(own):
                        found.append([])
                        continue
                    least = np.full(n, (1 << 64) - 1, dtype=np.uint64)
                    for i in range(0, len(own), 4096):
                        np.minimum(least, ((own[i : i + 4096, None] ^ flips) * factors).min(axis=0), out=least)
                    least = (least ^ (least >> np.uint64(32))) * mixed
                    found.append(((least ^ (least >> np.uint64(29))).reshape(n_keys, KEY_HASHES).sum(axis=1, dtype=np.uint64) ^ marks).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(exact, pa.binary()), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["id", "text_hash", "exact", "fp", "size", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, exact binary, fp long, size int, keys array<long>")


def shingle_sets(texts: DataFrame, words_each: int) -> DataFrame:
    """id and all distinct shingle hashes, of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                found = [distinct_shingles(t, words_each).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, shingles array<long>")


def with_simhash_key(classes: DataFrame) -> DataFrame:
    """classes (fp, keys, ...) with one more key: the group of fingerprints, linked as near_duplicates() links them, that each one's is in.

    So what SimHash finds meets in a bucket like any other, and all its pairs are held against the shingles. Classes without words have no keys.
    """
    groups = connected_components(near_links(classes.where(F.size("keys") > 0).select("fp").distinct())).withColumnRenamed("u", "fp")
    key = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    met = classes.join(groups, "fp", "left")
    return met.withColumn("keys", F.when(F.size("keys") > 0, F.concat("keys", F.array(key))).otherwise(F.col("keys"))).drop("fp", "root")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, id, size, n, b0, ...): each class (id, size, keys) with each key that others have too, how many have it, and its representatives."""
    dealt = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    index = dealt.select("id", "size", F.explode("keys").alias("key")).repartition("key")
    drawn = [F.min_by(F.struct("id", "size"), F.xxhash64("id", F.lit(r))).alias(f"b{r}") for r in range(REPRESENTATIVES)]
    return index.join(index.groupBy("key").agg(F.count("*").alias("n"), *drawn).where("n > 1"), "key")


def candidate_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of small buckets, and members of large ones with their representatives, if sizes allow the similarity.

    The rows are in proportion to the members of buckets of any size. The other pairs of large buckets are for cross_links.
    """
    small = met.where(F.col("n") <= PAIRED).select("key", "id", "size")
    pairs = small.select("key", F.struct("id", "size").alias("x")).join(small.select("key", F.struct("id", "size").alias("y")), "key").where("x.id > y.id").select("x", "y")
    drawn = F.explode(F.array_distinct(F.array(*[f"b{r}" for r in range(REPRESENTATIVES)])))
    stars = met.where(F.col("n") > PAIRED).select(F.struct("id", "size").alias("x"), drawn.alias("y")).where("x.id <> y.id")
    fits = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity
    return pairs.union(stars).where(fits).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the left sets shares with each of the right ones."""
    flat = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)))
    if not len(both):
        return out
    parts = []
    for values, row in zip(flat, rows):
        code = np.minimum(np.searchsorted(both, values), len(both) - 1)
        own = both[code] == values
        order = np.argsort(code[own], kind="stable")
        parts.append((code[own][order], row[own][order]))
    for start in range(0, len(both), BLOCK_CODES):
        tables = []
        for (code, row), n in zip(parts, out.shape):
            i, j = np.searchsorted(code, (start, start + BLOCK_CODES))
            table = np.zeros((n, BLOCK_CODES), dtype=np.float32)
            table[row[i:j], code[i:j] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def cross_links(met: DataFrame, rooted: DataFrame, keys: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect what the pairs of large buckets link whose ends are in different components so far.

    Buckets within one component have nothing to add. The others are cut into blocks, and every block meets every block of its
    bucket in a group of its own. A pair is compared in the first bucket that it shares. Of a group's links a forest is returned.
    """
    large = met.where(F.col("n") > PAIRED).select("key", "id", "size").join(rooted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("total")).where("lo <> hi")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = large.join(whole.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root").join(keys, "id").join(sets, "id")
    kind = met.schema["id"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, own = table.column("block").to_numpy(), np.array(table.column("keys").to_pylist(), dtype=np.int64)
        i, j, key = (table.column(c)[0].as_py() for c in ("i", "j", "key"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        listed = table.column("shingles").combine_chunks()
        ends, values = listed.offsets.to_numpy(), listed.values.to_numpy()
        size = np.diff(ends)
        todo = root[left][:, None] != root[right][None, :]
        todo &= np.minimum(size[left][:, None], size[right]) >= np.maximum(size[left][:, None], size[right]) * similarity
        for k in range(int(np.flatnonzero(own[0] == key)[0])):
            todo &= own[left, k][:, None] != own[right, k]
        todo = todo[np.ix_(x := todo.any(axis=1), y := todo.any(axis=0))]
        left, right = left[x], right[y]
        a = b = np.zeros(0, dtype=np.int64)
        if len(left):
            shared = common_counts(*([values[ends[k] : ends[k + 1]] for k in side] for side in (left, right)))
            p, q = np.nonzero(todo & (shared >= (size[left][:, None] + size[right] - shared) * similarity))
            a, b = _forest(left[p], right[q]).T
        ids = table.column("id").combine_chunks()
        return pa.table({"u": ids.take(pa.array(a, pa.int64())), "v": ids.take(pa.array(b, pa.int64()))})

    return placed.groupBy("key", "i", "j").applyInArrow(compare, f"u {kind}, v {kind}")


def kept_of_each(docs: DataFrame, id_col: str, text_col: str, words_each: int, similarity: float) -> DataFrame:
    """id, text_hash and kept (no_id, id, text_hash) of every row: kept is the first row, by id, of all that links reach.

    Rows without an id come after all others. Rows of one id are told apart by their texts.
    """
    ship_package(docs.sparkSession)
    found = checkpoint(copy_profiles(docs, keys_for(similarity), words_each, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    kinds = checkpoint(found.groupBy("exact").agg(first.alias("first"), *(F.first(c).alias(c) for c in ("fp", "size", "keys"))))
    classes = checkpoint(with_simhash_key(kinds).withColumn("class", F.monotonically_increasing_id()))
    met = checkpoint(shared_buckets(classes.select(F.col("class").alias("id"), "size", "keys")))
    pairs = candidate_pairs(met, similarity)
    wanted = checkpoint(met.select(F.col("id").alias("class")).distinct().join(classes.select("class", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "class"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).select(F.col("class").alias("id"), "text")
    n, distinct = found.agg(F.count("*"), F.count_distinct(F.struct("id", "text_hash"))).first()
    if n != distinct:  # repeated rows: one of each
        texts = texts.dropDuplicates(["id"])
    sets = checkpoint(shingle_sets(texts, words_each))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = both.where(shared >= (F.size("x") + F.size("y") - shared) * similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected_components(links).withColumnRenamed("u", "id")
    more = checkpoint(cross_links(met, roots, classes.select(F.col("class").alias("id"), "keys"), sets, similarity))
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).union(more)).withColumnRenamed("u", "id")
    rooted = classes.select("exact", "class", "first").join(roots.withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("kept")), "root").select("exact", "kept")
    return found.select("id", "text_hash", "exact").join(named, "exact").select("id", "text_hash", "kept")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """id and component (the smallest id reachable over links, its own included) of every row.

    Two texts link if the Jaccard similarity of their word shingles, counted over all of them, is as high as asked. Texts of
    the same words in a row (without regard to case and white space) are one class from the start. Candidates are in one group of
    SimHash fingerprints or share a MinHash key of their shingles. Null and empty texts are one class. Rows of one id are compared each. A component is null where no
    row in it has an id. No documents give no rows.
    """
    return kept_of_each(docs, id_col, text_col, words_each, similarity).select(F.col("id").alias(id_col), F.col("kept.id").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, rows without an id last.

    Rows go one by one and not by their id: of rows of one id with different texts each stays or goes by its own text, and of
    rows with the same id and text one stays. Null and empty texts are copies of each other.
    """
    found = checkpoint(kept_of_each(docs, id_col, text_col, words_each, similarity))
    first = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    own = free_name("text_hash", docs.columns)
    hashed = docs.withColumn(own, F.xxhash64(text_of(text_col)))

    def beside(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = others.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
        return rows.join(others, rows[id_col].eqNullSafe(others["__id"]) & (rows[own] == others["__hash"]), how)

    kept = beside(hashed, found.where(~first).select("id", "text_hash").distinct(), "left_anti")
    repeated = checkpoint(found.where(first).groupBy("id", "text_hash").count().where("count > 1"))
    if not repeated.isEmpty():
        kept = beside(kept, repeated, "left_anti").union(beside(kept, repeated, "left_semi").dropDuplicates([id_col, own]))
    return kept.drop(own)
