"""Operator 5: packing of token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import Cache, cut, ids_of_chunks, library_encoder, per_text
from .common import checkpoint, gather, ship_package, slices_by_bytes, text_of

MAX_TOKENS = 4096
END_ID = 2
BATCH_BYTES = 4 << 20
#: Rows of one length that a rank is counted over in one window group, on average.
RANK_ROWS = 2_000

_caches: dict[str, Cache] = {}


def cache_for(path: str) -> Cache:
    """This Python worker's cache for a tokenizer file."""
    if path not in _caches:
        _caches[path] = Cache(library_encoder(path, lower=True))
    return _caches[path]


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts (no nulls in them), and the number of ids of each. The tokenizer drops case and white space.

    Its special strings are told from others by their case, so texts that may have one keep theirs.
    """
    lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    chunks, bounds = cut(lowered, spaces_lead=False)
    if not len(chunks):
        return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
    flat, starts, lengths = ids_of_chunks(chunks, cache_for(path))
    return gather(flat, starts, lengths), per_text(bounds, lengths)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids_crc32 and, if asked for, ids.

    Each text's ids end with end_id and are cut every max_tokens; null and empty texts have that one id. Each input row is a
    document of its own. ids_crc32 is over the ids as little-endian unsigned 32-bit numbers.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", batch_bytes):
                flat, counts = encoded(part.column("text"), tokenizer_path)
                ends = np.cumsum(counts)
                rows, start, length, total, crc, kept = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(ends - counts, ends)):
                    ids = np.concatenate((flat[a:b], last))
                    for s in range(0, len(ids), max_tokens):
                        x = ids[s : s + max_tokens]
                        rows.append(i)
                        start.append(s)
                        length.append(len(x))
                        total.append(len(ids))
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            kept.append(x.view("<i4"))
                columns = [part.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc))]
                names = ["id", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, how many of it)]), by shortest-pack-first.

    Lengths go longest first into the shortest pack, which is the one with the most room, and open a new pack where even that
    has too little. Whole counts move at once, so the work depends on the lengths and not on the number of sequences.
    """
    open_packs: dict[int, list] = {}
    rooms: list[int] = []

    def add(room: int, count: int, content: tuple) -> None:
        if room not in open_packs:
            heapq.heappush(rooms, -room)
        open_packs.setdefault(room, []).append((count, content))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                each = capacity // length
                if left >= each:
                    add(capacity - each * length, left // each, ((length, each),))
                if left % each:
                    add(capacity - left % each * length, 1, ((length, left % each),))
                break
            packs = open_packs[room]
            count, content = packs.pop()
            if not packs:
                del open_packs[room]
                heapq.heappop(rooms)
            used = min(count, left)
            if used < count:
                add(room, count - used, content)
            content = (*content[:-1], (length, content[-1][1] + 1)) if content[-1][0] == length else (*content, (length, 1))
            add(room - length, used, content)
            left -= used
    return [(count, list(content)) for room in sorted(open_packs) for count, content in open_packs[room]]


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many a pack, offset), sorted: ranks of a length go to patterns in turn."""
    rows, next_rank, sequence = [], {}, 0
    for count, content in patterns:
        offset = 0
        for length, times in content:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            next_rank[length] = rank + count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked_within_length(pieces: DataFrame, largest: int) -> DataFrame:
    """pieces with rank, from 0 and gapless within each length; a length of many rows is ranked in salted groups."""
    salts = max(1, -(-largest // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .count()
        .withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    order = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    return salted.withColumn("n", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1).drop("n", "before", "salt")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Only the histogram of lengths (max_tokens rows at most) comes to the driver, and only the pattern table goes back: its
    size is bounded by the number of lengths, not by the documents. No documents give no rows. Ties in length are ordered
    by id and start; repeated rows are packed each.
    """
    pieces = checkpoint(token_pieces(docs, tokenizer_path, max_tokens, end_id, id_col, text_col, with_ids=False))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(pack_histogram(histogram, max_tokens)))
    shift = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            _, first, sequence, times, offset = table[np.searchsorted(keys, length * shift + rank, side="right") - 1].T
            at = rank - first
            columns = {c: batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence + at // times), "offset": pa.array(offset + at % times * length)})

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked_within_length(pieces, max(histogram.values(), default=1)).mapInArrow(
        place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("id", id_col)
