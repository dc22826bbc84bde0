"""Operator 11: byte-level BPE of whole texts and back, by an automaton of the corpus's frequent words and exact merges of the others."""

from __future__ import annotations

import heapq
import json
import re as plain_re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_letters, cut, per_text
from .common import checkpoint, gather, publish, ship_package, slices_by_bytes, text_of
from .word_automaton import Automaton

BATCH_BYTES = 4 << 20
#: Words of the automaton at most, and the bytes of one.
LEXICON_WORDS, LEXICON_BYTES = 60_000, 32
#: Words that are not in the automaton and whose merges a worker remembers, and the bytes of one.
REMEMBERED, REMEMBERED_BYTES = 100_000, 48
#: Bytes of a word whose lowest pair is simply looked for after each merge.
SHORT = 48
# Fixed value: the pattern by which this kind of vocabulary cuts texts before merging.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Merges and bytes of a byte-level vocabulary file, and the special strings that are one id each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, bytes_of = spec["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        self.first = [ids[c] for _, c in sorted(byte_letters().items())]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(made)}
        self.made = [c for *_, c in made]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = plain_re.compile("|".join(f"({plain_re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word = regex.compile(WORD)
        shown = {i: bytes(bytes_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [shown.get(i, b"") for i in range(max(shown) + 1)]
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: of all neighbours the pair of the lowest rank is merged, the leftmost first, until none can be."""
        ids = [self.first[b] for b in word]
        if len(ids) > SHORT:
            return self._merged_by_queue(ids)
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            ids[at] = self.made[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
        return ids

    def _merged_by_queue(self, ids: list) -> list[int]:
        """The same in n log n steps: pairs wait by rank and place, and one that a merge has changed meanwhile is passed over."""
        n, rank = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, k) for k in range(n - 1) if (r := rank((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, k = heapq.heappop(waiting)
            if ids[k] is None or (right := after[k]) >= n or rank((ids[k], ids[right])) != r:
                continue
            ids[k], ids[right], after[k] = self.made[r], None, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(waiting, (r, k))
            if before[k] >= 0 and (r := rank((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(waiting, (r, before[k]))
        return [i for i in ids if i is not None]

    def encoded(self, chunk: str) -> bytes:
        """The ids of a stretch of text that begins and ends where words do, as little-endian uint32."""
        out: list[int] = []
        for part in self.marks.split(chunk) if self.marks else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.word.findall(part):
                    out += self.merged(word.encode())
        return struct.pack(f"<{len(out)}I", *out)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after another. Ids beyond the vocabulary have none."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        return gather(self.bytes, self.starts[ids], self.lengths[ids])

    def texts(self, ids: pa.Array) -> pa.Array:
        """The texts of ids (binary: little-endian uint32): their bytes as UTF-8, what is none becomes U+FFFD; null ids are an empty text."""
        return pa.array([self.decoded(np.frombuffer(x.as_buffer() or b"", dtype="<u4")).tobytes().decode("utf-8", "replace") for x in ids], pa.string())


@cache
def vocabulary(path: str) -> Vocabulary:
    """This process's vocabulary of a file."""
    return Vocabulary(path)


class Encoder:
    """Texts -> ids in one worker: distinct words through the automaton, those it lacks by exact merges, lately merged ones remembered."""

    def __init__(self, path: str, automaton: Automaton | None):
        self.vocabulary, self.automaton, self.known, self.looked_up, self.merged = vocabulary(path), automaton, {}, 0, 0

    def _merged(self, word: str) -> bytes:
        if (ids := self.known.get(word)) is None:
            ids = self.vocabulary.encoded(word)
            if len(word) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has (no nulls among them)."""
        words, bounds = cut(texts, spaces_lead=True)
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        numbers = self.automaton.numbers(distinct) if self.automaton else np.full(len(distinct), -1)
        flat, lengths = self.automaton.ids(numbers[numbers >= 0]) if self.automaton else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        rest = np.flatnonzero(numbers < 0)
        others = [self._merged(w) for w in distinct.take(pa.array(rest)).to_pylist()]
        self.looked_up, self.merged = self.looked_up + len(distinct) - len(rest), self.merged + len(rest)
        n = np.empty(len(distinct), dtype=np.int64)
        n[numbers >= 0] = lengths
        n[rest] = np.fromiter(map(len, others), dtype=np.int64, count=len(others)) // 4
        order = np.concatenate((np.flatnonzero(numbers >= 0), rest))  # of the distinct words in `both`
        both = np.concatenate((flat, np.frombuffer(b"".join(others), dtype=np.uint32)))
        starts = np.empty(len(distinct), dtype=np.int64)
        starts[order] = np.cumsum(n[order]) - n[order]
        codes = np.asarray(coded.indices)
        return gather(both, starts[codes], n[codes]), per_text(bounds, n[codes])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                coded = cut(part.column("text"), spaces_lead=True)[0].dictionary_encode()
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)))], names=["word", "n"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> Automaton:
    """The automaton of the most frequent words of all texts, at most `most` of at most LEXICON_BYTES bytes.

    Counts are cut at the level above which there are no more than `most` words, told by a histogram of the counts' sizes; words
    of one level are in it together or not at all. To the driver come the histogram and these words with their ids.
    """
    ship_package(docs.sparkSession)
    level = F.floor(F.log2("n") * 16).cast("int").alias("level")
    counts = checkpoint(word_counts(docs, text_col).where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)).select("word", level))
    bar, kept = 0, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        if (kept := kept + r["count"]) > most:
            bar = r["level"] + 1
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array([known.encoded(w) for w in words.to_pylist()], pa.binary())], names=["word", "ids"])

    found = counts.where(F.col("level") >= bar).select("word").mapInArrow(run, "word string, ids binary").collect()
    return Automaton.compiled((r["word"].encode(), bytes(r["ids"])) for r in found)


def encode(
    docs: DataFrame, tokenizer_path: str, automaton: Automaton | None = None, decoded: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """id, n_tokens, ids (binary: little-endian uint32) of every whole text, as the `tokenizers` library gives them without added tokens.

    Null and empty texts have no ids; rows of one id and repeated rows are encoded row by row; other columns are not read. Words that
    the automaton holds get their ids from it, all others by merging, so it decides on the work and on no id. Without one it
    is compiled from the texts' own frequent words. It lies in the checkpoint folder, from where each executor, also one that
    comes in for a lost one, gets its copy to map. With `decoded` a column of that name has what decode() makes of the ids, without
    another worker for it. tokenizer_path must exist on the executors.
    """
    spark = docs.sparkSession
    ship_package(spark)
    name = publish(spark, "lexicon", (automaton or lexicon(docs, tokenizer_path, text_col=text_col)).to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, Automaton.mapped(SparkFiles.get(name)))
        for batch in batches:
            for part in slices_by_bytes(batch, "text", batch_bytes):
                flat, n = encoder.encode(part.column("text"))
                ends = np.concatenate(([0], np.cumsum(n))) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
                more = {decoded: encoder.vocabulary.texts(ids)} if decoded else {}
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n_tokens": pa.array(n), "ids": ids} | more)

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + (f", `{decoded}` string" if decoded else ""))
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", to: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """encoded with the text of its ids in place of them: the bytes of all ids, special ones too, read as UTF-8.

    Null ids give an empty text. Bytes that are no UTF-8, as a cut through a character leaves, become U+FFFD; ids beyond the
    vocabulary have no bytes. All other columns are handed on.
    """
    ship_package(encoded.sparkSession)
    others = [c for c in encoded.columns if c != ids_col]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others), f"`{to}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            for part in slices_by_bytes(batch, ids_col, batch_bytes):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), known.texts(part.column(ids_col))], names=[*others, to])

    return encoded.mapInArrow(run, schema)
