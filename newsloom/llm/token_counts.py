"""Operator 8: token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Cache, cut, ids_of_chunks, library_encoder, per_text
from .common import ship_package, slices_by_bytes, text_of

BATCH_BYTES = 4 << 20

_caches: dict[str, Cache] = {}


def cache_for(path: str) -> Cache:
    """This Python worker's cache for a tokenizer file."""
    if path not in _caches:
        _caches[path] = Cache(library_encoder(path, lower=False))
    return _caches[path]


def counts(texts: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text (no nulls in them)."""
    chunks, bounds = cut(texts, spaces_lead=True)
    if not len(chunks):
        return np.zeros(len(texts), dtype=np.int64)
    return per_text(bounds, ids_of_chunks(chunks, cache_for(path))[2])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id, n_bytes, n_tokens of every whole text, as the `tokenizers` library gives them without added special tokens.

    Null and empty texts have 0 of both. Repeated rows are counted row by row; other columns are not read. Every text is
    encoded in chunks cut where a token always ends, so a very long text needs no more memory than a batch; a stretch without
    such a place is encoded whole. tokenizer_path must exist on the executors.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", batch_bytes):
                texts = part.column("text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts(texts, tokenizer_path))], names=["id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return found.withColumnRenamed("id", id_col)
