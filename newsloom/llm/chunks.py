"""Token ids of whole texts by way of their distinct chunks.

A chunk is a stretch of text that the tokenizer encodes alike wherever it stands. Each batch is cut into chunks by numpy on
the Arrow buffer, and only chunks that this Python worker has not met lately go to the tokenizer; ids of whole texts are then
gathered. The cache is bounded and only saves work: what it holds never changes a result.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, SPACE, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[[*range(9, 14), 32]] = SPACE
CLASS[48:58] = DIGIT
#: Texts in which classes of bytes don't tell all: contractions, special tokens, characters beyond ASCII that are no letters or,
#: like the dotted capital I, become a letter and a mark in lower case.
ODD = r"[^\x00-\x7f\p{L}]|\x{130}|'|<\|"


class Cache:
    """Chunk -> its ids as little-endian uint32 bytes. Emptied when full."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 300_000, longest: int = 48):
        self.encode, self.most, self.longest, self.known = encode, most, longest, {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, chunks))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            new = self.encode([chunks[i] for i in missing])
            if len(known) + len(new) > self.most:
                known.clear()
            for i, x in zip(missing, new):
                out[i] = x
                if len(chunks[i]) <= self.longest:
                    known[chunks[i]] = x
        return out


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary of a byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def library_encoder(path: str, lower: bool) -> Callable[[list[str]], list[bytes]]:
    """Chunks -> ids by the `tokenizers` library. A chunk of letters alone skips the parts of the library that would not change it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    model, letters = t.model, byte_letters()

    def plain(chunk: str) -> bool:
        word = chunk[1:] if chunk[:1] == " " else chunk
        return word.isalpha() and (not lower or (word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word))))

    def encode(chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        rest = []
        for i, c in enumerate(chunks):
            if plain(c):
                out[i] = np.array([x.id for x in model.tokenize(c.encode().decode("latin-1").translate(letters))], dtype="<u4").tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, t.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    return encode


def cut(texts: pa.Array, spaces_lead: bool) -> tuple[pa.Array, np.ndarray]:
    """The texts in chunks, and the first chunk of each text (with the number of chunks at the end).

    spaces_lead: the tokenizer keeps white space and lets a space lead the token after it; else it drops white space. In odd
    texts chunks end only at white space. Chunks follow the rule of both public vocabularies: letters, numbers and other
    characters are never in one token, and of white space the last character alone can belong to what follows.
    """
    texts = texts.cast(pa.string())
    n_texts = len(texts)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int32)[texts.offset : texts.offset + n_texts + 1].astype(np.int64)
    if not n_texts or offsets[-1] == offsets[0]:
        return pa.array([], pa.string()), np.zeros(n_texts + 1, dtype=np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    n = len(data)
    kind = CLASS[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    before_text = np.zeros(n, dtype=bool)  # white space right before something else in the same text
    before_text[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:-1]
    leads = before_text & (data == 32)
    if spaces_lead:
        start |= before_text
        start[1:] &= ~leads[:-1]
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, ODD)))
    if len(odd):
        if spaces_lead:
            only = leads.copy()
            only[:-1] &= data[1:] < 128
        else:
            only = start & ((kind == SPACE) | np.concatenate(([False], kind[:-1] == SPACE)))
        only |= first[:-1]
        for i in odd:
            start[offsets[i] : offsets[i + 1]] = only[offsets[i] : offsets[i + 1]]
    at = np.flatnonzero(start)
    chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, np.searchsorted(at, offsets)


def ids_of_chunks(chunks: pa.Array, cache: Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flat ids of the distinct chunks, and for each chunk in order its start and length in them."""
    coded = chunks.dictionary_encode()
    parts = cache.ids(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    codes = np.asarray(coded.indices)
    return np.frombuffer(b"".join(parts), dtype="<u4"), (np.cumsum(lengths) - lengths)[codes], lengths[codes]


def per_text(bounds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the chunks' lengths between neighbouring bounds."""
    total = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
