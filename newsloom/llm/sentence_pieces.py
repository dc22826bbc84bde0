"""Operator 2: SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Cache, ids_of_chunks, per_text
from .common import gather, ship_package, slices_by_bytes, text_of

BATCH_BYTES = 4 << 20
#: Characters that the streaming search takes in at once, and those from which on pairs to merge are kept in a queue.
STEP, QUEUED = 256, 64
SPACE = "▁"
NORMAL, BYTE = 1, 6


class PieceModel:
    """The pieces of a BPE model with byte fallback, dummy prefix and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation are supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        # Neighbouring ASCII characters (a space for U+2581) that stand side by side in no piece: no merge joins them.
        self.apart = np.ones((128, 128), dtype=bool)
        for p in self.ids:
            codes = [32 if c == SPACE else ord(c) for c in p]
            for a, b in zip(codes, codes[1:]):
                if max(a, b) < 128:
                    self.apart[a, b] = False
        self.whole: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        # What each id decodes to, as one byte array with starts and lengths.
        of_id = [b""] * len(model.pieces)
        for p, i in self.ids.items():
            of_id[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            of_id[i] = bytes([b])
        self.lengths = np.array([len(x) for x in of_id], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(of_id), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """Pieces of a text by merging: the best pair first, of equal ones the leftmost. Long texts keep their pairs in a queue."""
        if len(text) > QUEUED:
            return self._merged_by_queue(text)
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_by_queue(self, text: str) -> list[str]:
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in parts if p is not None]

    def follows(self, before: str, piece: str) -> bool:
        """Whether the two pieces stand side by side in the encoding of their concatenation."""
        known = self.fits.get((before, piece))
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[before, piece] = self.merged(before + piece) == [before, piece]
        return known

    def reachable(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(self.merged(piece)) == 1
        return known

    def id_list(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]


class StreamingViterbi:
    """Encodes characters as they come and hands out ids as soon as they are certain.

    A path is a series of pieces of which each may follow the one before; a merge-built encoding is the one such path of a
    text, and every prefix has one of its own. Each position keeps the last piece of its prefix as backpointer. A later piece
    can start at one of the last `longest` positions only, so once their paths meet in one boundary, all before it is final:
    it is committed and leaves the window.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.text, self.last, self.before, self.reached = "", [""], None, 0

    def _extend(self, final: bool) -> None:
        """Opens all pieces that start at a position whose own prefix is settled and that lie in the window."""
        m, text, last = self.model, self.text, self.last
        last += [None] * (len(text) + 1 - len(last))
        n = len(text)
        for j in range(self.reached, n if final else max(self.reached, n - m.longest)):
            before = last[j]
            if before is None:
                continue
            if not j:
                before = self.before
            if text[j] not in m.ids:
                last[j + 1] = text[j]  # an unknown character: bytes, never merged
                continue
            for i in range(j + 1, min(n, j + m.longest) + 1):
                piece = text[j:i]
                if piece not in m.prefixes:
                    break
                if last[i] is None and piece in m.ids and m.reachable(piece) and (before is None or before not in m.ids or m.follows(before, piece)):
                    last[i] = piece
        self.reached = n if final else max(self.reached, n - m.longest)

    def _path(self, end: int, start: int = 0) -> list[str]:
        out = []
        while end > start:
            out.append(self.last[end])
            end -= len(self.last[end])
        return out[::-1]

    def push(self, text: str) -> list[int]:
        """Ids that are certain now."""
        self.text += text
        self._extend(final=False)
        live = {i for i in range(max(0, self.reached - self.model.longest), min(len(self.text), self.reached + self.model.longest) + 1) if self.last[i] is not None}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            if top:
                live.add(top - len(self.last[top]))
        boundary = live.pop() if live else 0
        if not boundary:
            return []
        path = self._path(boundary)
        self.before = path[-1]
        self.text, self.last, self.reached = self.text[boundary:], ["", *self.last[boundary + 1 :]], self.reached - boundary
        return [i for p in path for i in self.model.id_list(p)]

    def finish(self) -> list[int]:
        """The remaining ids. ValueError if ties between equal scores leave no path."""
        self._extend(final=True)
        if self.text and self.last[-1] is None:
            raise ValueError("no path")
        out = [i for p in self._path(len(self.text)) for i in self.model.id_list(p)]
        self.__init__(self.model)
        return out


_models: dict[str, tuple[PieceModel, Cache]] = {}


def model_for(path: str) -> tuple[PieceModel, Cache]:
    """This Python worker's model and cache of chunks for a file."""
    if path not in _models:
        model = PieceModel(path)

        def encode(chunks: list[str]) -> list[bytes]:
            out = []
            for chunk in chunks:
                stream, text, ids = StreamingViterbi(model), chunk.replace(" ", SPACE), []
                try:
                    for at in range(0, len(text), STEP):
                        ids += stream.push(text[at : at + STEP])
                    ids += stream.finish()
                except ValueError:
                    ids = [i for p in model.merged(text) for i in model.id_list(p)]
                out.append(np.array(ids, dtype="<u4").tobytes())
            return out

        _models[path] = model, Cache(encode, most=300_000)
    return _models[path]


def cut(texts: pa.Array, apart: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts behind their dummy prefix, in chunks that no piece spans.

    Chunks start at a stretch of spaces (within a piece a space stands in front only), at a newline (which is in no piece), and
    between ASCII characters that are `apart`. No merge joins what stands around such a boundary, so all paths meet in it, and
    the streaming search would commit there: it starts anew at each, and what it gave for a chunk holds wherever the chunk stands.
    """
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, "")).cast(pa.string())
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    start = np.zeros(len(data) + 1, dtype=bool)
    start[1:-1] = ((data[1:] == 32) & (data[:-1] != 32)) | (data[1:] == 10) | (data[:-1] == 10)
    ascii_pair = (data[1:] < 128) & (data[:-1] < 128)
    start[1:-1] |= ascii_pair & apart[data[:-1] & 127, data[1:] & 127]
    start[3:-1] &= ~((data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2))  # U+2581 counts as a space
    start[offsets] = True
    at = np.flatnonzero(start[:-1])
    chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, np.searchsorted(at, offsets)


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts (no nulls in them), and the number of ids of each."""
    model, cache = model_for(path)
    chunks, bounds = cut(texts, model.apart)
    if not len(chunks):
        return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
    flat, starts, lengths = ids_of_chunks(chunks, cache)
    return gather(flat, starts, lengths), per_text(bounds, lengths)


def decoded(flat: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The bytes of each series of ids, without the dummy prefix."""
    model = model_for(path)[0]
    lengths = model.lengths[flat]
    data = gather(model.bytes, model.starts[flat], lengths).tobytes()
    ends = np.cumsum(per_text(np.concatenate(([0], np.cumsum(counts))), lengths))
    return [data[a:b].removeprefix(b" ") for a, b in zip([0, *ends.tolist()], ends.tolist())]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_ids, ids_crc32, round_trip and, if asked for, ids of every row, as the library gives them without begin or end.

    round_trip: decoding gives the text back, which it does unless the text has U+2581 itself. ids_crc32 is over the ids as
    little-endian unsigned 32-bit numbers. Null and empty texts have no ids. Texts are encoded in chunks between spaces, and a
    chunk of any length in a window bounded by the longest piece.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                flat, counts = encoded(texts, model_path)
                back = pa.array(decoded(flat, counts, model_path), pa.binary())
                ends = np.cumsum(counts)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends - counts, ends)]
                columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pc.equal(back, texts.cast(pa.binary()))]
                names = ["id", "n_ids", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)
    return found.withColumnRenamed("id", id_col)


def decode(encoded_rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null and empty lists give the empty text, bytes that are no UTF-8 U+FFFD.

    Ids outside the vocabulary raise an error.
    """
    ship_package(encoded_rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64)
            texts = [b.decode("utf-8", "replace") for b in decoded(np.asarray(ids.flatten()), counts, model_path)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded_rows.schema[id_col].dataType.simpleString()
    return encoded_rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
