"""A minimal acyclic automaton of words whose paths add up to the words' numbers, and the ids that each number stands for.

Words that end alike share their suffixes' states, because outputs are no part of a state: each arc carries the number of words that
come before those it leads to, and the sum along a word's path is its number among all words in order.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import gather


@dataclass(frozen=True)
class Automaton:
    """arcs: state << 8 | byte in order, with target and added number; ends: states in which a word ends; ids of word k: flat[starts[k] : starts[k + 1]]."""

    arcs: np.ndarray
    targets: np.ndarray
    adds: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    flat: np.ndarray
    longest: int

    @staticmethod
    def compiled(lexicon: Iterable[tuple[bytes, bytes]]) -> Automaton:
        """From words with their ids (little-endian uint32); of words given twice the first counts, empty ones don't."""
        words: dict[bytes, bytes] = {}
        for word, ids in lexicon:
            if word:
                words.setdefault(word, ids)
        register: dict[tuple, int] = {}
        shapes: list[tuple] = []

        def settled(node: list) -> int:
            """The state of a node whose arcs all lead to states: the one that is alike, or a new one."""
            shape = (node[0], *node[1].items())
            if shape not in register:
                register[shape] = len(shapes)
                shapes.append(shape)
            return register[shape]

        # The path of the word before stays open; what the next word does not share of it is settled, from its end.
        order, path, last = sorted(words), [[False, {}]], b""
        for word in [*order, b""]:
            common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            for at in range(len(last), common, -1):
                path[at - 1][1][last[at - 1]] = settled(path.pop())
            for _ in word[common:]:
                path.append([False, {}])
            path[-1][0] = bool(word) or path[-1][0]
            last = word
        root = settled(path[0])
        below: list[int] = []  # words that can be read from a state on; states come after those they lead to
        for end, *arcs in shapes:
            below.append(int(end) + sum(below[t] for _, t in arcs))
        rows = []
        for state, (end, *arcs) in enumerate(shapes):
            before = int(end)
            for byte, target in arcs:
                rows.append((((root - state) << 8) | byte, root - target, before))  # the root is 0
                before += below[target]
        arcs, targets, adds = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3).T
        ids = [words[w] for w in order]
        starts = np.cumsum([0, *(len(x) // 4 for x in ids)])
        ends = np.array([s[0] for s in reversed(shapes)], dtype=np.uint8)
        return Automaton(np.ascontiguousarray(arcs), targets.astype(np.int32), adds.astype(np.int32), ends, starts.astype(np.int64), np.frombuffer(b"".join(ids), dtype=np.uint32), max(map(len, order), default=0))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, -1 for words that are not in it. All words walk together, a byte at a time."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.arcs):
            return out
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        at = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state, number = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for step in range(self.longest):
            if not len(at):
                break
            key = (state << 8) | data[starts[at] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            on = self.arcs[arc] == key
            at, arc, number = at[on], arc[on], number[on]
            state, number = self.targets[arc].astype(np.int64), number + self.adds[arc]
            done = lengths[at] == step + 1
            out[at[done]] = np.where(self.ends[state[done]] == 1, number[done], -1)
            at, state, number = at[~done], state[~done], number[~done]
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words one after another, and how many each has."""
        starts = self.starts[numbers]
        lengths = self.starts[numbers + 1] - starts
        return gather(self.flat, starts, lengths), lengths

    def to_bytes(self) -> bytes:
        """An Arrow file of one row, which a process can map into its memory as it is."""
        names = ("arcs", "targets", "adds", "ends", "starts", "flat")
        lists = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (getattr(self, n) for n in names)]
        batch = pa.RecordBatch.from_arrays([*lists, pa.array([self.longest])], names=[*names, "longest"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, batch.schema) as file:
            file.write(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def mapped(path: str) -> Automaton:
        """The automaton in a file, not read but mapped: workers of one machine share its pages."""
        batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
        *lists, longest = batch.columns
        return Automaton(*[np.asarray(x.flatten()) for x in lists], longest[0].as_py())
