"""Operator 9: order-preserving packing of documents into windows by dynamic programming.

A shard's ids stand end to end in document order. Windows of at most `size` ids are cut at document ends (free), at
sentence ends (a small penalty) or, where a sentence is too long, anywhere (a larger one). The cheapest cuts are found
from left to right: cost(j) = min over i within a window of cost(i) + padding(i, j) + penalty(j). Since padding is
size - (at(j) - at(i)), the minimum is that of cost(i) + at(i) in a sliding range, kept in a monotone queue.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tokenizer_path, trimmed
from .token_order import encoded_in_order, unpacked
from .tokens import encoder, word_end_punctuation

#: Ids held and cut at once.
BLOCK = 1 << 20
#: Sequence numbers of shard k start at k * SHARD.
SHARD = 1 << 40


def window_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Cheapest cuts of [0, at[-1]) at some of the places at (increasing, gaps of at most size), the last included.

    The last window's padding counts nothing: it is cut into powers of two, or waits for more.
    """
    places, costs = at.tolist(), penalty.tolist()
    best = [0.0] * (len(places) + 1)  # best[i + 1]: cost of cutting at places[i]; best[0]: the start
    came = [0] * (len(places) + 1)
    pos = [0, *places]
    queue = deque([0])
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        best[j] = best[i] + size - (here - pos[i]) + costs[j - 1]
        came[j] = i
        key = best[j] + here
        while queue and best[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    last = len(pos) - 1
    came[last] = min((i for i in range(bisect_left(pos, pos[last] - size), last)), key=best.__getitem__)
    cuts, j = [], last
    while j:
        cuts.append(pos[j])
        j = came[j]
    return cuts[::-1]


def places_to_cut(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int, sentence_penalty: float, hard_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Increasing places with their penalties; where they lie further apart than size / 128, places in between."""
    at = np.union1d(doc_ends, sentence_ends)
    at = at[at > 0]
    penalty = np.where(np.isin(at, doc_ends), 0.0, sentence_penalty)
    step = max(1, size // 128)
    before = np.concatenate([[0], at[:-1]])
    wide = np.flatnonzero(at - before > step)
    if len(wide):
        more = np.concatenate([np.arange(before[i] + step, at[i], step) for i in wide])
        both = np.concatenate([at, more])
        order = np.argsort(both, kind="stable")
        at, penalty = both[order], np.concatenate([penalty, np.full(len(more), hard_penalty)])[order]
    return at, penalty


def tail_lengths(rest: int, size: int) -> list[int]:
    """Lengths for a last, short window: powers of two need no padding, so the rest is cut into those it is the sum of."""
    if rest == size:
        return [size]
    return [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


class _Packer:
    """Packs one shard's documents; put() and end() give pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, shard: int, size: int, sentence_end: np.ndarray, dtype: np.dtype, sentence_penalty: float, hard_penalty: float):
        self.size, self.sentence_end, self.dtype = size, sentence_end, dtype
        self.penalties = sentence_penalty, hard_penalty
        self.next = shard * SHARD
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens of the document, of which already placed
        self.parts: list[np.ndarray] = []
        self.held = 0

    def put(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc, len(ids), 0))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self._cut(last=False)

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield from self._cut(last=True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        flat = np.concatenate(self.parts)
        ends = np.cumsum([n - had for _, n, had in self.docs])
        inside = self.sentence_end[np.minimum(flat, len(self.sentence_end) - 1)]
        at, penalty = places_to_cut(ends, np.flatnonzero(inside) + 1, self.size, *self.penalties)
        cuts = window_cuts(at, penalty, self.size)
        before = cuts[-2] if len(cuts) > 1 else 0
        if last:
            lengths = tail_lengths(cuts[-1] - before, self.size)
            cuts = [*cuts[:-1], *(before + np.cumsum(lengths)).tolist()]
        else:  # the last window may be short: it waits for what follows
            cuts = cuts[:-1]
        begin = 0
        starts = ends - np.array([n - had for _, n, had in self.docs])
        for cut in cuts:
            d = int(np.searchsorted(ends, begin, side="right"))
            at = begin
            while at < cut:
                doc, n, had = self.docs[d]
                to = min(cut, int(ends[d]))
                yield doc, had + at - int(starts[d]), flat[at:to], n, self.next, at - begin
                at, d = to, d + 1
            self.next += 1
            begin = cut
        if last:
            self.docs, self.parts, self.held = [], [], 0
            return
        d = int(np.searchsorted(ends, begin, side="right"))
        doc, n, had = self.docs[d]
        self.docs = [(doc, n, had + begin - int(starts[d])), *self.docs[d + 1 :]]
        self.parts, self.held = [flat[begin:].copy()], len(flat) - begin


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, size: int = 4096,
         sentence_penalty: float = 2.0, hard_penalty: float = 16.0) -> DataFrame:
    """Packs whole documents (ids plus end_id) into sequences of at most `size`: one row for each piece,
    (id, start, length, ids, doc_tokens, sequence_id, offset), ids as little-endian unsigned 32-bit integers.

    Documents keep the order of their ids within a shard; null ids come first and repeated ids are documents of their
    own, told apart by sequence_id and offset. A null or empty text is one end_id; an empty table gives no piece. A
    document longer than a window takes several. Ids are encoded at the scan and shuffled once, by ranges of the id;
    a task holds about a million ids at a time. A shard's last window is cut into powers of two, which need no padding.
    """
    path = path or tokenizer_path()
    rows, _ = encoded_in_order(df, id_col, text_col, path, end_id)
    dtype = encoder(path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_end_punctuation(path)
        now: _Packer | None = None
        shard, out, size_out = -1, [], 0

        def batch() -> pa.RecordBatch:
            ids, starts, flat, ns, seqs, offs = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(map(len, flat), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in flat], pa.binary()),
                 pa.array(ns, pa.int64()), pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def pieces() -> Iterator[tuple]:
            nonlocal now, shard
            for b in batches:
                for k, doc, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                    if k != shard:
                        if now:
                            yield from now.end()
                        now, shard = _Packer(k, size, table, dtype, sentence_penalty, hard_penalty), k
                    yield from now.put(doc, unpacked(z.as_py(), dtype))
            if now:
                yield from now.end()

        for p in pieces():
            out.append(p)
            size_out += len(p[2])
            if size_out >= 1 << 19:
                yield batch()
                out, size_out = [], 0
        if out:
            yield batch()

    got = rows.mapInArrow(lambda x: trimmed(run(x)), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return got.withColumnRenamed("id", id_col)
