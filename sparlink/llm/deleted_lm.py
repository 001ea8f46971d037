"""Operator 7: language-model scores by deleted interpolation.

A word's probability of an order mixes its relative frequency after the words before it with the probability of the next
lower order, down to that of the word alone; the weight depends on how often the words before were seen (buckets by powers
of two). Weights are learned by expectation-maximisation on training documents held out for that (fold 2), under counts
of the other training documents, order by order.

Documents are packed into blocks of bounded size. Each block asks for the totals of the distinct n-grams it has, by
slices of their hash's range, with its own counts; a slice adds all blocks' counts and answers each. There are as many
slices as keep one bounded, so no model is broadcast, collected or held by one task, a frequent n-gram costs a row part
for each block, and what is gathered grows with the corpus. Answers lie in files of many blocks, each block at its place.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_runs, bounded_batches, commit_file, new_dir, open_fs, partitions, slices, trimmed, utf8, written

#: Bytes of text in a block; bytes of text for a slice of the n-grams of one order; blocks in a file of answers.
BLOCK, SLICE, BLOCKS_IN_FILE = 8 << 20, 16 << 20, 64
#: Folds of crc32(id) mod 5: never learned from; learned from after the weights are.
HELD, TUNE = 1, 2
#: Context buckets; bins of log2 of the ratio of the two estimates, a sixteenth wide, from -32 to 48.
BUCKETS, BINS = 48, 1280
END = np.uint64(0x9AE16A3B2F90404F)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens end to end, each text followed by the end token, and the number of tokens of each."""
    at, values, n = ascii_runs(texts)
    h = xxhash.xxh3_64_intdigest
    lengths = n + 1
    out = np.full(int(lengths.sum()), END, dtype="<u8")
    word = np.ones(len(out), dtype=bool)
    word[np.cumsum(lengths) - 1] = False
    out[word] = np.fromiter(map(h, values), "<u8", len(values))[at]
    return out, lengths


def ngrams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """By order from 1 on, the hash of the n-gram that ends at each token; before a text's first token stand end tokens."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, key = [tokens], tokens
    for k in range(1, order):
        before = np.full_like(tokens, END)
        before[k:] = tokens[:-k]
        before = np.where(place >= k, before, END)
        x = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x + key) * np.uint64(0x94D049BB133111EB)
        key = x ^ (x >> np.uint64(32))
        out.append(key)
    return out


def fold_of(doc: str | None) -> int:
    return zlib.crc32((doc or "").encode()) % 5


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, folds, sizes, z): whole texts packed by zstd, about BLOCK bytes in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def row() -> pa.RecordBatch:
            z = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([part + n], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([[fold_of(i) for i in ids]], pa.list_(pa.int32())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([z], pa.binary())], names=["block", "ids", "folds", "sizes", "z"])

        for batch in batches:
            for b in slices(batch):
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= BLOCK or len(ids) >= 1 << 16:
                        yield row()
                        n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield row()

    out = bounded_batches(df).select(F.col(id_col).cast("string").alias("id"), utf8(F.col(text_col)).alias("text"))
    return written(out.mapInArrow(lambda x: trimmed(run(x)), "block long, ids array<string>, folds array<int>, sizes array<long>, z binary"), "lm-blocks", "uncompressed")


def _texts(z: bytes, sizes: np.ndarray) -> pa.Array:
    flat = zstandard.ZstdDecompressor().decompress(z)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _slice_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(z: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Increasing hashes as their differences, byte by byte, so that the upper bytes are zeros."""
    return _pack(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _unpack_keys(z: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack(z, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _file(block: int, n_files: int) -> int:
    return zlib.crc32(str(block).encode()) % n_files


def counts(packed: DataFrame, order: int) -> tuple[str, int, dict[str, int]]:
    """The folder of each block's answers, its number of files and the corpus totals.

    An answer has, for a block, slice and order, the totals of the block's distinct n-grams in the order of their hashes,
    in the documents that weights are learned under (a) and those they are learned on (b).
    """
    spark = packed.sparkSession
    n_blocks, size = packed.select(F.expr("aggregate(sizes, 0L, (x, y) -> x + y)").alias("n")).agg(F.count("*"), F.sum("n")).first()
    n_slices = max(partitions(spark), -(-(size or 0) // SLICE))
    n_files = max(partitions(spark), -(-n_blocks // BLOCKS_IN_FILE))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, folds, sizes, z in zip(b.column("block").to_pylist(), b.column("folds"), b.column("sizes"), b.column("z").to_pylist(), strict=True):
                tokens, lengths = tokens_of(_texts(z, sizes.values.to_numpy()))
                fold = np.repeat(folds.values.to_numpy(), lengths)
                for k, keys in enumerate(ngrams(tokens, lengths, order)):
                    own, at = np.unique(keys, return_inverse=True)
                    a = np.bincount(at[(fold != HELD) & (fold != TUNE)], minlength=len(own)).astype("<u4")
                    t = np.bincount(at[fold == TUNE], minlength=len(own)).astype("<u4")
                    slice_ = _slice_of(own, n_slices)
                    for i, j in _runs(slice_):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k * n_slices + int(slice_[i])], pa.int32()), pa.array([block], pa.int64()), pa.array([_pack_keys(own[i:j])]), pa.array([_pack(a[i:j])]), pa.array([_pack(t[i:j])])],
                            names=["slice", "block", "keys", "a", "b"])

    names = ["file", "block", "slice", "a", "b", "v", "v_a", "n", "n_a"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task may have several slices, one after the other."""
        slice_, got = -1, []
        for b in batches:
            for r in zip(*(b.column(x).to_pylist() for x in ("slice", "block", "keys", "a", "b")), strict=True):
                if r[0] != slice_ and got:
                    yield from answers(slice_, got)
                    got = []
                slice_ = r[0]
                got.append(r[1:])
        if got:
            yield from answers(slice_, got)

    def answers(slice_: int, got: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = [_unpack_keys(r[1]) for r in got]
        distinct, at = np.unique(np.concatenate(own), return_inverse=True)
        total = [np.bincount(at, np.concatenate([_unpack(r[i], "<u4") for r in got]), len(distinct)).astype("<u4") for i in (2, 3)]
        ends = np.cumsum([len(x) for x in own])
        both = total[0].astype(np.int64) + total[1]
        own_totals = int(np.count_nonzero(both)), int(np.count_nonzero(total[0])), int(both.sum()), int(total[0].sum(dtype=np.int64))
        for n, (r, e, x) in enumerate(zip(got, ends, own, strict=True)):
            mine = at[e - len(x) : e]
            first = n == 0 and slice_ < n_slices  # the totals of a slice of words go with its first answer
            yield pa.RecordBatch.from_arrays(
                [pa.array([_file(r[0], n_files)], pa.int32()), pa.array([r[0]], pa.int64()), pa.array([slice_], pa.int32()), pa.array([_pack(total[0][mine])]), pa.array([_pack(total[1][mine])]),
                 *(pa.array([x * first], pa.int64()) for x in own_totals)], names=names)

    folder = new_dir(spark, "lm-answers")
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a file's answers, a batch for each, and where each block's lie; gives the totals."""
        file, out, total = -1, None, np.zeros(4, dtype=np.int64)
        for b in batches:
            for k, block, slice_, a, t, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != file:
                    if out:
                        out.close()
                    file, out = k, _Answers(folder, k)
                out.add(block, slice_ // n_slices, a, t)
                total += np.array(own)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total.tolist()], names=names[5:])

    asked = packed.mapInArrow(lambda x: trimmed(ask(x)), "slice int, block long, keys binary, a binary, b binary")
    asked = asked.repartitionById(n_slices * order, F.col("slice")).sortWithinPartitions("slice", "block")
    got = asked.mapInArrow(lambda x: trimmed(answer(x)), "file int, block long, slice int, a binary, b binary, v long, v_a long, n long, n_a long")
    got = got.repartitionById(n_files, F.col("file")).sortWithinPartitions("file", "block", "slice")
    got = got.mapInArrow(lambda x: trimmed(store(x)), "v long, v_a long, n long, n_a long").agg(*(F.sum(x) for x in names[5:])).first()
    return folder, n_files, {k: x or 0 for k, x in zip(names[5:], got, strict=True)}


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """The (start, end) of each run of equal values."""
    cut = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True)) if len(x) else []


_ANSWER = pa.schema([("order", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


class _Answers:
    """A file of answers under a temporary name until it is whole, and beside it the batches of each block."""

    def __init__(self, folder: str, file: int):
        self.fs, where = open_fs(folder)
        ctx = TaskContext.get()
        self.name, self.tmp = f"{where}/{file:06d}", f".tmp-{ctx.taskAttemptId() if ctx else 0}"
        self.out = self.fs.open_output_stream(f"{self.name}.arrow{self.tmp}")
        self.file, self.at, self.n = pa.ipc.new_file(self.out, _ANSWER), {}, 0

    def add(self, block: int, order: int, a: bytes, b: bytes) -> None:
        self.file.write_batch(pa.record_batch([pa.array([order], pa.int32()), pa.array([a]), pa.array([b])], schema=_ANSWER))
        self.at.setdefault(block, [self.n, self.n])[1] = self.n + 1
        self.n += 1

    def close(self) -> None:
        self.file.close()
        self.out.close()
        with self.fs.open_output_stream(f"{self.name}.json{self.tmp}") as f:
            f.write(json.dumps(self.at).encode())
        for kind in ("arrow", "json"):
            commit_file(self.fs, f"{self.name}.{kind}{self.tmp}", f"{self.name}.{kind}")


def _totals(folder: str, n_files: int, block: int, tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, ...]]:
    """By order from 1 on, of each token's n-gram the totals (a, b) and those of the words before it, as (a, b, c_a, c_b)."""
    fs, where = open_fs(folder)
    name = f"{where}/{_file(block, n_files):06d}"
    with fs.open_input_stream(f"{name}.json") as f:
        begin, end = json.loads(f.read())[str(block)]
    parts: list[list[list[np.ndarray]]] = [[[], []] for _ in range(order)]
    with fs.open_input_file(f"{name}.arrow") as f:
        r = pa.ipc.open_file(f)
        for i in range(begin, end):
            k, a, b = (c[0].as_py() for c in r.get_batch(i).columns)
            if k < order:
                parts[k][0].append(_unpack(a, "<u4"))
                parts[k][1].append(_unpack(b, "<u4"))
    first = np.cumsum(lengths) - lengths
    out: list[tuple[np.ndarray, ...]] = []
    ends = None
    for k, keys in enumerate(ngrams(tokens, lengths, order)):
        at = np.unique(keys, return_inverse=True)[1]
        own = [np.concatenate(x).astype(np.float64)[at] for x in parts[k]]
        if ends is None:  # the number of texts: what stands before a text's first token
            last = first[0] + lengths[0] - 1
            ends = [x[last] for x in own]
        context = []
        for x, e in zip(out[-1][:2] if out else own, ends, strict=True):
            c = np.empty_like(x)
            c[1:] = x[:-1]
            c[first] = e
            context.append(c)
        out.append((*own, *context))
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1))[1], 0)


def learn_weights(hist: np.ndarray, logs: np.ndarray, rounds: int = 100) -> np.ndarray:
    """By bucket the higher order's weight, by expectation-maximisation on counts of (bucket, bin of the ratio) and on the
    sums of the ratio's log2 in each: a bin counts at its mean."""
    ratio = 2.0 ** (logs / np.maximum(hist, 1))
    ratio[:, 0] = 0.0
    w = np.full(BUCKETS, 0.5)
    total = hist.sum(axis=1)
    for _ in range(rounds):
        x = w[:, None] * ratio
        w = np.where(total > 0, (hist * x / (x + 1 - w[:, None])).sum(axis=1) / np.maximum(total, 1), 0.5).clip(1e-6, 1 - 1e-6)
    w[0] = 0.0
    return w


def _mixed(totals: list[tuple[np.ndarray, ...]], floor: float, weights: list[np.ndarray], whole: bool) -> np.ndarray:
    """Each token's probability by the orders that have weights; whole: under all training documents, else under a alone."""
    pick = (lambda a, b: a + b) if whole else (lambda a, b: a)
    out = (pick(*totals[0][:2]) + 0.5) / floor
    for (a, b, c_a, c_b), w in zip(totals[1:], weights, strict=False):
        n, c = pick(a, b), pick(c_a, c_b)
        own = w[bucket_of(c)]
        out = own * n / np.maximum(c, 1) + (1 - own) * out
    return out


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """One row for each input row: (id as string, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are words outside \\x20 and \\x09-\\x0D with A-Z lower-cased, and one end. base_score is the add-half unigram
    log10 probability, score the model's that interpolates n-grams of `order` words and fewer. A null or empty text is its
    end token; a null id counts as the empty string in the fold; repeated rows count and score each; an empty table gives
    no row.
    """
    packed = blocks(df, id_col, text_col)
    folder, n_files, v = counts(packed, order)
    n_all = v["n"]
    floor_a, floor = v["n_a"] + 0.5 * (v["v_a"] + 1), n_all + 0.5 * (v["v"] + 1)
    weights: list[np.ndarray] = []

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist, logs = np.zeros(BUCKETS * BINS, dtype=np.int64), np.zeros(BUCKETS * BINS)
        k = len(weights) + 1
        for b in batches:
            for block, folds, sizes, z in zip(b.column("block").to_pylist(), b.column("folds"), b.column("sizes"), b.column("z").to_pylist(), strict=True):
                tokens, lengths = tokens_of(_texts(z, sizes.values.to_numpy()))
                t = _totals(folder, n_files, block, tokens, lengths, k + 1)
                tune = np.repeat(folds.values.to_numpy() == TUNE, lengths)
                n, c, low = t[k][0][tune], t[k][2][tune], _mixed(t, floor_a, weights, False)[tune]
                some = (n > 0) & (c > 0)
                x = np.log2(np.where(some, n, 1) / np.maximum(c, 1) / low)
                at = bucket_of(c) * BINS + np.where(some, np.clip(np.floor((x + 32) * 16) + 1, 1, BINS - 1), 0).astype(np.int64)
                hist += np.bincount(at, minlength=BUCKETS * BINS)
                logs += np.bincount(at, np.where(some, x, 0.0), BUCKETS * BINS)
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(hist[at], pa.int64()), pa.array(logs[at])], names=["cell", "n", "x"])

    for _ in range(1, order):
        hist, logs = np.zeros(BUCKETS * BINS), np.zeros(BUCKETS * BINS)  # 61,440 cells, whatever the corpus
        for r in packed.mapInArrow(lambda x: trimmed(ratios(x)), "cell int, n long, x double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            hist[r.cell], logs[r.cell] = r.n, r.x
        weights.append(learn_weights(hist.reshape(BUCKETS, BINS), logs.reshape(BUCKETS, BINS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, folds, sizes, z in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), b.column("folds"), b.column("sizes"), b.column("z").to_pylist(), strict=True):
                tokens, lengths = tokens_of(_texts(z, sizes.values.to_numpy()))
                t = _totals(folder, n_files, block, tokens, lengths, order)
                word = t[0][0] + t[0][1]
                mixed = _mixed(t, floor, weights, True)
                first = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(folds.values.to_numpy() == HELD), pa.array(lengths), pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
                     pa.array(np.full(len(lengths), n_all)), pa.array(np.add.reduceat(np.log10((word + 0.5) / floor), first)), pa.array(np.add.reduceat(np.log10(mixed), first))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = packed.mapInArrow(lambda x: trimmed(score(x)), "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
