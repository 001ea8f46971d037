"""Operator 6: token ids in Arrow files of fixed-size-list batches.

Each shard is one Arrow IPC file whose record batches hold equal-length sequences (ids) and their masks, both as
fixed-size lists, so that any sequence is a view into the mapped file; a second small file tells where each document
starts. Documents lie end to end in ascending id order across shards; the last sequence of a shard is padded and masked.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import commit_file, open_fs, tokenizer_path
from .token_order import encoded_in_order, unpacked
from .tokens import encoder

#: Sequences in a record batch; a shard's last one may have fewer.
BATCH = 256


@dataclass(frozen=True)
class Written:
    """A finished set of shards: folder, sequence length, bytes of an id, and (shard, docs, ids, sequences, first id) of each."""

    folder: str
    seq_len: int
    width: int
    shards: list[tuple[int, int, int, int, int]]


def _schema(seq_len: int, width: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


_DOCS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


class _Shard:
    """Writes one shard under temporary names and renames it when done."""

    def __init__(self, folder: str, shard: int, seq_len: int, width: int):
        self.fs, where = open_fs(folder)
        self.names = [f"{where}/shard-{shard:06d}.{x}.arrow" for x in ("ids", "docs")]
        self.seq_len, self.dtype = seq_len, np.dtype(f"<u{width}")
        self.schema = _schema(seq_len, width)
        from pyspark import TaskContext

        ctx = TaskContext.get()
        self.tmp = [f"{x}.tmp-{ctx.taskAttemptId() if ctx else 0}" for x in self.names]
        self.out = [self.fs.open_output_stream(x) for x in self.tmp]
        self.files = [pa.ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, _DOCS), strict=True)]
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = self.docs = self.seqs = 0
        self.index: list[tuple[int | None, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.index.append((doc, self.total, len(ids)))
        self.rest.append(ids)
        self.total += len(ids)
        self.waiting += len(ids)
        self.docs += 1
        if self.waiting >= BATCH * self.seq_len:  # whole batches only: all but a shard's last have as many sequences
            self._put(self.waiting // (BATCH * self.seq_len) * BATCH)
        if len(self.index) >= 8192:
            self._put_docs()

    def _put_docs(self) -> None:
        if self.index:
            ids, starts, ns = zip(*self.index, strict=True)
            self.files[1].write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64())], schema=_DOCS))
            self.index = []

    def _put(self, seqs: int, pad: int = 0) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.empty(0, self.dtype)
        mask = np.ones(seqs * self.seq_len, dtype=bool)
        if pad:
            flat = np.concatenate([flat, np.zeros(pad, self.dtype)])
            mask[-pad:] = False
        take = seqs * self.seq_len
        for at in range(0, take, BATCH * self.seq_len):
            to = min(take, at + BATCH * self.seq_len)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:to]), self.seq_len) for x in (flat, mask)]
            self.files[0].write_batch(pa.record_batch(lists, schema=self.schema))
        self.rest = [flat[take:]] if len(flat) > take else []
        self.waiting = len(flat) - take
        self.seqs += seqs

    def close(self) -> tuple[int, int, int]:
        if self.waiting:
            seqs = -(-self.waiting // self.seq_len)
            self._put(seqs, seqs * self.seq_len - self.waiting)
        self._put_docs()
        for f, o, t, n in zip(self.files, self.out, self.tmp, self.names, strict=True):
            f.close()
            o.close()
            commit_file(self.fs, t, n)
        return self.docs, self.total, self.seqs


def write_token_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                       end_id: int = 1, seq_len: int = 2048, shards: int | None = None) -> Written:
    """Encodes whole texts, appends end_id to each, and writes the ids in ascending id order.

    A null or empty text is one end_id; null ids come first; repeated ids stand together and each row is written; an
    empty table gives no shard. Only ids are shuffled. The driver gets one row for each shard and writes manifest.json
    last, so that a folder without it is unfinished. A lost task writes its shard again, under the same final name.
    """
    path = path or tokenizer_path()
    rows, _ = encoded_in_order(df, id_col, text_col, path, end_id, shards)
    width = encoder(path).width
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Shard | None = None
        shard = -1
        done = []
        for b in batches:
            for k, doc, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if k != shard:
                    if out:
                        done.append((shard, *out.close()))
                    out, shard = _Shard(folder, k, seq_len, width), k
                out.add(doc, unpacked(z.as_py(), out.dtype))
        if out:
            done.append((shard, *out.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], names=["shard", "docs", "ids", "seqs"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "shard long, docs long, ids long, seqs long").collect())
    first, shards = 0, []
    for k, docs, ids, seqs in got:
        shards.append((k, docs, ids, seqs, first))
        first += ids
    done = Written(folder, seq_len, width, shards)
    with fs.open_output_stream(f"{where}/manifest.json.tmp") as f:
        f.write(json.dumps(done.__dict__).encode())
    commit_file(fs, f"{where}/manifest.json.tmp", f"{where}/manifest.json")
    return done


def open_token_shards(folder: str) -> Written:
    fs, where = open_fs(folder)
    with fs.open_input_stream(f"{where}/manifest.json") as f:
        x = json.loads(f.read())
    return Written(x["folder"], x["seq_len"], x["width"], [tuple(s) for s in x["shards"]])


class Sequences:
    """Random access to the sequences of a folder: seqs[i] gives (ids, mask), views into the mapped file both; ids is a
    numpy array, mask (whose values are single bits) an Arrow one. Every batch but a shard's last has BATCH sequences, so
    a sequence's place is a division."""

    def __init__(self, folder: str):
        self.info = open_token_shards(folder)
        self.starts = np.cumsum([0, *(s[3] for s in self.info.shards)])
        self.open: dict[int, pa.ipc.RecordBatchFileReader] = {}

    def __len__(self) -> int:
        return int(self.starts[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.starts, i, side="right")) - 1
        if k not in self.open:
            fs, where = open_fs(self.info.folder)
            self.open[k] = pa.ipc.open_file(fs.open_input_file(f"{where}/shard-{self.info.shards[k][0]:06d}.ids.arrow"))
        batch, row = divmod(i - int(self.starts[k]), BATCH)
        n = self.info.seq_len
        ids, mask = (c.values.slice(row * n, n) for c in self.open[k].get_batch(batch).columns)
        return ids.to_numpy(zero_copy_only=True), mask


def _documents(folder: str, shard: int, width: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, start in the shard, ids) of a shard's documents, read from its two files batch by batch."""
    fs, where = open_fs(folder)
    with fs.open_input_file(f"{where}/shard-{shard:06d}.docs.arrow") as d, fs.open_input_file(f"{where}/shard-{shard:06d}.ids.arrow") as s:
        docs, seqs = pa.ipc.open_file(d), pa.ipc.open_file(s)
        held, base, nxt = np.empty(0, f"<u{width}"), 0, 0
        for k in range(docs.num_record_batches):
            b = docs.get_batch(k)
            for doc, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                while base + len(held) < start + n:
                    more = seqs.get_batch(nxt).column(0).flatten().to_numpy()
                    held, base, nxt = np.concatenate([held[start - base :], more]), start, nxt + 1
                yield doc, start, held[start - base : start - base + n]


def read_documents(spark: SparkSession, done: Written, id_name: str = "doc_id") -> DataFrame:
    """Each document from the files: (id, start, n_tokens, ids_crc32); a task for each shard."""
    schema = f"{id_name} long, start long, n_tokens long, ids_crc32 long"
    if not done.shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc, start, ids in _documents(done.folder, shard, done.width):
                    rows.append((doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[id_name, "start", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[id_name, "start", "n_tokens", "ids_crc32"])

    todo = spark.createDataFrame([(i, s[0], s[4]) for i, s in enumerate(done.shards)], "at int, shard long, first long")
    return todo.repartitionById(len(done.shards), "at").select("shard", "first").mapInArrow(run, schema)
