"""Operator 8: line deduplication with two Bloom filters.

A first pass puts the hash of each line's key into a filter of keys seen once and, where it was there, into a filter of
keys seen twice; filters of tasks are merged (a key in two "once" filters goes to "twice"). Only keys that the second
filter knows - suspected repeats - are shuffled, with a count for each task, for the exact number of their documents and
the choice of the first one.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, trimmed, written

#: Bits of a filter for each line, the least and the greatest filter (16 MB), and the bits that are merged as one slice.
BITS_A_LINE, LEAST_BITS, MOST_BITS, SLICE_BITS = 8, 1 << 16, 1 << 27, 1 << 20
#: Repeated keys that are sent to every task (16 bytes each); more are joined.
MOST_KEYS = 1_000_000
#: Parts of a hot key's rows in that join.
SALTS = 16


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """A text's lines and their keys: stripped of white space at both ends, A-Z lower-cased."""
    lines = text.split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def _points(keys: list[bytes], bits: int) -> np.ndarray:
    """Each key's two bits."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    return np.stack([h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)], axis=1).astype(np.int64)


def _filters(df: DataFrame, least: int, bits: int) -> np.ndarray:
    """The merged filter of keys seen twice, as bytes; keys of fewer than `least` code points are not seen."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for b in slices(batch, 8 << 20):
                # A document counts once, however often it has a line.
                keys = [k for t in b.column(0).to_pylist() for k in {x for x in line_keys(t)[1] if x and len(x.decode()) >= least}]
                if not keys:
                    continue
                count = Counter(keys)
                p = _points(list(count), bits)
                had = ((once[p >> 3] >> (p & 7)) & 1).all(axis=1) | (np.fromiter(count.values(), np.int64) > 1)
                fresh = p.ravel()
                np.bitwise_or.at(once, fresh >> 3, (1 << (fresh & 7)).astype(np.uint8))
                again = p[had].ravel()
                np.bitwise_or.at(twice, again >> 3, (1 << (again & 7)).astype(np.uint8))
                # Keys of this slice that met in a filter's bits only are suspected later by mistake, never missed.
        task = TaskContext.get().partitionId() % 64
        size = min(bits, SLICE_BITS) // 8
        for k, at in enumerate(range(0, bits // 8, size)):
            o, t = once[at : at + size], twice[at : at + size]
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(o, 1)]), pa.array([zlib.compress(t, 1)])],
                                                 names=["slice", "part", "once", "twice"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for b in batches:
            for o, t in zip(b.column("once"), b.column("twice"), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (o, t))
                if once is None:
                    once, twice = o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(once, 1)]), pa.array([zlib.compress(twice, 1)])],
                                         names=["slice", "part", "once", "twice"])

    schema = "slice int, part int, once binary, twice binary"
    made = df.mapInArrow(lambda x: trimmed(build(x)), schema)
    made = made.groupBy("slice", "part").applyInArrow(merge, schema)  # so that no task merges more than a 64th of the tasks'
    got = made.groupBy("slice").applyInArrow(merge, schema).select("slice", "twice").collect()  # MOST_BITS at most
    out = np.zeros(bits // 8, np.uint8)
    size = min(bits, SLICE_BITS) // 8
    for r in got:
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.twice)), np.uint8)
    return out


def owner_of(doc: object, text: bytes) -> bytes:
    """What stands for a row: a hash of its id and text."""
    return xxhash.xxh3_128_digest(f"{doc}\n".encode() + text)


def repeated_lines(df: DataFrame, min_docs: int, least: int) -> tuple[DataFrame, object, int]:
    """(key, n, owner) of keys in at least min_docs rows of df(text binary, id long), exact; the broadcast filter and its
    bits. owner is that of the key's first row, by (id with nulls last, owner)."""
    spark = df.sparkSession
    lines = df.select(F.sum(F.length("text") - F.length(F.replace(F.col("text").cast("string"), F.lit("\n"))).cast("long") + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(lines * BITS_A_LINE, MOST_BITS):
        bits *= 2
    shared = spark.sparkContext.broadcast(_filters(df, least, bits).tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[bytes, tuple[int, tuple[bool, int, bytes]]] = {}

        def rows() -> pa.RecordBatch:
            first = [x[1] for x in have.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(have), pa.binary()), pa.array([x[0] for x in have.values()], pa.int64()), pa.array([x[0] for x in first], pa.bool_()),
                                               pa.array([x[1] for x in first], pa.int64()), pa.array([x[2] for x in first], pa.binary())], names=["key", "n", "none", "id", "owner"])

        for batch in batches:
            for b in slices(batch, 8 << 20):
                texts, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                for row, keys in suspected(texts, np.frombuffer(shared.value, np.uint8), bits, least):
                    mine = (ids[row] is None, ids[row] or 0, owner_of(ids[row], texts[row]))
                    for k in keys:
                        n, first = have.get(k, (0, mine))
                        have[k] = n + 1, min(first, mine)
                if len(have) > 200_000:
                    yield rows()
                    have.clear()
        if have:
            yield rows()

    exact = df.mapInArrow(lambda x: trimmed(suspects(x)), "key binary, n long, none boolean, id long, owner binary")
    exact = exact.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("none", "id", "owner")).alias("first")).where(F.col("n") >= min_docs)
    return written(exact.select("key", "n", "first.owner"), "lines"), shared, bits


def suspected(texts: list[bytes], table: np.ndarray, bits: int, least: int) -> Iterator[tuple[int, list[bytes]]]:
    """Of each text with any its place and the hashes of its distinct keys that the filter of repeats knows."""
    own = [[x for x in set(line_keys(t)[1]) if x and len(x.decode()) >= least] for t in texts]
    keys = [k for x in own for k in x]
    if not keys:
        return
    p = _points(keys, bits)
    hit = ((table[p >> 3] >> (p & 7)) & 1).all(axis=1)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    at = np.flatnonzero(hit)
    cut = np.flatnonzero(np.diff(row[at])) + 1
    for part in np.split(at, cut):
        if len(part):
            yield int(row[part[0]]), [xxhash.xxh3_128_digest(keys[i]) for i in part]


def drop_repeated_lines(df: DataFrame, text_col: str = "text", min_docs: int = 10, least: int = 1, keep: str = "none", id_col: str | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """Drops the lines whose key stands in at least min_docs rows, from every row, or with keep="first" from all but one.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of fewer than `least` code points
    stay. keep="first": in the row with the smallest id (column id_col, long; nulls last, then by a hash of id and text;
    rows that are equal in both alike) the key's first line stays. Returns df's columns with the kept text in text_col,
    joined by newlines, and the longs n_lines (before dropping) and n_dropped; columns of those names are replaced. A null
    or empty text is one empty line and gives "". Rows count one by one, repeated rows and ids too; an empty table stays
    empty. Keys are compared by 128-bit hashes.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    rest = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    own_id = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    bare = bounded_batches(df).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), own_id.alias("id"))
    repeated, shared, bits = repeated_lines(bare, min_docs, least)
    carried = bounded_batches(df).select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(None).cast("int").alias("rest"),
                                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), own_id.alias("id"))
    kind = carried.schema["rest"].dataType.simpleString()
    schema = f"rest {kind}, kept string, n_lines long, n_dropped long"
    first = keep == "first"

    def kept_rows(b: pa.RecordBatch, drops: list[dict[bytes, bytes]]) -> pa.RecordBatch:
        """drops: of each row the keys to drop, with their owners."""
        kept, n_lines, n_dropped = [], [], []
        for text, doc, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), drops, strict=True):
            lines, keys = line_keys(text)
            left = lines
            if drop:
                own, spared, left = owner_of(doc, text) if first else b"", set(), []
                for x, k in zip(lines, keys, strict=True):
                    h = xxhash.xxh3_128_digest(k) if k and len(k.decode()) >= least else b""
                    owner = drop.get(h)
                    if owner is None or first and owner == own and h not in spared:
                        left.append(x)
                        if owner is not None:
                            spared.add(h)
            kept.append(b"\n".join(left))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                          names=["rest", "kept", "n_lines", "n_dropped"])

    if repeated.count() <= most_keys:
        sent = df.sparkSession.sparkContext.broadcast({bytes(r.key): bytes(r.owner) for r in repeated.select("key", "owner").collect()})

        def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, 8 << 20):
                    yield kept_rows(b, [sent.value] * b.num_rows)

        out = carried.mapInArrow(lambda x: trimmed(by_set(x)), schema)
    else:  # the repeated keys of each distinct text come to it by a join; only keys that the filter knows are shuffled
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, 8 << 20):
                    texts = list(set(b.column(0).to_pylist()))
                    got = [(xxhash.xxh3_128_digest(texts[i]), k) for i, keys in suspected(texts, np.frombuffer(shared.value, np.uint8), bits, least) for k in keys]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*got, strict=True)], names=["doc", "key"])

        def spread(d: DataFrame) -> DataFrame:
            return d.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

        has = bare.mapInArrow(lambda x: trimmed(pairs(x)), "doc binary, key binary").distinct().select("*", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
        has = has.join(spread(repeated.select("key", "owner")), ["key", "salt"]).groupBy("doc").agg(F.collect_list(F.struct("key", "owner")).alias("drop"))
        hashed = carried.mapInArrow(lambda batches: (
            pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(t) for t in b.column(1).to_pylist()], pa.binary())], names=["rest", "text", "id", "doc"])
            for batch in batches for b in slices(batch, 8 << 20)), f"rest {kind}, text binary, id long, doc binary")
        # A text that a third of all rows share is spread over salts.
        hashed = hashed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))

        def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, 8 << 20):
                    yield kept_rows(b, [{x["key"]: x["owner"] for x in d or ()} for d in b.column(3).to_pylist()])

        out = hashed.join(spread(has), ["doc", "salt"], "left").select("rest", "text", "id", "drop").mapInArrow(lambda x: trimmed(by_row(x)), schema)
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), F.col("kept").alias(text_col), "n_lines", "n_dropped")
