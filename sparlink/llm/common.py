"""Shared helpers: the shared folder, written tables that cut lineage, file access from any process."""
from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files live unless a path is given.
TOKENIZER_FILE = "word_bpe_49k.json"

#: What counts as white space between words everywhere in this package: \x20 and \x09-\x0D,
#: which is also what bytes.split() and bytes.strip() take without arguments.
SPACE = "\t\n\x0b\x0c\r "


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset and all runs in one process, a
    local one. On a cluster without that setting it raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sparlink-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there and lost executors cost nothing."""
    where = new_dir(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI or a plain path; works on executors and on the driver."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(use_mmap=True), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(use_mmap=True), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit_file(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Renames a finished file into place; a retried task writes the same bytes, so the last one may win."""
    fs.move(temporary, final)


@contextlib.contextmanager
def no_collector() -> Iterator[None]:
    """Holds Python's cycle collector off while a step makes many small objects, none of them cyclic."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def ascii_runs(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of string texts with A-Z lower-cased, as bytes.lower().split() has them: for each word the place of its
    value, the distinct values, and the number of words of each text. A null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    d = lists.flatten().dictionary_encode()
    at, values = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.cast(pa.binary()).to_pylist()
    if b"" in values:  # at the ends of texts that begin or end with white space
        real = at != values.index(b"")
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n)).astype(np.int64)
        at = at[real]
    return at, values, n


#: Stores of known words that a Python worker keeps from task to task.
STORES: list[dict] = []


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Passes batches on; when a task ends, gives the memory that Arrow and the allocator hold back to the system.

    Workers live on between stages: a task that doesn't use the stores of known words (keep False) empties them first.
    """
    if not keep and any(STORES):
        for x in STORES:
            x.clear()
        _give_back()
    try:
        yield from batches
    finally:
        _give_back()


def bounded_batches(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df, in a session whose Arrow batches to Python are bounded by bytes as well as by rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = conf.get(key, None)
    if not have or not have.rstrip("bB").isdigit() or int(have.rstrip("bB")) > most:
        conf.set(key, f"{most}b")
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into runs of about `most` bytes (one row at least), so that little is held at once."""
    row = np.zeros(batch.num_rows, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            row += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(row + 16)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _narrowed(keyed: DataFrame, by: str, heavy: list[int], shift: int) -> DataFrame:
    """The rows of keyed whose `by`, shifted, is one of heavy."""
    some = keyed.sparkSession.createDataFrame([(x,) for x in heavy], "__bin long")
    return keyed.join(F.broadcast(some), F.shiftright(by, shift) == F.col("__bin"), "left_semi")


def order_bounds(keyed: DataFrame, least: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Increasing bounds (id, h) that cut the rows of keyed(id long, h long, size long) into shards of about equal size:
    `least` of them, or as many as keep a shard near most_bytes.

    They are exact sums by bins of the id, so they don't depend on how rows are dealt; bins that hold much are cut finer,
    and one id that holds more than a shard is cut by h. A null id counts as the smallest. What the driver gets is a few
    hundred numbers for each shard at most.
    """
    keyed = keyed.select(F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("id"), "h", "size")
    lo, hi, total = keyed.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if lo is None or not total:
        return none
    n = max(least, -(-total // most_bytes))
    share = total / n
    shift = 0
    while (hi >> shift) - (lo >> shift) >= 16384 + 4 * n:
        shift += 1
    last, leaves, inside = (1 << 63) - 1, [], keyed
    while True:
        got = inside.groupBy(F.shiftright("id", shift).alias("bin")).agg(F.sum("size").alias("size")).collect()
        heavy = [r.bin for r in got if r.size > (share / 4 if shift else share)]
        cut = set(heavy)
        leaves += [((r.bin + 1 << shift) - 1, last, r.size) for r in got if r.bin not in cut]
        if not heavy:
            break
        inside = _narrowed(inside, "id", heavy, shift)
        if shift:
            shift = max(0, shift - max(6, ((16384 + 4 * n) // len(heavy)).bit_length() - 1))
            continue
        # Single ids of more than a shard's size, by the upper bits of h.
        bits = min(32, max(4, int(max(r.size for r in got) / share * 8).bit_length()))
        got = inside.groupBy("id", F.shiftright("h", 64 - bits).alias("bin")).agg(F.sum("size").alias("size")).collect()
        leaves += [(r.id, (r.bin + 1 << 64 - bits) - 1, r.size) for r in got]
        break
    leaves.sort()
    sums = np.cumsum([float(x[2]) for x in leaves])
    ends = np.flatnonzero(np.floor(sums[:-1] / share) > np.floor(np.concatenate([[0.0], sums[:-2]]) / share)) if len(sums) > 1 else []
    return np.array([leaves[i][0] for i in ends], np.int64), np.array([leaves[i][1] for i in ends], np.int64)


def shard_of(bounds: tuple[np.ndarray, np.ndarray], ids: pa.Array, h: pa.Array) -> np.ndarray:
    """The shard of each (id, h): the number of bounds below it."""
    own = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    at = np.searchsorted(bounds[0], own, side="left")
    to = np.searchsorted(bounds[0], own, side="right")
    many = np.flatnonzero(to > at)  # rows whose id is a bound
    if len(many):
        hs = h.to_numpy(zero_copy_only=False)
        for i in np.unique(own[many]):
            rows = many[own[many] == i]
            a, b = at[rows[0]], to[rows[0]]
            at[rows] = a + np.searchsorted(bounds[1][a:b], hs[rows], side="left")
    return at


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
