"""Encoded documents dealt out in id order, for the operators that write or pack ids."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, order_bounds, partitions, shard_of, slices, trimmed
from .tokens import encoder

#: Bytes of text in a shard at most, but for one id's equal texts.
SHARD_BYTES = 256 << 20


def encoded_in_order(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, shards: int | None = None) -> tuple[DataFrame, int]:
    """(shard, id, n, z) sorted by id within each shard, and the number of shards.

    Shard k holds ids below those of shard k+1; null ids come first, equal ids stand together in the order of a hash of
    their texts, and an id that holds more than a shard is cut by that hash (equal rows stay in one shard). There are
    `shards` of them, else as many as the session has shuffle partitions, more where a shard would pass SHARD_BYTES of
    text. z: the document's ids with end_id, in the encoder's width, by zstd. Texts are encoded where they are read; only
    ids are shuffled, at about half a text's size.
    """
    text = F.col(text_col).cast("string")
    own = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    keyed = own.select("id", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"))
    bounds = order_bounds(keyed, shards or partitions(df.sparkSession), SHARD_BYTES)
    count = len(bounds[0]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for b in slices(batch, 16 << 20):
                got = [x + end for x in enc.encode(b.column(2)).to_pylist()]
                where = shard_of(bounds, b.column(0), b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), b.column(0), b.column(1), pa.array([len(x) // enc.width for x in got], pa.int64()), pa.array(map(pack, got), pa.binary())],
                    names=["shard", "id", "h", "n", "z"])

    out = bounded_batches(own).mapInArrow(lambda x: trimmed(run(x), keep=True), "shard int, id long, h long, n long, z binary")
    return out.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "id", "h", "n", "z").select("shard", "id", "n", "z"), count


def unpacked(z: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), dtype=dtype)
