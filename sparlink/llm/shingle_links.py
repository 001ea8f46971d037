"""SimHash near-dedup at a Jaccard similarity of word shingles, for the pipeline's stage: tiles of fingerprints, exact sets.

Texts of the same words are one node, with a SimHash of its distinct shingles. All fingerprints of the table are compared
at a radius of 3 by op10's tiles, skipped by population counts. For what lies further apart: a radius that catches a similarity of 0.8
(about ten of 64 bits differ) skips no tile by population counts, so cells are dealt by bands of MinHash values instead:
at 0.8 a pair shares none of 32 bands of 6 values with probability 6e-5, above it more seldom. Within a cell every pair
of fingerprints is compared by exclusive-or and bit counts, and what lies within the radius by its whole shingle sets.
The pairs of a cell with its smallest node come first; what they leave apart is compared tile by tile, within one task
for each pair of tiles, which gives a spanning forest of its links. So no group gives all its pairs as rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_runs, bounded_batches, no_collector, slices, trimmed, written
from .simhash import SALTS, components, links

#: Bands of a text, MinHash values of a band.
BANDS, ROWS = 32, 6
#: Differing bits of fingerprints at which sets are still compared. At a similarity of 0.8 the share of differing bits is
#: 0.15 (9.7 bits, deviation 2.9); of sets of four and five shingles it is 0.19 (12 bits, deviation 3.1).
RADIUS = 26
#: Differing bits at which all fingerprints of the table are compared, as op10 compares them.
CLOSE = 3
#: Texts in a tile of a cell.
TILE = 256
#: Pairs of one node from which its text is salted; node or row keys that are broadcast at most (about 24 MB).
HOT, MOST_SENT = 256, 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' word shingles (with repeats), their number by text, and a hash of each text's words.
    A text of fewer words has one shingle, all its words; a text without words has none."""
    with no_collector():
        at, values, n = ascii_runs(texts)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, values), "<u8", len(values))[at]
    ends = np.cumsum(n)
    node = np.fromiter((xxhash.xxh3_64_intdigest(words[e - k : e].tobytes()) for e, k in zip(ends, n)), "<u8", len(n))
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    total = int(count.sum())
    first = np.repeat(ends - n, count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(np.minimum(n, size), count)
    out = np.zeros(total, "<u8")
    for i in range(size):
        use = left > i
        step = _mix(out * _P + words[np.minimum(first + i, len(words) - 1)]) if total else out
        out = step if use.all() else np.where(use, step, out)
    return out, count, node


def distinct_shingles(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, increasing, end to end, and their number by text."""
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.bincount(t[new], minlength=len(count))


def set_fingerprints(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is set if over half of its hashes have it; of an empty set 0."""
    out = np.zeros(len(count), "<u8")
    some = np.flatnonzero(count)
    ends, at = np.cumsum(count[some]), 0
    while at < len(some):  # bounded numbers of bits at once
        begin = int(ends[at] - count[some[at]])
        to = max(at + 1, int(np.searchsorted(ends, begin + (1 << 16), side="right")))
        own = count[some[at:to]]
        bits = np.unpackbits(np.ascontiguousarray(sets[begin : ends[to - 1]]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(own) - own, axis=0, dtype=np.int32)
        out[some[at:to]] = np.packbits(ones * 2 > own[:, None], axis=1, bitorder="little").view("<u8").ravel()
        at = to
    return out


def bands(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of each text's bands; every text has a shingle at least."""
    out = np.empty((len(count), BANDS), "<u8")
    start, at = np.cumsum(count) - count, 0
    while at < len(count):  # runs of texts that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(start, start[at] + 32768)))
        h, s = hashes[start[at] : start[to - 1] + count[to - 1]], start[at:to] - start[at]
        for b in range(BANDS):
            key = np.full(to - at, b + 1, "<u8")
            for m in _MUL[b * ROWS : (b + 1) * ROWS]:
                key = _mix(key * _P + np.minimum.reduceat(h * m, s))
            out[at:to, b] = key
        at = to
    return out


def tagged(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """A written table of df's columns as the struct `row`, with rid (a number of the row), node, fp and bands."""
    where, whole = df.columns.index(text_col), bounded_batches(df).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column(0), where).cast(pa.string()), "")
            for b in slices(pa.RecordBatch.from_arrays([texts, pa.array(np.arange(batch.num_rows))], names=["text", "at"]), 1 << 20):
                hashes, count, node = shingles(b.column(0), size)
                sets, sizes = distinct_shingles(hashes, count)
                some = count > 0
                keys = bands(sets, sizes[some]).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * BANDS]), pa.int32()), pa.array(keys))
                rows = batch.column(0).slice(b.column(1)[0].as_py(), b.num_rows)
                yield pa.RecordBatch.from_arrays([rows, pa.array(node.view(np.int64)), pa.array(set_fingerprints(sets, sizes).view(np.int64)), lists], names=["row", "node", "fp", "bands"])

    kind = whole.schema["row"].dataType.simpleString()
    got = whole.mapInArrow(lambda x: trimmed(run(x)), f"row {kind}, node long, fp long, bands array<long>")
    return written(got.withColumn("rid", F.monotonically_increasing_id()), "tagged")


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, increasing; equal texts are taken apart once."""
    d = texts.dictionary_encode()
    hashes, count, _ = shingles(d.dictionary, size)
    flat, sizes = distinct_shingles(hashes, count)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    return [own[i] for i in d.indices.to_pylist()]


def jaccard(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Of a set (sorted distinct values) with each of others."""
    n = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    if not len(one) or not len(flat):
        return np.zeros(len(others))
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    ends = np.cumsum(n)
    both = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])
    return both / (n + len(one) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of `least` or more. texts: (node, text)."""
    uses = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("n"))
    hot = F.broadcast(written(uses.where(F.col("n") > HOT).select(F.col("node").alias("h")), "hot"))  # one in HOT pairs at most
    spread = texts.join(hot, texts["node"] == hot["h"], "left")
    salts = F.when(F.col("h").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = spread.select("node", "text", F.explode(salts).alias("salt"))

    def with_text(p: DataFrame, mine: str, other: str) -> DataFrame:
        salt = F.when(F.col("h").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)
        p = p.join(hot, p[mine] == hot["h"], "left").withColumn("salt", salt).drop("h")
        return p.join(spread.select(F.col("node").alias(mine), F.col("text").alias(f"text_{mine}"), "salt"), [mine, "salt"]).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1 << 20):
                ok = pa.array([bool(jaccard(x, [y])[0] >= least) for x, y in zip(sets_of(b.column(2), size), sets_of(b.column(3), size))], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    both = with_text(with_text(pairs, "a", "b"), "b", "a").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(lambda x: trimmed(run(x)), "a long, b long"), "confirmed")


def tile_forest(fps: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, tile: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of a cell, or within the one that there is, as places (i, j).

    Pairs of one root are joined already. Rows of a tile stand in the order of their bits' number; those whose numbers
    differ beyond the radius aren't compared.
    """
    first = np.flatnonzero(tile == tile.min())
    other = np.flatnonzero(tile != tile.min())
    alone = not len(other)
    other = first if alone else other
    ones = np.bitwise_count(fps).astype(np.int64)
    other = other[np.argsort(ones[other], kind="stable")]
    lab = np.unique(roots, return_inverse=True)[1]  # rows of one root start joined
    out: list[tuple[int, int]] = []
    for i in first:
        lo, hi = np.searchsorted(ones[other], [ones[i] - RADIUS, ones[i] + RADIUS + 1])
        js = other[lo:hi]
        js = js[(np.bitwise_count(fps[js] ^ fps[i]) <= RADIUS) & (lab[js] != lab[i])]
        if alone:
            js = js[js > i]
        if len(js):
            js = js[jaccard(sets[i], [sets[j] for j in js]) >= least]
            joined, at = np.unique(lab[js], return_index=True)
            out += [(i, int(j)) for j in js[at]]
            if len(joined):
                lab[np.isin(lab, joined)] = lab[i]
    return np.array([i for i, _ in out], np.int64), np.array([j for _, j in out], np.int64)


def apart_links(known: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): links among what the hubs left apart. known: (band, node, fp, root, far), all members of the cells but
    their hubs; far: not in the hub's component. Rows of the hub's component are compared with far ones only.

    A cell's far rows and its others are cut into tiles of about TILE texts by a hash of the node; a task has two tiles.
    Cells of the same members are compared once.
    """
    cells = known.groupBy("band").agg(F.count(F.when(F.col("far"), 1)).alias("n_far"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("who2"))
    cells = cells.where("n_far > 0 and n > 1").groupBy("n", "n_far", "who", "who2").agg(F.min("band").alias("band"))
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    cells = cells.withColumn("n_near", F.col("n") - F.col("n_far")).select("band", tiles("n_far").alias("t_far"), tiles("n_near").alias("t_near"))
    cells = written(cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "cells")
    mine = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(cells.hint("merge"), ["band", "salt"])
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("far"), F.col("t_far")).otherwise(F.col("t_near"))).cast("int")
    mine = mine.withColumn("tile", F.when(F.col("far"), own).otherwise(F.col("t_far") + own))
    partners = F.sequence(F.lit(0), F.when(F.col("far"), F.col("t_far") + F.col("t_near")).otherwise(F.col("t_far")) - 1)
    jobs = mine.select("band", "node", "fp", "root", "tile", F.explode(partners).alias("p"))
    jobs = jobs.select("band", F.least("tile", "p").alias("lo"), F.greatest("tile", "p").alias("hi"), "node", "fp", "root", "tile").join(texts, "node")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        node, fps, roots, tile = (t.column(c).to_numpy() for c in ("node", "fp", "root", "tile"))
        text = pa.chunked_array(t.column("text").chunks, pa.string()).combine_chunks()
        i, j = tile_forest(fps.view(np.uint64), sets_of(text, size), roots, tile, least)
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return jobs.groupBy("band", "lo", "hi").applyInArrow(compare, "a long, b long")


def close_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints differ in at most CLOSE bits, enough to join all such nodes. All fingerprints of the
    table are compared by op10's tiles, whatever cells their texts are in; nodes of one fingerprint meet its smallest."""
    nodes = written(rows.where(F.size("bands") > 0).select("node", "fp").distinct(), "nodes")
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fps")
    of = lambda end, name: fps.select(F.col("fp").alias(end), F.col("first").alias(name))
    far = links(rows.sparkSession, fps.select("fp"), fps.count(), CLOSE).toDF("x", "y").join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b")
    salted = fps.where("n > 1").select("fp", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["fp", "salt"])
    return written(far.union(mine.where("node <> first").select("node", "first")), "close")


def similar_groups(rows: DataFrame, text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of every node of a tagged table that reaches a smaller one by links; root is the smallest one it reaches."""
    banded = written(rows.select("node", "fp", F.explode("bands").alias("band")).distinct(), "bands")
    # The smallest node of a cell is its hub; cells of one node hold no candidates.
    cells = banded.groupBy("band").agg(F.min(F.struct("node", "fp")).alias("h"), F.count("*").alias("n")).where("n > 1").select("band", F.col("h.node").alias("hub"), F.col("h.fp").alias("hub_fp"))
    salted = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = banded.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["band", "salt"]).select("band", "hub", "hub_fp", "node", "fp")
    members = written(members, "members")
    tiled = close_pairs(rows)
    used = members.select(F.col("node").alias("used")).union(tiled.select("a")).union(tiled.select("b")).distinct()
    first = rows.groupBy("node").agg(F.min("rid").alias("rid")).join(used, F.col("node") == F.col("used"), "left_semi").select(F.col("rid").alias("one"))
    first = written(first, "first")
    one = F.broadcast(first) if first.count() <= MOST_SENT else first
    texts = rows.join(one, rows["rid"] == one["one"], "left_semi").select("node", F.col(f"row.`{text_col}`").cast("string").alias("text"))
    texts = written(texts, "texts")
    close = (F.col("node") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= RADIUS)
    pairs = members.where(close).select(F.col("node").alias("a"), F.col("hub").alias("b")).union(tiled)
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    near = confirmed(pairs, texts, size, least)
    roots = components(near)
    # What the hubs have not joined: members apart from their hub's component, against all others of the cell.
    by_node = roots.select(F.col("node").alias("node"), "root")
    by_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    known = members.where("node <> hub").join(by_node, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hubs = members.select("hub").distinct().join(by_hub, "hub", "left").select("hub", F.coalesce("hub_root", "hub").alias("hub_root"))
    known = written(known.join(hubs, "hub").select("band", "node", "fp", "root", (F.col("root") != F.col("hub_root")).alias("far")), "known")
    if not known.where("far").limit(1).count():
        return roots
    return components(near.union(written(apart_links(known, texts, size, least), "apart")))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """df without the rows that are not their group's chosen one: the smallest id (nulls last), then the first row.

    A group is what links of a Jaccard similarity of `least` or more join, over distinct shingles of `size` words
    (separated by white space, A-Z lower-cased; a shorter text is one shingle). Texts without words are one group. Rows
    go or stay by themselves, whatever other rows have their id.
    """
    rows = tagged(df, text_col, size)
    roots = similar_groups(rows, text_col, size, least)
    roots = roots.union(roots.select("root", "root").distinct())
    best = F.min(F.struct(F.col(f"row.`{id_col}`").isNull().alias("none"), F.col(f"row.`{id_col}`").alias("id"), "rid")).alias("best")
    nodes = written(rows.groupBy("node").agg(best, F.count("*").alias("n")), "nodes")
    known = nodes.join(roots, "node", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    known = written(known, "known")
    stays = known.groupBy("root").agg(F.min("best").alias("b")).select("root", F.col("b.rid").alias("stays"))
    shared = known.join(stays, "root").select("node", "stays", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = rows.select("node", "rid", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = written(mine.join(shared.hint("merge"), ["node", "salt"]).where("rid <> stays").select(F.col("rid").alias("gone")), "gone")
    if gone.count() <= MOST_SENT:  # so that texts stay where they are; beyond it both sides are shuffled
        gone = F.broadcast(gone)
    return rows.join(gone, rows["rid"] == gone["gone"], "left_anti").select("row.*")
