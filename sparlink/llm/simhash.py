"""Operator 10: SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into cells by the population counts of their bytes and cut into tiles of bounded size.
Two fingerprints within a radius have byte counts that differ by no more than it in sum, so tile pairs further apart are
skipped, between cells as within them; the others are compared whole with numpy's exclusive-or and bit counts. A tile
pair gives a spanning forest of its links only, so large groups of near copies don't give all their pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, slices, trimmed, written

#: Fingerprints in a tile that is sent as a whole, and in the inner tiles that are compared as matrices.
TILE, INNER = 1 << 16, 512
#: Copies of each row of the smaller side where a join's key may be hot.
SALTS = 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as a signed 64-bit integer: a bit is set if over half of the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        got = [h(b" ".join(words), seed)]
    elif shingle == 3:
        got = [h(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])]
    else:
        got = [h(b" ".join(words[i : i + shingle]), seed) for i in range(len(words) - shingle + 1)]
    a = np.array(got, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(a), 4096):
        bits = np.unpackbits(a[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(a), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every whole text; a null text or one without words has 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1 << 20):
                fps = [fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return bounded_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(lambda x: trimmed(run(x)), f"id {kind}, fp long")


def groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links i-j."""
    lab = np.arange(n)
    while True:
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            return lab
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt


def _inner_tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints ordered by their bytes' population counts, and each inner tile's least and greatest counts."""
    counts = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    fps, counts = fps[order], counts[order]
    cut = np.arange(0, len(fps), INNER)
    return fps, np.minimum.reduceat(counts, cut), np.maximum.reduceat(counts, cut)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at `radius` or fewer differing bits within a (b None) or between a and b, as (fp, fp)."""
    fa, lo_a, hi_a = _inner_tiles(a)
    fb, lo_b, hi_b = (fa, lo_a, hi_a) if b is None else _inner_tiles(b)
    nodes = fa if b is None else np.concatenate([fa, fb])
    shift = 0 if b is None else len(fa)
    lab = np.arange(len(nodes))
    for p in range(len(lo_a)):
        gap = np.maximum(lo_b - hi_a[p], 0) + np.maximum(lo_a[p] - hi_b, 0)
        near = np.flatnonzero(gap.sum(axis=1) <= radius)
        x = fa[p * INNER : (p + 1) * INNER]
        own = slice(p * INNER, p * INNER + len(x))
        for q in near[near >= p] if b is None else near:
            y = fb[q * INNER : (q + 1) * INNER]
            other = slice(shift + q * INNER, shift + q * INNER + len(y))
            if lab[own.start] == lab[other.start] and (lab[own] == lab[own.start]).all() and (lab[other] == lab[own.start]).all():
                continue  # all joined already
            hit = np.flatnonzero(np.bitwise_count(x[:, None] ^ y[None, :]).ravel() <= radius)
            if b is None and p == q and len(hit) == len(x):
                continue  # each meets itself only
            if len(hit):
                i, j = own.start + hit // len(y), other.start + hit % len(y)
                la, lb = lab[i], lab[j]
                if (la != lb).any():
                    lab = lab[groups(len(nodes), *_roots(lab, la, lb))]
    far = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[far], nodes[lab[far]]


def _roots(lab: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([np.minimum(la, lb), np.maximum(la, lb)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(spark: SparkSession, distinct: DataFrame, count: int, radius: int) -> DataFrame:
    """(a, b): links that join the distinct fingerprints (column fp) within the radius as all their links would.

    The driver gets a row for each cell, 6561 at most; the pairs of tiles are worked out by tasks.
    """
    depth = next(d for d in range(9) if 3**d * TILE // 2 >= count or d == 8)
    digit = [F.bit_count(F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255))) for i in range(depth)]
    digit = [F.when(d <= 3, 0).when(d == 4, 1).otherwise(2) for d in digit]  # counts of 3 and less, of 4, of 5 and more
    code = sum((d * 3**i for i, d in enumerate(digit)), F.lit(0))
    dealt = distinct.select("fp", code.cast("int").alias("cell"))
    sizes = sorted(tuple(r) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return spark.createDataFrame([], "a long, b long")
    codes = np.array([c for c, _ in sizes])
    parts = np.array([-(-n // TILE) for _, n in sizes])
    first = np.cumsum(parts) - parts  # the number of each cell's first tile
    cells = F.broadcast(spark.createDataFrame([(int(c), int(f), int(n)) for c, f, n in zip(codes, first, parts)], "cell int, first long, parts long"))
    placed = dealt.join(cells, "cell").select((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("tile"), "fp")
    tiles = placed.groupBy("tile").agg(F.collect_list("fp").alias("fps"))
    digits = np.stack([codes // 3**i % 3 for i in range(depth)], axis=1) if depth else np.zeros((len(codes), 0), np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each tile its pairs with itself and with later ones, in a row for each tile of a pair."""
        for b in batches:
            for t in b.column(0).to_pylist():
                c = int(np.searchsorted(first, t, side="right")) - 1
                near = np.flatnonzero(np.abs(digits - digits[c]).sum(axis=1) <= radius)
                for e in near[near >= c]:
                    others = np.arange(max(t, int(first[e])), int(first[e] + parts[e]))
                    both = others[others != t]
                    lo, hi = np.full(len(others) + len(both), t), np.concatenate([others, both])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lo, hi, np.concatenate([np.full(len(others), t), both]))], names=["lo", "hi", "tile"])

    total = int(parts.sum())
    uses = spark.range(0, total, 1, max(1, min(total, partitions(spark)))).mapInArrow(pairs, "lo long, hi long, tile long")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x.values.to_numpy().view(np.uint64) for b in batches for x in b.column("fps")]
        a, b = tile_links(got[0], got[1] if len(got) > 1 else None, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    # Every pair has its own tile at least; a tile without fingerprints (none fell to it) has no row.
    return tiles.join(uses, "tile").select("lo", "hi", "fps").groupBy("lo", "hi").applyInArrow(compare, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none itself: then no round changes anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: root is the smallest node it reaches. edges: (a, b) of longs.

    Alternating stars: every node links its larger neighbours, then its smaller ones, to its smallest neighbour, until
    all edges are stars around a smallest node. Each round is a written table, so no lineage grows and a lost executor costs one round at most.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        # larger neighbours to the smallest one
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large")
        # itself and its smaller neighbours to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row for each input row: (id, fp, component_id), component_id being the smallest id that it reaches.

    Lower-cases A-Z, takes words between white space and their shingles with repeats; texts without words (null, empty)
    have fingerprint 0 and are linked like any other. Rows with a null id have a component only by others' ids; if a whole
    component has none, it is null. Repeated ids and rows each give their row. Other columns are not read.
    """
    spark = df.sparkSession
    docs = written(fingerprints(df, id_col, text_col, shingle, seed), "simhash")
    nodes = written(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(spark, nodes.select("fp"), nodes.count(), radius))
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = known.join(least, "root").select("fp", "n", "component_id", "least")
    # Only fingerprints of several rows or with links need the join; a hot one is spread over salts.
    shared = written(labels.where("n > 1 or not (component_id <=> least)").select("fp", "component_id"), "labels")
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = docs.select("*", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = mine.join(shared.hint("merge"), ["fp", "salt"], "left")
    # A row that found no label is alone: its fingerprint has one row and no link.
    return out.select(F.col("id").alias(id_col), "fp", F.coalesce("component_id", "id").alias("component_id"))
