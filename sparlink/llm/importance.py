"""Operator 3: a quality classifier by importance resampling.

Two generative models over hashed n-grams (words, marks and their pairs), one of target documents and one of all raw
documents, give each document the log ratio of its probabilities. k documents are drawn without replacement in
proportion to that ratio by the Gumbel top-k trick: the k greatest of log ratio plus Gumbel noise.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_runs, bounded_batches, no_collector, slices, trimmed, written

#: Hash buckets of the models; labelled documents that are used at most; folds for figures that labels didn't teach.
N_BUCKETS, MOST_LABELS, FOLDS = 1 << 20, 50_000, 5
#: Buckets that are summed as one slice.
SLICE = 1 << 14
_PART = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+")


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all texts' words, marks and pairs of neighbours, and the number of each text's; a text's single
    features come first, then its pairs. Each distinct run of a batch is taken apart once."""
    with no_collector():
        at, values, n = ascii_runs(texts)
        h = xxhash.xxh3_64_intdigest
        own = [[h(p) for p in _PART.findall(v)] for v in values]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), "<u8", int(size.sum()))
    first = np.cumsum(size) - size
    # Runs to parts: of each run in the texts the parts that its value has.
    per = size[at]
    ends = np.cumsum(per)
    parts = flat[np.repeat(first[at] - (ends - per), per) + np.arange(int(per.sum()))]
    text_ends = np.concatenate([[0], ends])[np.cumsum(n)]
    singles = np.diff(np.concatenate([[0], text_ends]))
    pair = parts[:-1] * np.uint64(0x9E3779B97F4A7C15) + (parts[1:] ^ (parts[1:] >> np.uint64(31)))
    pair ^= pair >> np.uint64(33)
    within = np.ones(len(parts), dtype=bool)  # a pair doesn't reach over a text's end
    within[text_ends[singles > 0] - 1] = False
    pairs = np.maximum(singles - 1, 0)
    total = singles + pairs
    out = np.empty(int(total.sum()), "<u8")
    start = np.cumsum(total) - total
    out[np.repeat(start - (np.cumsum(singles) - singles), singles) + np.arange(len(parts))] = parts
    out[np.repeat(start + singles - (np.cumsum(pairs) - pairs), pairs) + np.arange(int(pairs.sum()))] = pair[within[:-1]] if len(parts) else pair
    return (out % np.uint64(buckets)).astype(np.int64), total


def bucket_counts(texts: DataFrame, buckets: int, groups: int = 1) -> np.ndarray:
    """(groups, buckets) counts over all rows of texts(text string[, group int]): as many numbers, whatever the corpus.

    Tasks count whole arrays, which are summed by slices, first those of a 64th of the tasks each.
    """
    schema = "slice int, part int, n binary"

    def rows(part: int, numbers: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, x in numbers.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1)])], names=["slice", "part", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets * groups, dtype=np.int64)
        for batch in batches:
            for b in slices(batch):
                at, n = features(b.column(0), buckets)
                if groups > 1:
                    at = at + np.repeat(b.column(1).to_numpy().astype(np.int64) * buckets, n)
                total += np.bincount(at, minlength=len(total))
        yield from rows(TaskContext.get().partitionId() % 64, {k: x for k in range(-(-len(total) // SLICE)) if (x := total[k * SLICE : (k + 1) * SLICE]).any()})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for b in batches:
            for x in b.column("n"):
                total = total + np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        yield from rows(0, {key[0].as_py(): total})

    out = np.zeros(buckets * groups, dtype=np.int64)
    made = texts.mapInArrow(lambda x: trimmed(run(x)), schema).groupBy("slice", "part").applyInArrow(merge, schema).groupBy("slice").applyInArrow(merge, schema)
    for r in made.collect():
        x = np.frombuffer(zlib.decompress(bytes(r.n)), "<i8")
        out[r.slice * SLICE : r.slice * SLICE + len(x)] = x
    return out.reshape(groups, buckets)


class Table:
    """Log ratios by bucket; only those that aren't 0 are kept and sent."""

    def __init__(self, values: np.ndarray):
        self.size, self.at = len(values), np.flatnonzero(values)
        self.values = values[self.at]

    def dense(self) -> np.ndarray:
        out = np.zeros(self.size)
        out[self.at] = self.values
        return out


def weights_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of its features and the sum of their log ratios; equal texts have equal sums."""
    at, n = features(texts, len(table))
    out = np.zeros(len(n))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(table[at], (np.cumsum(n) - n)[some])
    return n, out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = 2.0, sure: float = 4.0) -> np.ndarray:
    """By bucket the log ratio of the models, as if the target had shown `prior` more of each bucket's features than it
    did and than the raw model expects. A bucket whose count lies within `sure` deviations of the expected one tells
    nothing and has ratio 0, so that the many rare features don't drown the few that tell."""
    expected = raw / max(raw.sum(), 1) * target.sum()
    return np.where(np.abs(target - expected) > sure * np.sqrt(expected + 1), np.log((target + prior) / (expected + prior)), 0.0)


def gumbel(*by: Column, seed: int = 7) -> Column:
    """Gumbel noise that depends on the given columns only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_greatest(keys: DataFrame, k: int) -> float:
    """The k-th greatest of keys(key double), exact: histograms of 4096 bins zoom in on it; the driver gets those only."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    inside, left = keys, k
    while lo < hi:
        width = (hi - lo) / 4096
        if not width or lo + width == lo:
            break
        bin_ = F.least(F.floor((F.col("key") - lo) / width), F.lit(4095)).cast("int")
        got = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in got:
            if left <= r.n:
                break
            left -= r.n
        if left == 1 and r.n >= 1:
            return r.hi
        if left == r.n:
            return r.lo
        inside = inside.where(F.col("key").between(r.lo, r.hi))
        lo, hi = r.lo, r.hi
    return hi


def dividing(good: np.ndarray, bad: np.ndarray) -> float:
    """The value that best divides two classes' scores (greatest sum of rates right), midway between its neighbours."""
    if not len(good) or not len(bad):
        return float("-inf")
    x = np.concatenate([good, bad])
    y = np.concatenate([np.full(len(good), 1 / len(good)), np.full(len(bad), -1 / len(bad))])
    order = np.argsort(x, kind="stable")
    x, above = x[order], y.sum() - np.concatenate([[0], np.cumsum(y[order])])
    ok = np.concatenate([[True], x[1:] > x[:-1], [True]])
    i = int(np.argmax(np.where(ok, above, -np.inf)))
    return float("-inf") if i == 0 else float("inf") if i == len(x) else float((x[i - 1] + x[i]) / 2)


def labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labels: int) -> DataFrame:
    """(text, target, fold): one row for each of at most most_labels labelled ids that df has, the smallest by a hash of
    the id; of an id's several rows or labels the smallest (text, target)."""
    chosen = labels.toDF("id", "target").where("id is not null and target is not null").groupBy("id").agg(F.min("target").alias("target")).orderBy(F.xxhash64("id"), "id").limit(most_labels)
    chosen = F.broadcast(written(chosen, "labels"))  # most_labels rows at most
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(chosen, "id")
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "target")).alias("x"))
    return written(rows.select("x.text", "x.target", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")


def out_of_fold(sample: DataFrame, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log ratios learned from all labelled targets, and the targets' and the others' log ratios, each by a
    table that its own fold didn't teach. The driver gets a number for each labelled document."""
    buckets = len(raw)
    by_fold = bucket_counts(sample.where("target").select("text", "fold"), buckets, FOLDS)
    target = by_fold.sum(axis=0)
    if not target.any():
        return np.zeros(buckets), np.empty(0), np.empty(0)
    sent = [Table(log_ratios(target - x, raw)) for x in by_fold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [x.dense() for x in sent]
        for batch in batches:
            for b in slices(batch):
                fold, w = b.column(2).to_numpy(), np.zeros(b.num_rows)
                for k in np.unique(fold):
                    own = np.flatnonzero(fold == k)
                    w[own] = weights_of(b.column(0).take(pa.array(own)), tables[k])[1]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(w)], names=["target", "w"])

    got = sample.select("text", "target", "fold").mapInArrow(lambda x: trimmed(run(x)), "target boolean, w double").toPandas()
    return log_ratios(target, raw), np.sort(got.w[got.target].to_numpy()), np.sort(got.w[~got.target].to_numpy())


def cut_of(good: np.ndarray, bad: np.ndarray, spare: float) -> float:
    """The value that best divides the two, lowered until no more than a share `spare` of the good lies below."""
    cut = dividing(good, bad)
    return min(cut, float(np.nextafter(good[int(spare * len(good))], -np.inf))) if len(good) else cut


def held_out_figures(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = N_BUCKETS, most_labels: int = MOST_LABELS, spare: float = 0.002) -> dict[str, float]:
    """The ROC area, the cut and the shares of targets kept and others dropped, of labelled documents that their model
    didn't learn from."""
    texts = bounded_batches(df).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    _, good, bad = out_of_fold(labelled(df, labels, id_col, text_col, most_labels), bucket_counts(texts, buckets)[0])
    cut = cut_of(good, bad, spare)
    below = (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")) / 2
    return {"targets": len(good), "others": len(bad), "cut": cut, "roc_area": float(below.mean() / len(bad)) if len(good) and len(bad) else float("nan"),
            "targets_kept": float((good > cut).mean()) if len(good) else float("nan"), "others_dropped": float((bad <= cut).mean()) if len(bad) else float("nan")}


def importance_resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, buckets: int = N_BUCKETS,
                        most_labels: int = MOST_LABELS, seed: int = 7, spare: float = 0.002) -> DataFrame:
    """df's columns as they are, as the struct `row`, with n_features, log_weight, key and kept.

    labels: (id, target boolean); at most most_labels ids are used, the smallest by a hash of the id. The target model
    counts the labelled targets (an id counts once), the raw model every row of df. kept marks the k greatest keys (ties
    with the k-th are kept). k None: as many as have a log ratio above the value that best divides labelled targets from
    the others, lowered until no more than a share `spare` of the targets lies below; both are judged by models of the
    other folds. Null or empty texts have log ratio 0; null ids are never labelled; repeated rows count each and share
    their noise; without labelled targets all are kept; an empty table stays empty.
    """
    whole = bounded_batches(df).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    raw = bucket_counts(whole.select(F.col(f"row.`{text_col}`").cast("string").alias("text")), buckets)[0]
    table, good, bad = out_of_fold(labelled(df, labels, id_col, text_col, most_labels), raw)
    where, sent = df.columns.index(text_col), Table(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.dense()
        for batch in batches:
            for b in slices(batch):
                n, w = weights_of(pc.struct_field(b.column(0), where).cast(pa.string()), table)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(w)], names=[b.schema.names[0], "n_features", "log_weight"])

    kind = whole.schema["row"].dataType.simpleString()
    scored = whole.mapInArrow(lambda x: trimmed(score(x)), f"row {kind}, n_features long, log_weight double")
    scored = written(scored.withColumn("key", F.col("log_weight") + gumbel(F.col(f"row.`{id_col}`"), seed=seed)), "weights")
    if k is None:
        k = scored.where(F.col("log_weight") > cut_of(good, bad, spare)).count()
    least = kth_greatest(scored.select("key"), k)
    return scored.withColumn("kept", F.col("key") >= least)
