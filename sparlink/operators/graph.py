"""Groups of linked records, leakage-safe folds, leakage checks."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that executors share; a local one only where none is set and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sparlink-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a round's result survives the loss of executors, and lineage ends."""
    path = shared_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none itself: then no round changes anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges(a, b) with the smallest node it reaches.

    Alternating stars: larger neighbours, then smaller ones, are linked to the smallest neighbour until all edges are stars
    around a smallest node; a path of n nodes takes about log n rounds.
    """
    norm = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    loops = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = written(norm(edges))
    while not _are_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = written(norm(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        now = written(norm(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))))
    return loops.join(now.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def assign_folds(components: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(component, fold) of components(component, size): greatest first, each size class dealt in turn by a hash.

    Within a size class components go round the folds, starting where the class before ended, so fold sizes differ by the
    greatest component at most for a class. The running start is over size classes only; ranks within a class
    come from a count by hash bucket, so no task sorts all components.
    """
    b = components.withColumn("bucket", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(4096)))
    per = b.groupBy("size", "bucket").agg(F.count("*").alias("c"))
    start = F.sum("c").over(Window.orderBy(F.desc("size"), "bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("start", F.coalesce(start, F.lit(0))).drop("c")  # 4096 rows for each size at most
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(F.xxhash64("component", F.lit(seed)), "component"))
    out = b.withColumn("rn", rank).join(per, ["size", "bucket"])
    return out.select("component", ((F.col("start") + F.col("rn") - 1) % k).cast("int").alias("fold"))


def fold_leakage(gold: DataFrame, folds: DataFrame) -> DataFrame:
    """(target_id, folds): targets linked from more than one fold."""
    return gold.where("target_id is not null").join(folds, "s1_id").groupBy("target_id").agg(F.countDistinct("fold").alias("folds")).where("folds > 1")
