"""Evaluation: per-entity F0.5 and its macro mean, recall of blocking, statistics of gold links."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_counts(ids: DataFrame, gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., s1_id, n_pred, n_gold, n_tp) of every id of ids(s1_id); pairs are sets, so duplicates count once."""
    by = by or []
    g = gold.where("target_id is not null").select("s1_id", "target_id").distinct()
    p = pred.where("target_id is not null").select(*by, "s1_id", "target_id").distinct()
    ng = g.groupBy("s1_id").agg(F.count("*").alias("n_gold"))
    np_ = p.join(g.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left").groupBy(*by, "s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("n_tp"))
    return ids.select(*by, "s1_id").join(ng, "s1_id", "left").join(np_, [*by, "s1_id"], "left").fillna(0, ["n_pred", "n_gold", "n_tp"])


def f05() -> Column:
    """F0.5 of n_pred, n_gold and n_tp: 1 if both sets are empty, 0 if one is or nothing is shared."""
    p, r = F.col("n_tp") / F.col("n_pred"), F.col("n_tp") / F.col("n_gold")
    return F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0).when(F.col("n_tp") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_f05(ids: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    return entity_counts(ids, gold, pred).withColumn("f05", f05())


def macro_f05(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each `by`): mean F0.5, that of singletons and of others, and counts; 0 where there are none."""
    single = F.col("n_gold") == 0
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("f05"))), F.lit(0.0))
    aggs = [mean(F.lit(True)).alias("macro_f05"), mean(single).alias("singleton_accuracy"), mean(~single).alias("non_singleton_f05"),
            F.count("*").alias("n"), F.count(F.when(single, 1)).alias("n_singletons")]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def f_of_means(scored: DataFrame) -> DataFrame:
    """F0.5 of the mean precision and mean recall, which is another number."""
    p = F.avg(F.when(F.col("n_pred") == 0, (F.col("n_gold") == 0).cast("double")).otherwise(F.col("n_tp") / F.col("n_pred")))
    r = F.avg(F.when(F.col("n_gold") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(F.col("n_tp") / F.col("n_gold")))
    return scored.agg(p.alias("p"), r.alias("r")).select("p", "r", F.when(F.col("p") + F.col("r") > 0, 1.25 * F.col("p") * F.col("r") / (0.25 * F.col("p") + F.col("r"))).otherwise(0.0).alias("f05"))


def blocking_recall(counts: DataFrame) -> DataFrame:
    """Of entity_counts over candidates: links, captured links, mean pool, entities found in full and in part."""
    linked = F.col("n_gold") > 0
    return counts.agg(F.sum("n_gold").alias("links"), F.sum("n_tp").alias("captured"), F.avg("n_pred").alias("mean_pool"),
                      F.count(F.when(linked & (F.col("n_tp") == F.col("n_gold")), 1)).alias("full"), F.count(F.when(linked & (F.col("n_tp") > 0) & (F.col("n_tp") < F.col("n_gold")), 1)).alias("part"))


def match_counts(gold: DataFrame) -> DataFrame:
    """(s1_id, n): links of each entity, 0 for singletons."""
    return gold.groupBy("s1_id").agg(F.countDistinct("target_id").alias("n"))


def match_histogram(gold: DataFrame, top: int = 10) -> DataFrame:
    """(matches, entities): entities by their number of links, those above `top` together as top + 1."""
    return match_counts(gold).groupBy(F.least("n", F.lit(top + 1)).alias("matches")).agg(F.count("*").alias("entities"))


def gold_stats(gold: DataFrame, country: DataFrame) -> DataFrame:
    """Overall (country null) and by country: entities, singletons, links, links by source. country: (s1_id, country)."""
    tgt = F.col("target_id")
    per = gold.groupBy("s1_id").agg(F.count("target_id").alias("n"), F.count(F.when(tgt.startswith("S2"), 1)).alias("n2"), F.count(F.when(tgt.startswith("S3"), 1)).alias("n3"))
    j = per.join(country, "s1_id", "left").withColumn("country", F.coalesce("country", F.lit("")))
    g = F.grouping("country")
    return j.rollup("country").agg(g.alias("is_total"), F.count("*").alias("entities"), F.count(F.when(F.col("n") == 0, 1)).alias("singletons"), F.sum("n").alias("links"),
                                   F.sum("n2").alias("links_s2"), F.sum("n3").alias("links_s3"))


def index_percentiles(counts: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99), most: int = 100_000) -> DataFrame:
    """(share, value): the value at place floor(n*share) of the sorted counts(n), from a histogram of distinct values."""
    from pyspark.sql import Window

    hist = counts.groupBy("n").agg(F.count("*").alias("c"))  # as many rows as distinct counts
    run = hist.withColumn("to", F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    at = run.select("*", F.explode(F.array(*(F.lit(s) for s in shares))).alias("share"))
    place = F.floor(F.col("total") * F.col("share"))
    return at.where((F.col("to") > place) & (F.col("to") - F.col("c") <= place)).select("share", F.col("n").alias("value"))
