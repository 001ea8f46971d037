"""From scored pairs to matches: every target has one owner; weak lone matches go."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owners(scored: DataFrame, order: tuple[str, ...] = ("score", "nm", "pm", "a_sim"), first: str = "s_ord") -> DataFrame:
    """The best pair of every target by the columns in order (greatest first), the earliest query on ties.

    An aggregate with partial results, not a window: a target that a third of all pairs claim sends a row for each task.
    """
    best = F.max_by(F.struct(*scored.columns), F.struct(*order, (-F.col(first)).alias("_first"))).alias("x")
    return scored.groupBy("target_id").agg(best).select("x.*")


def with_count(owned: DataFrame) -> DataFrame:
    """n: how many targets the query of a pair owns."""
    return owned.withColumn("n", F.count("*").over(Window.partitionBy("s1_id")))


def gate(owned: DataFrame, kind: str, score: float, address: float) -> DataFrame:
    """Removes a query's only match where it is weak.

    lone: below both limits. signals: also below 0.84 with fewer than two of (pm, nm, a_sim >= 0.65), or a short core below
    0.87 likewise, if the score is below 0.90. blank_address: below both limits, or a blank target address below 0.95.
    short: fewer than two of those signs, and below the score limit or a core of fewer than five letters. The other kinds
    look at all links of a query. blank_targets: all targets lack an address though the query has one and its core is one
    word of fewer than 18 letters (both told by the column s_short); after that as lone. fuzzy_only: no score above the
    limit and no address similarity of the other limit or more.
    """
    c = F.col
    w = with_count(owned)
    few = c("pm").cast("int") + c("nm").cast("int") + (c("a_sim") >= 0.65).cast("int") < 2
    weak = {
        "none": F.lit(False), "lone": (c("score") < score) & (c("a_sim") < address),
        "signals": (c("score") < 0.90) & few & ((c("score") < 0.84) | (c("core_len") < 5) & (c("score") < 0.87)),
        "blank_address": (c("score") < score) & (c("a_sim") < address) | c("t_blank") & (c("score") < 0.95),
        "short": few & ((c("score") < score) | (c("core_len") < 5)),
    }
    own = Window.partitionBy("s1_id")
    if kind == "blank_targets":
        w = w.withColumn("_blank", F.min("t_blank").over(own)).where(~(c("_blank") & c("s_short"))).drop("_blank")
        return w.where(~((c("n") == 1) & weak["lone"])).drop("n")
    if kind == "fuzzy_only":
        w = w.withColumn("_best", F.max("score").over(own)).withColumn("_near", F.max("a_sim").over(own))
        return w.where(~((c("_best") <= score) & (c("_near") < address))).drop("n", "_best", "_near")
    weak = weak[kind]
    return w.where(~((c("n") == 1) & weak)).drop("n")


def gate_by_probability(owned: DataFrame, least: float, score: str = "prob") -> DataFrame:
    """Removes a query's only match below a probability."""
    return with_count(owned).where(~((F.col("n") == 1) & (F.col(score) < least))).drop("n")


def confident(links: DataFrame, least: float, low: float = 0.35, score: str = "prob", sign: Column | None = None) -> DataFrame:
    """Links of queries whose best score reaches `least`, or reaches `low` with a sign (equal number or core) on the best link."""
    sign = F.col("nm") if sign is None else sign
    best = links.groupBy("s1_id").agg(F.max(score).alias("_p"), F.max_by(sign, F.struct(F.col(score), F.col("target_id"))).alias("_sign"))
    ok = best.where((F.col("_p") >= least) | (F.col("_p") >= low) & F.col("_sign")).select("s1_id")
    return links.join(ok, "s1_id", "left_semi")


def ensemble(rule_links: DataFrame, model_links: DataFrame, tau: float) -> DataFrame:
    """Rule links at 0.90 + 0.05 * score and model links at their probability of tau or more with a sign, one owner each."""
    rules = rule_links.select("s1_id", "target_id", (0.90 + 0.05 * F.col("score")).alias("weight"), "s_ord")
    model = model_links.where((F.col("prob") >= tau) & F.col("sign")).select("s1_id", "target_id", F.col("prob").alias("weight"), "s_ord")
    return owners(rules.unionByName(model), ("weight",))
