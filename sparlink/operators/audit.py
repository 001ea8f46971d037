"""Audits of gold links, blocking gaps and results, and the validator of result files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from .blocking import route_keys


def exclusivity(gold: DataFrame) -> DataFrame:
    """(target_id, owners): targets with more than one query."""
    return gold.where("target_id is not null").groupBy("target_id").agg(F.countDistinct("s1_id").alias("owners")).where("owners > 1")


def address_presence(pairs: DataFrame) -> DataFrame:
    """(has_s, has_t, n) over gold pairs with records."""
    return pairs.groupBy((F.col("s_clean_addr") != "").alias("has_s"), (F.col("t_clean_addr") != "").alias("has_t")).agg(F.count("*").alias("n"))


def conflict_matrix(pairs: DataFrame) -> DataFrame:
    """Of gold pairs with all four values: pairs, with both, number and postal conflicts."""
    c = F.col
    full = pairs.where((c("s_postal") != "") & (c("t_postal") != "") & (c("s_num") != "") & (c("t_num") != ""))
    p, n = c("s_postal") != c("t_postal"), c("s_num") != c("t_num")
    return full.agg(F.count("*").alias("pairs"), F.count(F.when(p & n, 1)).alias("both_conflict"), F.count(F.when(n, 1)).alias("num_conflict"), F.count(F.when(p, 1)).alias("postal_conflict"))


def route_flags(queries: DataFrame, targets: DataFrame, gold: DataFrame, routes: list[str]) -> DataFrame:
    """Gold pairs (s1_id, target_id) with a boolean for each route: whether they share a key of it."""
    side = lambda df, p, key, q: df.select(F.col("entity_id").alias(key), *(F.filter(route_keys(r, q), lambda x: x != "").alias(f"{p}_{r}") for r in routes))
    j = gold.where("target_id is not null").join(side(queries, "s", "s1_id", True), "s1_id").join(side(targets, "t", "target_id", False), "target_id")
    return j.select("s1_id", "target_id", *(F.arrays_overlap(f"s_{r}", f"t_{r}").alias(r) for r in routes))


def blocking_gaps(flags: DataFrame, pairs: DataFrame, routes: list[str]) -> DataFrame:
    """Gold pairs that no route finds, with why: conflicts, and whether names alike would recover them."""
    hit: Column = F.lit(False)
    for r in routes:
        hit = hit | F.col(r)
    missed = flags.where(~hit).select("s1_id", "target_id")
    p = pairs.join(missed, ["s1_id", "target_id"], "left_semi")
    grams = S.jaccard(X.char_grams(F.replace("s_norm", F.lit(" "), F.lit("")), 4), X.char_grams(F.replace("t_norm", F.lit(" "), F.lit("")), 4))
    return p.select("s1_id", "target_id", (grams >= 0.10).alias("by_grams"), (S.fuzzy("token_sort", F.col("s_norm"), F.col("t_norm")) >= 0.65).alias("by_words"),
                    S.conflicts(F.col("s_postal"), F.col("t_postal")).alias("postal_conflict"), S.conflicts(F.col("s_num"), F.col("t_num")).alias("num_conflict"))


def error_taxonomy(counts: DataFrame) -> DataFrame:
    """(kind, n) of entity_counts: perfect, partial, zero, false_singleton (links missed altogether), missed_singleton."""
    c = F.col
    kind = (F.when((c("n_gold") == 0) & (c("n_pred") > 0), "missed_singleton").when((c("n_gold") > 0) & (c("n_pred") == 0), "false_singleton")
            .when((c("n_gold") == c("n_tp")) & (c("n_pred") == c("n_tp")), "perfect").when(c("n_tp") > 0, "partial").otherwise("zero"))
    return counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def unindexed(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Gold links whose target no route has found for any query."""
    return gold.where("target_id is not null").join(found.select("target_id").distinct(), "target_id", "left_anti").select("s1_id", "target_id")


def score_histogram(links: DataFrame, singletons: DataFrame) -> DataFrame:
    """(score, n): links of true singletons by score to two places."""
    return links.join(singletons, "s1_id", "left_semi").groupBy(F.round("score", 2).alias("score")).agg(F.count("*").alias("n"))


def country_breakdown(s1: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """By country: entities, share with candidates, mean candidates, share matched, matches of a matched entity."""
    nc = candidates.groupBy("s1_id").agg(F.count("*").alias("nc"))
    nm = matches.groupBy("s1_id").agg(F.count("*").alias("nm"))
    j = s1.select(F.col("entity_id").alias("s1_id"), "country").join(nc, "s1_id", "left").join(nm, "s1_id", "left").fillna(0, ["nc", "nm"])
    return j.groupBy("country").agg(F.count("*").alias("entities"), F.avg((F.col("nc") > 0).cast("int")).alias("with_candidates"), F.avg("nc").alias("mean_candidates"),
                                    F.avg((F.col("nm") > 0).cast("int")).alias("matched"), F.avg(F.when(F.col("nm") > 0, F.col("nm"))).alias("matches_per_matched"))


def validate_lists(result: DataFrame, s1_ids: DataFrame, target_ids: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(check, n, examples) of a result(s1_id, ids comma-joined): duplicate S1, repeated id, match with an S1, wrong prefix,
    unknown id (if target_ids is given), missing S1, extra S1. Examples: the first `most` in order."""
    c = F.col
    items = result.select("s1_id", F.explode(F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("id"))
    seen = result.groupBy("s1_id").agg(F.count("*").alias("k"))
    rep = items.groupBy("s1_id", "id").agg(F.count("*").alias("k")).where("k > 1")
    bad = items.select(F.when(c("id").startswith("S1-"), "self_match").when(~c("id").startswith("S2-") & ~c("id").startswith("S3-"), "wrong_prefix").alias("check"), c("id").alias("x")).where("check is not null")
    found = [seen.where("k > 1").select(F.lit("duplicate_s1").alias("check"), c("s1_id").alias("x")), rep.select(F.lit("repeated_id"), c("s1_id")), bad.select("check", "x").distinct(),
             s1_ids.select("s1_id").join(seen, "s1_id", "left_anti").select(F.lit("missing_s1"), c("s1_id")), seen.join(s1_ids.select("s1_id"), "s1_id", "left_anti").select(F.lit("extra_s1"), c("s1_id"))]
    if target_ids is not None:
        found.append(items.where("id like 'S2-%' or id like 'S3-%'").select("id").distinct().join(target_ids.select(c("target_id").alias("id")), "id", "left_anti").select(F.lit("unknown_id"), "id"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    # The examples of a check are the smallest few: a bounded aggregate, not a list of all.
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("check").orderBy("x"))
    few = out.withColumn("rn", rank).where(F.col("rn") <= most).groupBy("check").agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("examples"))
    return out.groupBy("check").agg(F.count("*").alias("n")).join(few, "check")


def matches_outside(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't candidates."""
    return matches.select("s1_id", "target_id").join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")


def repaired_candidates(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates with the matches that were missing."""
    return candidates.select("s1_id", "target_id").union(matches.select("s1_id", "target_id")).distinct()


def line_problems(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """(problem, n) of a result file's lines: no tab, wrong number of columns."""
    n = F.size(F.split("value", "\t"))
    kind = F.when(n == 1, "no_tab").when(n != columns, "malformed")
    return spark.read.text(path).select(kind.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def order_matches(result: DataFrame, source: DataFrame) -> DataFrame:
    """Lines (line_no, s1_id) of a result whose id isn't the source's at the same place."""
    return result.join(source.select("line_no", F.col("s1_id").alias("expected")), "line_no", "full").where(~F.col("s1_id").eqNullSafe(F.col("expected"))).select("line_no", "s1_id", "expected")
