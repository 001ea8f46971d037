"""Pair features and their aggregates, inverse document frequencies, training tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X

#: Features that take no fuzzy score, in the order of the table.
NATIVE = ["core_exact", "sorted_exact", "name_token_jaccard", "char_ngram_jaccard", "brand_overlap_count", "brand_overlap_flag", "max_shared_idf", "mean_shared_idf",
          "addr_dist_jaccard", "addr_dist_overlap_count", "postal_match", "postal_conflict", "has_both_postal", "num_match", "num_conflict", "has_both_num",
          "s1_has_addr", "c_has_addr", "both_have_addr", "either_addr_missing", "country_rel", "s1_non_ascii", "c_non_ascii", "cross_script", "is_s2", "is_s3", "cand_rank", "pool_size"]
FUZZY = ["token_sort", "token_set", "lev_ratio", "jaro_winkler", "partial_ratio", "addr_token_set", "addr_token_sort"]
STRENGTH = ["name_strength", "addr_strength", "name_x_addr", "strong_name_weak_addr", "weak_name_strong_addr"]
ALL = NATIVE + FUZZY + STRENGTH


def document_frequency(records: DataFrame, tokens: Column) -> DataFrame:
    """(token, df, n): in how many records each token stands, and the number of records."""
    df = records.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(records.agg(F.count("*").alias("n"))))  # one row


def idf(frequencies: DataFrame, least: float | None = None) -> DataFrame:
    """(token, idf): ln((N+1)/(df+1)) + 1, at least `least` if given."""
    value = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return frequencies.select("token", (value if least is None else F.greatest(F.lit(least), value)).alias("idf"))


def shared_idf(pairs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(s1_id, target_id, max_shared_idf, mean_shared_idf) over the core tokens that a pair shares; pairs with none are absent."""
    own = pairs.select("s1_id", "target_id", F.explode(F.array_intersect(F.split("s_core", " "), F.split("t_core", " "))).alias("token"))
    return own.join(idf(frequencies), "token").groupBy("s1_id", "target_id").agg(F.max("idf").alias("max_shared_idf"), F.avg("idf").alias("mean_shared_idf"))


def native_features(pairs: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """pairs (with records, evidence, cand_rank, pool_size) with the columns of NATIVE as doubles.

    Without frequencies the two idf features are the constants that a missing table gives (5 if a token is shared)."""
    c = F.col
    flag = lambda x: x.cast("double")
    toks = lambda p: F.filter(F.split(f"{p}_norm", " "), lambda x: x != "")
    shared = F.size(F.array_intersect(toks("s"), toks("t"))) > 0
    if frequencies is None:
        pairs = pairs.withColumn("max_shared_idf", F.when(shared, 5.0).otherwise(0.0)).withColumn("mean_shared_idf", c("max_shared_idf"))
    else:
        pairs = pairs.join(shared_idf(pairs, frequencies), ["s1_id", "target_id"], "left").fillna(0.0, ["max_shared_idf", "mean_shared_idf"])
    brand = S.overlap(c("s_brand"), c("t_brand"))
    return pairs.withColumns({
        "core_exact": flag(S.matches(c("s_core"), c("t_core"))), "sorted_exact": flag(S.matches(c("s_sorted_key"), c("t_sorted_key"))), "name_token_jaccard": S.jaccard(toks("s"), toks("t")),
        "char_ngram_jaccard": S.jaccard(X.char_grams(c("s_norm")), X.char_grams(c("t_norm"))), "brand_overlap_count": flag(brand), "brand_overlap_flag": flag(brand > 0),
        "addr_dist_jaccard": S.jaccard(c("s_dist_addr"), c("t_dist_addr")), "addr_dist_overlap_count": flag(c("overlap")), "postal_match": flag(c("pm")), "postal_conflict": flag(c("pc")),
        "has_both_postal": flag(c("pm") | c("pc")), "num_match": flag(c("nm")), "num_conflict": flag(c("nc")), "has_both_num": flag(c("nm") | c("nc")), "s1_has_addr": flag(c("has_s")),
        "c_has_addr": flag(c("has_t")), "both_have_addr": flag(c("both_addr")), "either_addr_missing": flag(~c("both_addr")), "country_rel": S.country_relation(c("s_cc"), c("t_cc")),
        "s1_non_ascii": flag(c("s_non_ascii")), "c_non_ascii": flag(c("t_non_ascii")), "cross_script": flag(c("s_non_ascii") != c("t_non_ascii")),
        "is_s2": flag(F.lower("target_id").contains("s2")), "is_s3": flag(F.lower("target_id").contains("s3")), "cand_rank": flag(c("cand_rank")), "pool_size": flag(c("pool_size"))})


def all_features(pairs: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """The forty features: NATIVE, the fuzzy scores, and how both strengths go together."""
    c, f = F.col, S.fuzzy
    p = native_features(pairs, frequencies).withColumns({
        "token_sort": f("token_sort", c("s_norm"), c("t_norm")), "token_set": f("token_set", c("s_norm"), c("t_norm")), "lev_ratio": f("ratio", c("s_core"), c("t_core")),
        "jaro_winkler": f("jaro_winkler", c("s_norm"), c("t_norm")), "partial_ratio": f("partial", c("s_norm"), c("t_norm")),
        "addr_token_set": f("token_set", c("s_clean_addr"), c("t_clean_addr")), "addr_token_sort": f("token_sort", c("s_clean_addr"), c("t_clean_addr"))})
    both = c("both_have_addr") == 1
    p = p.withColumn("name_strength", F.greatest("token_sort", "token_set", "lev_ratio", "jaro_winkler"))
    p = p.withColumn("addr_strength", F.when(both, F.greatest("addr_token_set", "addr_dist_jaccard", "postal_match")).otherwise(0.5))
    return p.withColumns({"name_x_addr": c("name_strength") * c("addr_strength"), "strong_name_weak_addr": ((c("name_strength") > 0.88) & both & (c("addr_strength") < 0.30)).cast("double"),
                          "weak_name_strong_addr": ((c("name_strength") < 0.50) & both & (c("addr_strength") > 0.85)).cast("double")})


def compact_features(native: DataFrame) -> DataFrame:
    """The smaller set's columns that differ: exact concatenation, lines of business in conflict, core lengths; an alias
    that is the other's core counts as a core nearly equal."""
    c = F.col
    alias = F.array_contains("s_aliases", c("t_core")) | F.array_contains("t_aliases", c("s_core"))
    clash = (c("s_cat") != 0) & (c("t_cat") != 0) & (c("s_cat").bitwiseAND(c("t_cat")) == 0)
    ls, lt = F.length("s_core"), F.length("t_core")
    return native.withColumns({"core_exact": F.when((c("core_exact") < 1) & alias, 0.95).otherwise(c("core_exact")), "concat_exact": S.matches(c("s_concat_key"), c("t_concat_key")).cast("double"),
                               "cat_conflict": clash.cast("double"), "core_len_min": F.least(ls, lt).cast("double"), "core_len_diff": F.abs(ls - lt).cast("double"),
                               "country_match": (c("country_rel") == 1).cast("double"), "country_conflict": (c("country_rel") == 0).cast("double")})


def entity_aggregate(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """By query: n, n_s2, n_s3, and of each column the maximum and the mean of the three greatest."""
    aggs = [F.count("*").alias("n"), F.count(F.when(F.col("target_id").startswith("S2"), 1)).alias("n_s2"), F.count(F.when(F.col("target_id").startswith("S3"), 1)).alias("n_s3")]
    for x in columns:
        top = F.slice(F.sort_array(F.collect_list(x), asc=False), 1, 3)  # a query's pairs are bounded by the caps
        aggs += [F.max(x).alias(f"max_{x}"), (F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.size(top)).alias(f"top3_{x}")]
    return pairs.groupBy("s1_id").agg(*aggs)


#: The pair features that the entity gate sees the greatest three of.
GATE_FEATURES = ["name_strength", "addr_strength", "name_x_addr", "token_sort", "token_set", "core_exact", "char_ngram_jaccard", "max_shared_idf", "postal_match", "num_match", "country_rel"]


def entity_gate_features(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """By query id the 25 aggregates of entity_aggregate over GATE_FEATURES; queries without pairs have 0s."""
    return ids.select("s1_id").join(entity_aggregate(pairs, GATE_FEATURES), "s1_id", "left").fillna(0)


def gate_features(ids: DataFrame, scored: DataFrame, prob: str = "prob") -> DataFrame:
    """By query id: p_max, p_2nd, gap, top3_sum, n, n_over (> 0.3), empty; queries without pairs have 0s and empty 1."""
    top = F.sort_array(F.collect_list(prob), asc=False)
    g = scored.groupBy("s1_id").agg(top.alias("p"), F.count("*").alias("n"), F.count(F.when(F.col(prob) > 0.3, 1)).alias("n_over"))
    at = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(0.0))
    g = g.select("s1_id", at(0).alias("p_max"), at(1).alias("p_2nd"), (at(0) - at(1)).alias("gap"), (at(0) + at(1) + at(2)).alias("top3_sum"), "n", "n_over", F.lit(0).alias("empty"))
    return ids.select("s1_id").join(g, "s1_id", "left").fillna(0).withColumn("empty", (F.col("n") == 0).cast("int"))


def training_pairs(pairs: DataFrame, gold: DataFrame, negatives: int, seed: int = 42, add_missing: bool = False) -> DataFrame:
    """pairs with label; all positives and for each query the first `negatives` others by a hash; with add_missing also the
    gold pairs that blocking missed, whose other columns are null."""
    g = gold.where("target_id is not null").select("s1_id", "target_id").distinct().withColumn("label", F.lit(1))
    labelled = pairs.join(g, ["s1_id", "target_id"], "full" if add_missing else "left").fillna(0, ["label"])
    rank = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(F.xxhash64("target_id", F.lit(seed)), "target_id"))
    return labelled.withColumn("_rn", rank).where((F.col("label") == 1) | (F.col("_rn") <= negatives)).drop("_rn")


def sample_entities(ids: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n ids: the smallest, or with a seed those with the smallest hashes."""
    return ids.orderBy(*([F.xxhash64("s1_id", F.lit(seed))] if seed is not None else []), "s1_id").limit(n)
