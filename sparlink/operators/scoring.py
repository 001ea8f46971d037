"""Pair scores: gates, tiers and variants, for prepared records s_* (query) and t_* (target)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..plans.profiles import Profile

#: What a pair carries of each record.
CARRIED = ["core", "exp_core", "sorted_key", "concat_key", "norm", "aliases", "clean_addr", "postal", "num", "dist_addr", "cc", "non_ascii", "phones_raw", "phones_addr", "cat", "brand"]


def with_records(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs(s1_id, target_id, ...) with the records' columns as s_* and t_*, and both orders."""
    side = lambda df, p, key: df.select(F.col("entity_id").alias(key), F.col("ord").alias(f"{p}_ord"), *(F.col(c).alias(f"{p}_{c}") for c in CARRIED))
    return pairs.join(side(queries, "s", "s1_id"), "s1_id").join(side(targets, "t", "target_id"), "target_id")


def evidence(pairs: DataFrame) -> DataFrame:
    """Flags that need no fuzzy score: pm, nm (postal code, number equal), pc, nc (in conflict), overlap, has_s, has_t, both_addr."""
    c = F.col
    return pairs.withColumns({
        "pm": S.matches(c("s_postal"), c("t_postal")), "nm": S.matches(c("s_num"), c("t_num")), "pc": S.conflicts(c("s_postal"), c("t_postal")), "nc": S.conflicts(c("s_num"), c("t_num")),
        "overlap": F.size(F.filter("t_dist_addr", lambda x: F.array_contains(c("s_dist_addr"), x))), "has_s": c("s_clean_addr") != "", "has_t": c("t_clean_addr") != ""}).withColumn("both_addr", c("has_s") & c("has_t"))


def country_compatible() -> Column:
    return ~S.conflicts(F.col("s_cc"), F.col("t_cc"))


def address_gate_cheap() -> Column:
    """Whether a pair passes the parts of the address gate that need no score."""
    c = F.col
    apart = (F.size("s_dist_addr") > 0) & (F.size("t_dist_addr") > 0) & ~c("pm") & (c("overlap") == 0)
    return ~(c("both_addr") & (apart | (c("nc") & (c("overlap") == 0))))


def address_gate_score(sim: Column, least: float = 0.35, conflict: float = 0.70) -> Column:
    """Whether a pair passes the other parts; a missing score passes."""
    return ~F.coalesce((sim < least) | (F.col("pc") & (sim < conflict)), F.lit(False))


def missing_address_guard() -> Column:
    """Without an address on a side the query's core needs two words or fourteen letters."""
    return F.col("both_addr") | (F.size(F.split("s_core", " ")) >= 2) | (F.length("s_core") >= 14)


def category_clash() -> Column:
    """Both sides name lines of business and none in common."""
    return (F.col("s_cat") != 0) & (F.col("t_cat") != 0) & (F.col("s_cat").bitwiseAND(F.col("t_cat")) == 0)


def fixed_tier(profile: Profile) -> Column:
    """The score of tiers that follow from equal keys alone, else null."""
    c = F.col
    ev1 = c("pm") | c("nm") | (c("overlap") >= 1)
    tier = F.when((c("s_core") != "") & (c("s_core") == c("t_core")), 0.95)
    if profile.expanded:
        four = (c("s_core") != "") & (c("t_core") != "") & (c("s_exp_core") != "") & (c("t_exp_core") != "")
        tier = tier.when(four & (c("s_exp_core") == c("t_exp_core")) & (c("s_exp_core") != c("s_core")), 0.94)
    tier = tier.when(F.array_contains("s_aliases", c("t_core")) | F.array_contains("t_aliases", c("s_core")), 0.94)
    tier = tier.when((c("s_sorted_key") != "") & (c("s_sorted_key") == c("t_sorted_key")), 0.92)
    joined = (c("s_concat_key") != "") & ((c("s_concat_key") == c("t_concat_key")) | (c("s_concat_key") == F.replace("t_norm", F.lit(" "), F.lit(""))))
    return tier.when(joined, F.when(ev1 | ~c("has_s"), 0.90).otherwise(0.82))


def fuzzy_tier(profile: Profile, max_name: Column, sim: Column) -> Column:
    """The score of the tiers after the fixed ones: a branch whose condition holds keeps the pair, even at 0."""
    c = F.col
    ev1 = c("pm") | c("nm") | (c("overlap") >= 1)
    s = F.coalesce(sim, F.lit(-1.0))
    brand = S.overlap(c("s_brand"), c("t_brand")) > 0
    if profile.tiers == "strict":  # without the 0.80 and the edit tier; the weaker script tier needs the postal code
        script = F.when((c("overlap") >= 2) & (s >= 0.80), 0.88).when(c("pm") & (c("overlap") >= 1) & (s >= 0.88), 0.86).otherwise(0.0)
        tier = F.when((c("s_non_ascii") | c("t_non_ascii")) & c("nm"), script).when(max_name >= 0.88, F.when(ev1 | ~c("both_addr"), 0.87).otherwise(0.0))
        return tier.when(max_name >= 0.72, F.when(c("pm") & (c("nm") | (c("overlap") >= 1)), 0.84).when(c("nm") & (c("overlap") >= 1), 0.82).otherwise(0.0)).otherwise(0.0)
    if profile.tiers == "brand":  # a higher first limit and a moderate tier that needs a common brand or a strong address
        neither = ~c("has_s") & ~c("has_t") & (max_name >= 0.92)
        tier = F.when(c("nm") & (c("overlap") >= 2), 0.89).when(max_name >= 0.86, F.when(ev1 | neither, 0.87).otherwise(0.0))
        moderate = F.when(c("pm") | c("nm"), 0.83).when((c("overlap") >= 2) & (s >= 0.80), 0.81).otherwise(0.0)
        return tier.when((max_name >= 0.80) & (brand | (c("nm") & (c("overlap") >= 2))), moderate).otherwise(0.0)
    script = F.when((c("overlap") >= 2) & (s >= 0.80), 0.88).when((c("overlap") >= 1) & (s >= 0.90), 0.86).otherwise(0.0)
    tier = F.when((c("s_non_ascii") | c("t_non_ascii")) & c("nm"), script)
    tier = tier.when(max_name >= 0.88, F.when(ev1 | ~c("both_addr"), 0.87).otherwise(0.0))
    if profile.phone:
        tier = tier.when(F.arrays_overlap("s_phones_raw", "t_phones_addr"), F.when(max_name >= 0.60, 0.86).otherwise(0.0))
    moderate = F.when(c("pm") & (c("nm") | (c("overlap") >= 1)), 0.84).when(c("nm") & (c("overlap") >= 1), 0.82).when((c("overlap") >= 2) & (s >= 0.82), 0.80).otherwise(0.0)
    tier = tier.when(max_name >= 0.72, moderate)
    if profile.moderate_partial:
        near = F.when(c("pm") & c("nm"), 0.83).when(c("pm") & (c("overlap") >= 1), 0.82).otherwise(0.0)
        tier = tier.when((max_name >= 0.60) & (c("f.partial") >= profile.partial_from), near)
    tier = tier.otherwise(0.0)
    tier = F.when((tier < 0.80) & S.one_edit(c("s_core"), c("t_core")) & ev1, 0.83).otherwise(tier)
    if profile.tiers == "tightened":  # what the address alone carries goes if the lines of business clash or names differ
        weak = (tier >= 0.81) & (max_name < 0.60) & (category_clash() | (tier < 0.87) & (max_name < 0.55))
        tier = F.when(weak, 0.0).otherwise(tier)
    return tier


def _similarity(names: tuple[str, ...]) -> Column:
    parts = [F.col(f"f.{n}") for n in names]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def score_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """(s1_id, target_id, score, a_sim, pm, nm, s_ord, t_blank, core_len) of the pairs that pass the gates and the cutoff.

    Cheap tests come first; one Arrow pass then scores what is left, names only where no fixed tier holds.
    """
    c = F.col
    p = evidence(with_records(pairs, queries, targets)).where(country_compatible() & address_gate_cheap() & missing_address_guard())
    if profile.category == "hard":
        p = p.where(~category_clash())
    p = p.withColumn("fixed", fixed_tier(profile))
    if not profile.fuzzy:
        sim = F.when(c("both_addr"), S.jaccard(F.split("s_clean_addr", " "), F.split("t_clean_addr", " ")))
        p = p.withColumn("sim", sim).where(address_gate_score(c("sim"))).withColumn("score", F.coalesce("fixed", F.lit(0.0)))
    else:
        p = p.withColumn("f", S.pair_scores(c("s_clean_addr"), c("t_clean_addr"), c("s_core"), c("t_core"), c("s_norm"), c("t_norm"), c("s_exp_core"), c("t_exp_core"), c("fixed").isNull()))
        p = p.withColumn("sim", c("f.address")).where(address_gate_score(c("sim"))).withColumn("max_name", _similarity(profile.fuzzy))
        if profile.category == "soft":
            p = p.where(~category_clash() | c("fixed").isNotNull() | (c("max_name") >= 0.85))
        p = p.withColumn("score", F.coalesce("fixed", fuzzy_tier(profile, c("max_name"), c("sim"))))
    return p.where(c("score") >= profile.cutoff).select("s1_id", "target_id", "score", F.coalesce("sim", F.lit(0.5)).alias("a_sim"), "pm", "nm", "s_ord", (~c("has_t")).alias("t_blank"), F.length("s_core").alias("core_len"))


def screened(pairs: DataFrame, least: float = 0.48) -> DataFrame:
    """Pairs with any exact sign, or names alike; the fuzzy score is worked out for the others only."""
    c = F.col
    sure = (c("s_core") == c("t_core")) | c("pm") | c("nm") | (c("overlap") >= 1) | (c("s_sorted_key") == c("t_sorted_key"))
    rest = pairs.where(~sure).where(S.fuzzy("ratio", c("s_core"), c("t_core")) >= least)
    return pairs.where(sure).unionByName(rest)


def composite_score(pairs: DataFrame) -> DataFrame:
    """The greatest of three name similarities plus bonuses for postal code, number and address, one at most."""
    c = F.col
    name = F.greatest(S.fuzzy("token_sort", c("s_core"), c("t_core")), S.fuzzy("jaro_winkler", c("s_core"), c("t_core")), S.fuzzy("token_sort", c("s_norm"), c("t_norm")))
    addr = S.jaccard(F.filter(F.split("s_clean_addr", " "), lambda x: x != ""), F.filter(F.split("t_clean_addr", " "), lambda x: x != ""))
    p = pairs.withColumn("name_sim", name).withColumn("addr_sim", addr)
    bonus = F.when(c("pm"), 0.10).otherwise(0.0) + F.when(c("nm"), 0.05).otherwise(0.0) + F.when(c("addr_sim") > 0.5, 0.05).otherwise(0.0)
    return p.withColumn("composite", F.least(F.lit(1.0), c("name_sim") + bonus)).where((c("name_sim") >= 0.30) & country_compatible())
