"""The composite profile from entities to matches: its own text and keys, gram retrieval beside routes, one score."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import tfidf as TF
from ..operators.blocking import cap_per_key
from ..operators.graph import written
from ..operators.resolve import gate, owners
from .resolution import Resolution

#: Index rows of a route's key; those that an alias of the query still meets under the core's key.
CAP, ALIAS_CAP = 30, 10


def records(entities: DataFrame) -> DataFrame:
    """entities(entity_id, name, address, country, ord[, postal_code, phone]) with the profile's columns.

    A postal code or phone that the table doesn't have is empty, and so are the keys that need it.
    """
    c = F.col
    have = lambda x: c(x) if x in entities.columns else F.lit("")
    fields = X.composite_fields(c("address"), have("postal_code"), have("phone"))
    out = entities.select("entity_id", "ord", X.composite_core(c("name")).alias("core"), X.composite_aliases(c("name")).alias("aliases"), X.composite_country(c("address"), c("country")).alias("cc"),
                          X.normalize_punctuation(c("address")).alias("addr"), X.normalize_punctuation(c("name")).alias("norm"), *(v.alias(k) for k, v in fields.items()))
    words = X.tokens(c("core"))
    start = F.when(F.length("core") >= 3, F.substring("core", 1, 3)).otherwise("")
    keys = {"core": c("core"), "sorted": F.array_join(F.sort_array(words), " "), "bigram": X.smallest_pair_key(words), "phone": F.when(F.length("phone") >= 7, c("phone")).otherwise(""),
            "postal_core": X.both(c("postal"), start), "street_core": X.both(c("street"), start), "postal_street": X.both(c("postal"), c("street"))}
    return out.withColumn("keys", F.filter(F.array(*(F.struct(F.lit(r).alias("route"), k.alias("key")) for r, k in keys.items())), lambda x: x["key"] != ""))


def routed(q: DataFrame, t: DataFrame) -> DataFrame:
    """(s1_id, target_id, route): the first CAP targets of every key of the query, and the first ALIAS_CAP whose core is an alias."""
    key = lambda df: df.select(F.col("entity_id").alias("id"), "ord", F.explode("keys").alias("k")).select("k.route", "k.key", "id", "ord", F.lit(0).alias("pos"))
    alias = q.select(F.col("entity_id").alias("s1_id"), F.explode("aliases").alias("key")).where("key <> ''").distinct().withColumn("route", F.lit("core"))
    asked = key(q).select("route", "key", F.col("id").alias("s1_id"))
    index = key(t).join(asked.select("route", "key").union(alias.select("route", "key")).distinct(), ["route", "key"], "left_semi")
    routes = ["core", "sorted", "bigram", "phone", "postal_core", "street_core", "postal_street"]
    full = cap_per_key(index, dict.fromkeys(routes, CAP)).select("route", "key", F.col("id").alias("target_id"))
    few = cap_per_key(index.where("route = 'core'"), {"core": ALIAS_CAP}).select("route", "key", F.col("id").alias("target_id"))
    found = asked.join(full, ["route", "key"]).select("s1_id", "target_id", "route")
    return found.union(alias.join(few, ["route", "key"]).select("s1_id", "target_id", F.lit("alias")))


def scored_pairs(pairs: DataFrame, q: DataFrame, t: DataFrame) -> DataFrame:
    """(s1_id, target_id, score, a_sim, pm, nm, s_ord) of pairs(s1_id, target_id) of compatible countries with a name
    similarity of 0.30 and more; the score adds bonuses for postal code, street number and address, 1 at most."""
    c = F.col
    carried = ["core", "norm", "addr", "postal", "street", "cc", "aliases"]
    side = lambda df, p, key: df.select(c("entity_id").alias(key), c("ord").alias(f"{p}_ord"), *(c(x).alias(f"{p}_{x}") for x in carried))
    p = pairs.join(side(q, "s", "s1_id"), "s1_id").join(side(t, "t", "target_id"), "target_id").where(~S.conflicts(c("s_cc"), c("t_cc")))
    names = F.greatest(S.fuzzy("token_sort", c("s_core"), c("t_core")), S.fuzzy("jaro_winkler", c("s_core"), c("t_core")), S.fuzzy("token_sort", c("s_norm"), c("t_norm")),
                       S.best_of_lists("token_sort", c("s_aliases"), c("t_aliases")))
    p = p.withColumns({"pm": S.matches(c("s_postal"), c("t_postal")), "nm": S.matches(c("s_street"), c("t_street")), "a_sim": S.jaccard(X.tokens(c("s_addr")), X.tokens(c("t_addr"))), "name_sim": names})
    score = c("name_sim") + F.when(c("pm"), 0.10).otherwise(0.0) + F.when(c("nm"), 0.05).otherwise(0.0) + F.when(c("a_sim") > 0.5, 0.05).otherwise(0.0)
    return p.where("name_sim >= 0.30").select("s1_id", "target_id", F.least(F.lit(1.0), score).alias("score"), "a_sim", "pm", "nm", "s_ord")


def resolve_composite(queries: DataFrame, targets: DataFrame, least: float = 0.15, k: int = 20, size: int = 100_000, most: int = 150_000) -> Resolution:
    """Entities with ord to matches: the best k of each `size` targets by grams of the core and the routes' targets are
    candidates; every target has one owner by (score, address similarity), the earliest query on ties; a query's only match
    goes if it is below 0.82 with an address similarity below 0.60."""
    q, t = written(records(queries)), written(records(targets))
    near = TF.sharded_top(q, t, "entity_id", "ord", X.padded_grams(F.col("core")), least, k, size, most)
    found = near.select(F.col("q").alias("s1_id"), F.col("t").alias("target_id"), F.lit("grams").alias("route")).union(routed(q, t))
    found = written(found.groupBy("s1_id", "target_id").agg(F.array_sort(F.collect_set("route")).alias("routes")))
    scored = written(scored_pairs(found.select("s1_id", "target_id"), q, t))
    owned = owners(scored, ("score", "a_sim"))
    return Resolution(found, scored, owned, gate(owned.withColumn("t_blank", F.lit(False)).withColumn("core_len", F.lit(0)), "lone", 0.82, 0.60).drop("t_blank", "core_len"))
