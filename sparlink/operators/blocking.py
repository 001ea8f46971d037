"""Blocking: keys of every route as one long table, capped, and one equi-join for all routes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.profiles import Profile

#: The routes in the order in which they are added up.
ROUTES = ["core", "sorted", "concat", "brand", "num_prefix", "post_prefix", "post_num", "addr_key", "pfx4_country", "bigram", "phone",
          "post_prefix4", "city_num", "char4", "domain", "post_dist", "first_prefix5", "first_prefix4", "soundex"]


def _one(key: Column) -> Column:
    return F.array(key)


def route_keys(route: str, query_side: bool, brand_words: int = 6, expanded: bool = True) -> Column:
    """A record's keys of a route as an array, in the order in which they take slots; empty keys are dropped later."""
    c = F.col
    if route == "core":  # core, expanded core and aliases share one index and its cap
        more = [F.when(c("exp_core") != c("core"), c("exp_core")).otherwise("")] if expanded else []
        return F.concat(F.array(c("core"), *more), c("aliases"))
    if route == "brand":
        return F.slice("brand", 1, brand_words) if query_side else c("brand")
    if route in ("addr_key", "phone"):
        return c("addr_keys") if route == "addr_key" else c("phones_raw")
    if route in ("num_prefix", "post_prefix", "post_num", "pfx4_country", "bigram", "post_prefix4"):
        return _one(c(route))
    made = {
        "sorted": lambda: c("sorted_key"), "concat": lambda: F.when(F.length("concat_key") >= 5, c("concat_key")).otherwise(""), "char4": lambda: c("prefix4"),
        "city_num": lambda: X.both(X.city(c("norm_addr")), c("num")), "domain": lambda: X.domain_token(c("name")),
        "post_dist": lambda: X.both(c("postal"), F.coalesce(F.get("dist_addr", F.lit(0)), F.lit(""))),
        "first_prefix5": lambda: X.first_token_prefix(c("norm"), 5, 4), "first_prefix4": lambda: X.first_token_prefix(c("norm"), 4, 4),
        "soundex": lambda: X.soundex_code(F.coalesce(F.get("core_toks", F.lit(0)), F.lit(""))),
    }
    return _one(made[route]())


def keys(records: DataFrame, routes: list[str], query_side: bool, brand_words: int = 6, expanded: bool = True) -> DataFrame:
    """(route, key, id, ord, pos): every key of every route; a repeated key takes a slot each time, as pos tells."""
    def tagged(route: str) -> Column:
        return F.transform(route_keys(route, query_side, brand_words, expanded), lambda k, i: F.struct(F.lit(route).alias("route"), k.alias("key"), i.alias("pos")))

    all_keys = F.concat(*map(tagged, routes))
    out = records.select(F.col("entity_id").alias("id"), "ord", F.explode(all_keys).alias("k"))
    return out.select("k.route", "k.key", "id", "ord", "k.pos").where("key <> ''")


def needed(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The index's keys that some query has; so that caps count needed keys and later steps see those only."""
    return index.join(queries.select("route", "key").distinct(), ["route", "key"], "left_semi")


def cap_per_key(index: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first rows of each (route, key) by (ord, pos), up to the route's cap.

    The rank filter is pushed below the shuffle: a task sends no more of a key than the greatest cap.
    """
    rank = F.row_number().over(Window.partitionBy("route", "key").orderBy("ord", "pos"))
    most = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))
    return index.withColumn("rn", rank).where(F.col("rn") <= max(caps.values())).where(F.col("rn") <= most[F.col("route")]).drop("rn")


def cap_with_aliases(index: DataFrame, caps: dict[str, int], alias_cap: int) -> DataFrame:
    """As cap_per_key, but an alias (a core key past the first) joins a key only while it has fewer than alias_cap rows.

    So the first alias_cap rows of any kind stay, and after them cores only, up to the cap. Both parts are rank filters, so
    what is ranked again is a cap's rows for each key at most.
    """
    core = index.where("route = 'core'")
    first = cap_per_key(core, {"core": alias_cap}).withColumn("early", F.lit(True))
    cores = cap_per_key(core.where("pos = 0"), {"core": caps["core"]}).withColumn("early", F.lit(False))
    own = first.union(cores).groupBy(*index.columns).agg(F.max("early").alias("early"))
    late = F.row_number().over(Window.partitionBy("route", "key", "early").orderBy("ord", "pos"))
    own = own.withColumn("rn", late).withColumn("n_early", F.count(F.when(F.col("early"), 1)).over(Window.partitionBy("route", "key")))
    own = own.where(F.col("early") | (F.col("rn") <= caps["core"] - F.col("n_early"))).select(*index.columns)
    return own.union(cap_per_key(index.where("route <> 'core'"), caps).select(*index.columns))


def candidates(queries: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """(s1_id, target_id, routes): distinct pairs of all routes, with the sorted names of the routes that found them.

    A key has at most `cap` rows on the index side, so a query's pairs are bounded by its keys; a key that many queries
    share is split by skew handling of the join.
    """
    routes = [r for r in ROUTES if r in profile.caps]
    q = keys(queries, routes, True, profile.brand_words, profile.expanded).select("route", "key", "id").distinct()
    index = needed(keys(targets, routes, False, profile.brand_words, profile.expanded), q)
    index = cap_with_aliases(index, profile.caps, profile.alias_cap) if profile.alias_cap else cap_per_key(index, profile.caps)
    pairs = q.withColumnRenamed("id", "s1_id").join(index.select("route", "key", F.col("id").alias("target_id")), ["route", "key"])
    return pairs.groupBy("s1_id", "target_id").agg(F.array_sort(F.collect_set("route")).alias("routes"))


def route_pairs(queries: DataFrame, targets: DataFrame, route: str, cap: int, brand_words: int = 6) -> DataFrame:
    """(s1_id, target_id) of a single route under its cap."""
    q = keys(queries, [route], True, brand_words).select("route", "key", "id").distinct()
    index = cap_per_key(needed(keys(targets, [route], False), q), {route: cap})
    return q.withColumnRenamed("id", "s1_id").join(index.select("route", "key", F.col("id").alias("target_id")), ["route", "key"]).select("s1_id", "target_id").distinct()


def rare_token_pairs(queries: DataFrame, targets: DataFrame, share: float = 0.005, least: int = 5, cap: int = 200) -> DataFrame:
    """Pairs that share a word of four letters and more whose document frequency among targets is at most max(least, share*N)."""
    words = lambda df: df.select(F.col("entity_id").alias("id"), "ord", F.explode(F.array_distinct(F.filter("core_toks", lambda x: F.length(x) >= 4))).alias("key"))
    index = words(targets)
    limit = F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("n")))
    total = targets.agg(F.count("*").alias("n")).select(limit.alias("limit"))
    rare = index.groupBy("key").agg(F.count("*").alias("df")).join(F.broadcast(total)).where("df <= limit").select("key")  # one row
    rank = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    index = index.join(rare, "key", "left_semi").withColumn("rn", rank).where(F.col("rn") <= cap)
    return words(queries).select(F.col("id").alias("s1_id"), "key").join(index.select(F.col("id").alias("target_id"), "key"), "key").select("s1_id", "target_id").distinct()


def fair_quota(found: DataFrame, quotas: list[tuple[str, int]], total: int = 75) -> DataFrame:
    """(s1_id, target_id, place): routes in the given order each add up to their quota of targets not yet there.

    found: (s1_id, route, target_id, ord), bounded per query by the caps. The fold over a query's sorted finds is exact: an
    id that an earlier route gave takes none of a later route's quota.
    """
    order = F.create_map(*(F.lit(x) for i, (r, _) in enumerate(quotas) for x in (r, i)))
    quota = F.array(*(F.lit(q) for _, q in quotas))
    own = found.withColumn("r", order[F.col("route")]).where("r is not null").groupBy("s1_id").agg(F.array_sort(F.collect_set(F.struct("r", "ord", F.col("target_id").alias("t")))).alias("xs"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(-1).alias("r"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(x["r"] == a["r"], a["n"]).otherwise(0)
        take = ~F.array_contains(a["ids"], x["t"]) & (n < F.element_at(quota, x["r"] + 1)) & (F.size(a["ids"]) < total)
        return F.struct(F.when(take, F.array_append(a["ids"], x["t"])).otherwise(a["ids"]).alias("ids"), x["r"].alias("r"), F.when(take, n + 1).otherwise(n).alias("n"))

    ids = F.aggregate("xs", start, step)["ids"]
    return own.select("s1_id", F.posexplode(ids).alias("place", "target_id")).select("s1_id", "target_id", (F.col("place") + 1).alias("place"))


def ranking_score(similarity: Column, number_bonus: float = 0.0, empty: float = 0.0) -> Column:
    """What a query's candidates are cut by, from 0 to 100 and the bonus for an equal number; `empty` where a core is missing."""
    c = F.col
    return F.when((c("s_core") == "") | (c("t_core") == ""), empty).otherwise(100 * similarity) + F.when(c("nm"), number_bonus).otherwise(0.0)


def top_by_similarity(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best targets of each query by score, then id."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "target_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def with_rank_and_pool(pairs: DataFrame) -> DataFrame:
    """cand_rank (from 1, by target id) and pool_size of each pair within its query."""
    own = Window.partitionBy("s1_id")
    return pairs.withColumn("cand_rank", F.row_number().over(own.orderBy("target_id"))).withColumn("pool_size", F.count("*").over(own))


def incremental_recall(gold: DataFrame, found: DataFrame, order: list[str]) -> DataFrame:
    """(step, route, captured, total, recall, gain): gold pairs found by the first routes of the order, added one by one;
    gain: what their recall adds to the first route's, in points."""
    place = F.create_map(*(F.lit(x) for i, r in enumerate(order) for x in (r, i + 1)))
    first = found.withColumn("step", place[F.col("route")]).groupBy("s1_id", "target_id").agg(F.min("step").alias("step"))
    hit = gold.where("target_id is not null").join(first, ["s1_id", "target_id"], "left").groupBy("step").agg(F.count("*").alias("n"))
    spark = gold.sparkSession
    steps = spark.createDataFrame([(i + 1, r) for i, r in enumerate(order)], "step int, route string")
    # As many rows as there are routes from here on.
    full = steps.join(hit.where("step is not null"), "step", "left").fillna(0, ["n"])
    total = hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    running = F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    out = full.select("step", "route", running.alias("captured")).join(F.broadcast(total))
    first = F.first("captured").over(Window.orderBy("step"))
    share = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)
    return out.withColumn("recall", share(F.col("captured"))).withColumn("gain", 100 * share(F.col("captured") - first))
