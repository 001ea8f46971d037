"""Operator 1: host-level quality rules, in DataFrame functions only.

Documents are measured and tested by base rules; failures are counted by host, each host's failure rate is shrunk
towards the corpus by a beta prior whose two parameters are estimated from the hosts themselves (moments of their
rates), and a host whose rate is surely far above the corpus's has all its documents rejected.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WORD_SPACE = r"[\x20\x09-\x0D]+"


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the longs n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text.

    Words are runs outside \\x20 and \\x09-\\x0D; a null text has none. Three-word windows are compared by a 64-bit hash
    of their words, within a text only. The windows of one text are sorted, never exploded, so nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    words = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    # Each step is a column of its own, so that lambdas look values up instead of working them out again.
    out = df.select("*", F.length(bare).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    lines.alias("__lines"), words.alias("__words"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    hashed = F.transform(F.col("__words"), lambda w: F.xxhash64(w))
    out = out.withColumn("__hash", hashed).drop("__words")
    window = F.transform(F.sequence(F.lit(0), F.size("__hash") - 3), lambda i: F.xxhash64(F.get("__hash", i), F.get("__hash", i + 1), F.get("__hash", i + 2)))
    out = out.withColumn("__win", F.when(F.size("__hash") >= 3, window).otherwise(F.array().cast("array<bigint>"))).drop("__hash")
    # Most texts repeat no window: a set's size tells that, and only the others sort theirs.
    pairs = F.sort_array(F.transform(F.col("__win"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    out = out.withColumn("__sorted", F.when(some, pairs)).drop("__win")
    again = F.filter(F.col("__sorted"), lambda x, k: (F.get("__sorted", k - 1)["h"] == x["h"]) | (F.get("__sorted", k + 1)["h"] == x["h"]))
    out = out.withColumn("__at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("__sorted")
    covered = F.transform(F.col("__at"), lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__at")


def base_failed(min_words: int = 50, repeat_share: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))


def host_rates(measures: DataFrame, host: str, failed: Column, excess: float = 3.0, least: float = 0.3, most: float = 0.8, sure: float = 2.33) -> DataFrame:
    """(host, n, n_failed, rate, low, rejected): each host's failure rate, shrunk by the empirical beta prior.

    rate is the posterior's mean and low lies `sure` of its standard deviations below: a host is rejected if low exceeds
    `excess` times the corpus's rate, a limit that is kept within least and most. So a bad host goes as a whole, a small
    host that was unlucky stays, and a corpus of hosts that are all alike loses none.

    The prior's mean and strength are those of the hosts' own rates by moments: with mean m and variance v of the rates,
    strength m(1-m)/v - 1, within 1 and 1e6. Without spread or with one host it is the greatest, so hosts count as the
    corpus. A null host is a host of its own.
    """
    hosts = measures.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count(F.when(failed, 1)).alias("n_failed"))
    hosts = written(hosts, "hosts")
    prior = hosts.select((F.col("n_failed") / F.col("n")).alias("r"), "n", "n_failed").agg(
        (F.sum("n_failed") / F.sum("n")).alias("m"), F.avg("r").alias("mr"), F.var_pop("r").alias("v")).first()
    m = prior.m or 0.0
    spread = prior.mr * (1 - prior.mr) / prior.v - 1 if prior.v else 1e6
    strength = min(max(spread, 1.0), 1e6)
    limit = min(most, max(least, excess * m))
    out = hosts.withColumn("rate", (F.col("n_failed") + m * strength) / (F.col("n") + strength))
    out = out.withColumn("low", F.col("rate") - sure * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1)))
    return out.withColumn("rejected", F.col("low") > limit)


def quality_rules(df: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 50, repeat_share: int = 50, excess: float = 3.0, least: float = 0.3, most: float = 0.8,
                  sure: float = 2.33, carry: list[str] | None = None) -> DataFrame:
    """df's columns as they are (those of carry, if given), as the struct `row`, with the five measures, base_failed,
    host_rate and kept.

    kept is false for documents that fail a base rule and for all documents of a host that host_rates rejects. A null or
    empty text has 0 words and fails; a null host is one host; repeated rows count each; an empty table stays empty.
    Measures are written once and read for the hosts' counts and for the verdicts. A hot host meets its verdict by a
    broadcast where the table of hosts proves small at run time, else by a join whose large parts are split.
    """
    names = df.columns if carry is None else carry
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("__text"))
    got = measured(whole, "__text").drop("__text").withColumn("base_failed", base_failed(min_words, repeat_share))
    got = written(got, "measures")
    hosts = host_rates(got, "host", F.col("base_failed"), excess, least, most, sure).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "rejected")
    hosts = written(hosts, "host-rates")
    out = got.join(hosts, got["host"].eqNullSafe(hosts["__host"]), "left").drop("__host", "host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("rejected")
