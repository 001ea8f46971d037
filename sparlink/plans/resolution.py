"""The whole resolution: entities to matches, as one plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import candidates
from ..operators.prepare import prepare_all
from ..operators.resolve import gate, owners
from ..operators.scoring import score_pairs
from .profiles import V6, Profile


@dataclass(frozen=True)
class Resolution:
    candidates: DataFrame
    scored: DataFrame
    owned: DataFrame
    matches: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Gives back what is kept, once results are written."""
        for df in self.kept:
            df.unpersist()


def resolve(queries: DataFrame, targets: DataFrame, profile: Profile = V6, keep: bool = True) -> Resolution:
    """queries and targets: entities with ord. Records and candidates are kept (memory and disk) unless keep is False,
    since each is used more than once, until release(); what is lost with an executor is worked out again."""
    q, t = prepare_all(queries, targets, text=profile.text)
    if keep:
        q, t = q.persist(), t.persist()
    found = candidates(q, t, profile)
    found = found.persist() if keep else found
    scored = score_pairs(found, q, t, profile)
    scored = scored.persist() if keep else scored
    owned = owners(scored, profile.order)
    return Resolution(found, scored, owned, gate(owned, profile.gate, profile.gate_score, profile.gate_address), (q, t, found, scored) if keep else ())


def core_postal_matches(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Core and postal code equal; else the core alone where it has one target, of a compatible country."""
    side = lambda df, key: df.where("core <> ''").select(F.col("entity_id").alias(key), "core", "postal", "cc")
    q, t = side(queries, "s1_id"), side(targets, "target_id")
    strict = q.where("postal <> ''").join(t, ["core", "postal"]).select("s1_id", "target_id")
    lone = t.groupBy("core").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"), F.min("cc").alias("tc")).where("n = 1")
    rest = q.join(strict.select("s1_id").distinct(), "s1_id", "left_anti").join(lone, "core").where("cc = '' or tc = '' or cc = tc")
    return strict.union(rest.select("s1_id", "target_id")).distinct()


def core_count_matches(queries: DataFrame, targets: DataFrame, cap: int = 30) -> DataFrame:
    """Cores of four letters and more with one target, or with three at most if the core has eight letters."""
    q = queries.where(F.length("core") >= 4).select(F.col("entity_id").alias("s1_id"), "core")
    t = targets.where(F.length("core") >= 4).select(F.col("entity_id").alias("target_id"), "core")
    n = t.groupBy("core").agg(F.count("*").alias("n")).where((F.col("n") == 1) | (F.col("n") <= 3) & (F.length("core") >= 8))
    return q.join(t.join(n, "core", "left_semi"), "core").select("s1_id", "target_id")
