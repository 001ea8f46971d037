"""Named profiles of the resolution engine: routes with their caps, scorer, gates. One engine, these parameters."""
from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Profile:
    """caps: by route the most index rows of a key. brand_words: distinctive words of the query side that are looked up.
    fuzzy: names of the scores that make up the name similarity; none for the profile of exact tiers only."""

    name: str
    caps: dict[str, int]
    brand_words: int = 6
    cutoff: float = 0.81
    fuzzy: tuple[str, ...] = ("core", "sorted", "weighted", "expanded")
    expanded: bool = True
    phone: bool = True
    moderate_partial: bool = False
    partial_from: float = 0.82
    tiers: str = "standard"  # strict, brand, tightened: other readings of the tiers after the exact ones
    category: str = "none"  # none, soft: unless names are close, hard
    text: str = "standard"  # how records are made: standard, calibrated
    alias_cap: int | None = None  # the most index rows of a core key that an alias may still join
    gate: str = "lone"
    gate_score: float = 0.82
    gate_address: float = 0.60
    order: tuple[str, ...] = field(default=("score", "nm", "pm", "a_sim"))


def _caps(core, sorted_, concat, brand, num, post, post_num, addr, **more) -> dict[str, int]:
    return dict(core=core, sorted=sorted_, concat=concat, brand=brand, num_prefix=num, post_prefix=post, post_num=post_num, addr_key=addr) | more


V6 = Profile("v6", _caps(60, 50, 30, 30, 30, 30, 30, 20, pfx4_country=50, bigram=30, phone=20))
V2 = Profile("v2", _caps(40, 40, 25, 25, 25, 25, 25, 15), fuzzy=("core", "sorted"), expanded=False, phone=False, gate_score=0.84, gate_address=0.65)
V1R = replace(V2, name="v1r", caps={k: v for k, v in V2.caps.items() if k != "post_num"}, gate="none")
V3 = replace(V2, name="v3", caps=V2.caps | {"post_prefix4": 20}, fuzzy=("core", "sorted", "partial"), moderate_partial=True, category="soft", gate="signals")
V4L = Profile("v4l", _caps(35, 35, 20, 20, 20, 20, 20, 12, post_prefix4=15), fuzzy=("core", "sorted", "partial"), expanded=False, phone=False, moderate_partial=True,
              category="soft", gate="signals", gate_score=0.84, gate_address=0.65)
V4 = replace(V4L, name="v4", tiers="tightened", partial_from=0.80, caps=V4L.caps | {"city_num": 20, "char4": 15, "domain": 20, "post_dist": 20})
V5 = Profile("v5", text="calibrated", alias_cap=30, caps=_caps(100, 50, 30, 50, 40, 40, 50, 25, post_prefix4=15), brand_words=5, fuzzy=("core", "sorted"), expanded=False, phone=False,
             category="hard", gate="blank_address", gate_score=0.84, gate_address=0.65)
G = Profile("g", {k: V2.caps[k] for k in V2.caps if k != "sorted"} | {"sorted": 40}, brand_words=3, fuzzy=("core", "sorted"), expanded=False, phone=False, tiers="strict", gate_score=0.84, gate_address=0.65)
BRAND = replace(V2, name="brand", tiers="brand")
#: Greater caps, for a look at what blocking could reach.
HIGH_RECALL = replace(V2, name="high_recall", caps=dict(core=500, sorted=400, concat=300, brand=300, addr_key=150))
#: Exact tiers only; the address similarity is the words' Jaccard index. Every step is a built-in expression.
EXACT = Profile("exact", _caps(60, 50, 30, 30, 30, 30, 30, 20), fuzzy=(), gate_score=0.84, gate_address=0.65)
PROFILES = {p.name: p for p in (V1R, V2, V3, V4L, V4, V5, V6, G, BRAND, HIGH_RECALL, EXACT)}
