"""Whole resolutions against plain Python: sequential caps, tiers as rules, claims one by one. Records come prepared (the
text functions have their own oracles); fuzzy kernels are checked by an edit-distance table in test_engine."""
import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparlink.functions import similarity as S
from sparlink.operators import blocking, resolve
from sparlink.operators.prepare import prepare
from sparlink.plans import resolution
from sparlink.plans.composite import resolve_composite
from sparlink.plans.profiles import PROFILES
from sparlink.sources import entities as E

K = S.KERNELS


@pytest.fixture(scope="module")
def fixture(spark, sf):
    return E.fixture_entities(spark, sf).withColumn("ord", F.col("source").cast("long") * (1 << 40) + F.col("doc_id"))


def keys_of(r, route, p, query):
    if route == "core":
        more = [r.exp_core] if p.expanded and r.exp_core != r.core else []
        return [("core", i == 0, k) for i, k in enumerate([r.core, *more, *r.aliases])]
    if route == "brand":
        return [(route, True, k) for k in (r.brand[: p.brand_words] if query else r.brand)]
    one = {"sorted": r.sorted_key, "concat": r.concat_key if len(r.concat_key) >= 5 else ""}
    many = {"addr_key": r.addr_keys, "phone": r.phones_raw}
    return [(route, True, k) for k in many.get(route, [one.get(route, getattr(r, route, ""))])]


def plain_candidates(qs, ts, p):
    needed = {(route, k) for q in qs for route in p.caps for _, _, k in keys_of(q, route, p, True) if k}
    index = defaultdict(list)
    for t in sorted(ts, key=lambda r: r.ord):
        for route in p.caps:
            for _, first, k in keys_of(t, route, p, False):
                most = p.caps[route] if first or not p.alias_cap else p.alias_cap
                if (route, k) in needed and len(index[route, k]) < most:
                    index[route, k].append(t.entity_id)
    return {q.entity_id: {t for route in p.caps for _, _, k in keys_of(q, route, p, True) if k for t in index.get((route, k), [])} for q in qs}


def plain_score(s, t, p):
    """(score, address similarity, postal codes equal, numbers equal) or None."""
    if s.cc and t.cc and s.cc != t.cc:
        return None
    clash = s.cat and t.cat and not s.cat & t.cat
    if p.category == "hard" and clash:
        return None
    pm, nm = bool(s.postal) and s.postal == t.postal, bool(s.num) and s.num == t.num
    pc, nc = bool(s.postal and t.postal) and not pm, bool(s.num and t.num) and not nm
    over = sum(w in set(s.dist_addr) for w in t.dist_addr)
    both = bool(s.clean_addr and t.clean_addr)
    sim = K["token_set"](s.clean_addr, t.clean_addr) if both else None
    if both:
        if sim < 0.35 or pc and sim < 0.70 or nc and not over or s.dist_addr and t.dist_addr and not pm and not over:
            return None
    elif len(s.core.split()) < 2 and len(s.core) < 14:
        return None
    any_sign, a = pm or nm or over >= 1, -1 if sim is None else sim
    name = {"core": K["ratio"](s.core, t.core), "sorted": K["token_sort"](s.norm, t.norm), "weighted": K["weighted"](s.core, t.core), "expanded": K["ratio"](s.exp_core, t.exp_core),
            "partial": K["partial"](s.core, t.core) if max(len(s.core), len(t.core)) > 6 else 0.0}
    best = max(name[x] for x in p.fuzzy)
    fixed = None
    if s.core and s.core == t.core:
        fixed = 0.95
    elif p.expanded and s.core and t.core and s.exp_core and s.exp_core == t.exp_core and s.exp_core != s.core:
        fixed = 0.94
    elif t.core in s.aliases or s.core in t.aliases:
        fixed = 0.94
    elif s.sorted_key and s.sorted_key == t.sorted_key:
        fixed = 0.92
    elif s.concat_key and s.concat_key in (t.concat_key, t.norm.replace(" ", "")):
        fixed = 0.90 if any_sign or not s.clean_addr else 0.82
    if fixed is None:
        if p.category == "soft" and clash and best < 0.85:
            return None
        phones = p.phone and set(s.phones_raw) & set(t.phones_addr)
        score = 0.0
        if (s.non_ascii or t.non_ascii) and nm:
            score = 0.88 if over >= 2 and a >= 0.80 else 0.86 if over >= 1 and a >= 0.90 else 0.0
        elif best >= 0.88:
            score = 0.87 if any_sign or not both else 0.0
        elif phones:
            score = 0.86 if best >= 0.60 else 0.0
        elif best >= 0.72:
            score = 0.84 if pm and (nm or over) else 0.82 if nm and over else 0.80 if over >= 2 and a >= 0.82 else 0.0
        elif p.moderate_partial and best >= 0.60 and name["partial"] >= p.partial_from:
            score = 0.83 if pm and nm else 0.82 if pm and over else 0.0
        short, long = sorted((len(s.core), len(t.core)))
        if score < 0.80 and 3 <= short <= 7 and long <= 8 and edits(s.core, t.core) <= 1 and any_sign:
            score = 0.83
        fixed = score
    return (fixed, 0.5 if sim is None else sim, pm, nm) if fixed >= p.cutoff else None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def weak(p, r, t, core_len):
    score, sim, pm, nm = r
    few = pm + nm + (sim >= 0.65) < 2
    lone = score < p.gate_score and sim < p.gate_address
    return {"none": False, "lone": lone, "signals": score < 0.90 and few and (score < 0.84 or core_len < 5 and score < 0.87), "blank_address": lone or not t.clean_addr and score < 0.95}[p.gate]


def plain_matches(qs, ts, p, found):
    target, claims = {t.entity_id: t for t in ts}, {}
    for q in sorted(qs, key=lambda r: r.ord):
        for t in found[q.entity_id]:
            r = plain_score(q, target[t], p)
            if r:
                rank = (r[0], r[3], r[2], r[1])
                if t not in claims or rank > claims[t][0]:
                    claims[t] = rank, q, r
    owned = defaultdict(list)
    for t, (_, q, r) in claims.items():
        owned[q.entity_id].append((t, q, r))
    return sorted((s, t, round(r[0], 9), round(r[1], 9)) for s, xs in owned.items() for t, q, r in xs if len(xs) > 1 or not weak(p, r, target[t], len(q.core)))


@pytest.mark.parametrize("name", ["v2", "v3", "v4l", "v5", "v6"])
def test_profile(fixture, name):
    p = PROFILES[name]
    rows = prepare(fixture, p.text).collect()
    qs, ts = [r for r in rows if r.source == 1], [r for r in rows if r.source > 1]
    found = plain_candidates(qs, ts, p)
    got = resolution.resolve(fixture.where("source = 1"), fixture.where("source > 1"), p, keep=False)
    assert {(r.s1_id, r.target_id) for r in got.candidates.collect()} == {(s, t) for s, xs in found.items() for t in xs}
    want = plain_matches(qs, ts, p, found)
    assert want and sorted((r.s1_id, r.target_id, round(r.score, 9), round(r.a_sim, 9)) for r in got.matches.collect()) == want


def test_aliases_join_a_key_only_while_it_is_small(spark):
    rows = [("core", "k", f"t{i:03d}", i, 1 if i % 3 else 0) for i in range(60)] + [("core", "k", "t000", 0, 2), ("sorted", "k", "z", 1, 0), ("sorted", "k", "y", 0, 0)]
    index = spark.createDataFrame(rows, "route string, key string, id string, ord long, pos int")
    want = []
    for r in sorted((r for r in rows if r[0] == "core"), key=lambda r: (r[3], r[4])):
        if len(want) < (12 if r[4] == 0 else 7):
            want.append((r[2], r[4]))
    got = blocking.cap_with_aliases(index, {"core": 12, "sorted": 1}, 7).collect()
    assert sorted((r.id, r.pos) for r in got if r.route == "core") == sorted(want) and [r.id for r in got if r.route == "sorted"] == ["y"]


def test_all_link_gates(spark):
    rows = [("a", "t1", 0.80, 0.5, True, True), ("a", "t2", 0.90, 0.5, True, True), ("b", "t3", 0.80, 0.5, False, True), ("c", "t4", 0.80, 0.9, True, False), ("d", "t5", 0.80, 0.5, False, False), ("d", "t6", 0.84, 0.6, True, False)]
    df = spark.createDataFrame([(*r, False, False, 9) for r in rows], "s1_id string, target_id string, score double, a_sim double, t_blank boolean, s_short boolean, pm boolean, nm boolean, core_len int")
    left = lambda kind, a, b: {r.target_id for r in resolve.gate(df, kind, a, b).collect()}
    assert left("blank_targets", 0.84, 0.65) == {"t4", "t5", "t6"} and left("fuzzy_only", 0.84, 0.80) == {"t1", "t2", "t4"}
    assert left("short", 0.84, 0.65) == {"t1", "t2", "t4", "t5", "t6"} - {"t4"}


# --- the composite profile, from raw rows ---
MARKS = re.compile(r"""[&@#.!?*()\[\]{};:,"'\\/\-_+=|~`]""")


def bare(x):
    return " ".join(MARKS.sub(" ", unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().lower()).split())


def composite_record(r, words):
    legal, generic, short, country, alias = words
    full = " ".join(short.get(w, w) for w in bare(r.name).split())
    core = " ".join(w for w in full.split() if w not in legal and w not in generic) or full
    c = bare(r.country)
    cc = country.get(c, c[:2]) if c else next((v for k, v in country.items() if k in bare(r.address)), "")
    street = re.match(r"\d+", bare(r.address))
    return {"id": r.entity_id, "ord": r.ord, "core": core, "norm": bare(r.name), "addr": bare(r.address), "cc": cc, "postal": r.postal_code[:5], "street": street.group() if street else "",
            "aliases": [a for a in map(bare, re.split(rf"(?i)\b(?:{'|'.join(alias)})\b", r.name)) if len(a) > 2]}


def composite_keys(r):
    w, start = sorted(r["core"].split()), r["core"][:3] if len(r["core"]) >= 3 else ""
    pair = lambda a, b: f"{a}_{b}" if a and b else ""
    keys = {"core": r["core"], "sorted": " ".join(w), "bigram": "_".join(w[:2]) if len(w) > 1 else "", "postal_core": pair(r["postal"], start), "street_core": pair(r["street"], start), "postal_street": pair(r["postal"], r["street"])}
    return [(k, v) for k, v in keys.items() if v]


def grams(text):
    t = f" {text} "
    return Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))


def test_composite_profile(fixture):
    from sparlink.functions import words as W

    words = W.COMPOSITE_LEGAL, W.COMPOSITE_GENERIC, W.COMPOSITE_ABBREVIATIONS, W.COMPOSITE_COUNTRIES, W.COMPOSITE_ALIAS_WORDS
    e = fixture.withColumn("postal_code", F.regexp_extract("address", r"(\d{5})$", 1))
    rows = e.collect()
    qs, ts = ([composite_record(r, words) for r in rows if (r.source == 1) == own] for own in (True, False))
    ts.sort(key=lambda t: t["ord"])
    df = Counter(g for t in ts for g in grams(t["core"]))
    idf = {g: math.log((len(ts) + 1) / (n + 1)) + 1 for g, n in df.items()}

    def vector(r):
        v = {g: n * idf[g] for g, n in grams(r["core"]).items() if g in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()} if length else {}

    index, vt = defaultdict(list), {t["id"]: vector(t) for t in ts}
    for t in ts:
        for k in composite_keys(t):
            index[k].append(t["id"])
    want, claims, target = set(), {}, {t["id"]: t for t in ts}
    for q in sorted(qs, key=lambda q: q["ord"]):
        v = vector(q)
        cos = sorted(((-round(sum(x * vt[t].get(g, 0) for g, x in v.items()), 9), t) for t in vt))
        found = {t for c, t in cos[:20] if -c > 0.15} | {t for k in composite_keys(q) for t in index.get(k, [])[:30]} | {t for a in q["aliases"] for t in index.get(("core", a), [])[:10]}
        want |= {(q["id"], t) for t in found}
        for t in found:
            t = target[t]
            if q["cc"] and t["cc"] and q["cc"] != t["cc"]:
                continue
            name = max(K["token_sort"](q["core"], t["core"]), K["jaro_winkler"](q["core"], t["core"]), K["token_sort"](q["norm"], t["norm"]), *(K["token_sort"](a, b) for a in q["aliases"] for b in t["aliases"]), 0)
            x, y = set(q["addr"].split()), set(t["addr"].split())
            sim = len(x & y) / len(x | y) if x and y else 0.0
            if name >= 0.30:
                score = min(1.0, name + 0.10 * (q["postal"] != "" and q["postal"] == t["postal"]) + 0.05 * (q["street"] != "" and q["street"] == t["street"]) + 0.05 * (sim > 0.5))
                if t["id"] not in claims or (round(score, 9), round(sim, 9)) > claims[t["id"]][:2]:
                    claims[t["id"]] = round(score, 9), round(sim, 9), q["id"]
    n = Counter(x[2] for x in claims.values())
    matches = sorted((q, t, s) for t, (s, sim, q) in claims.items() if n[q] > 1 or s >= 0.82 or sim >= 0.60)
    got = resolve_composite(e.where("source = 1"), e.where("source > 1"))
    assert {(r.s1_id, r.target_id) for r in got.candidates.collect()} == want
    assert sorted((r.s1_id, r.target_id, round(r.score, 9)) for r in got.matches.collect()) == matches
