"""DuckDB SQL with the meaning of each query, over the same Parquet tables.

A chain of common table expressions restates the records; each query then selects from it. Fuzzy scores come from
similarity_sql, for names of any length. Models and folds by Spark's hash have none here; they are tested against plain
Python where they are exact.
"""
from __future__ import annotations

from ..functions import words as W
from . import similarity_sql as Q
from .profiles import EXACT, PROFILES, V6, Profile

FIXTURE = r"""
w as (select doc_id, lang, string_split(trim(regexp_replace(lower(regexp_replace(translate(text, 'üêÓíéÍçÜäóÖÉÈñöÊÄÑÇè', 'ueOieIcUaoOEEnoEANCe'), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ') t from documents),
st as (select *, array_to_string(list_slice(t, 1, 3), ' ') stem from w),
cl as (select *, min(doc_id) over (partition by stem) cid, row_number() over (partition by stem order by doc_id) rn from st),
ent as (select case when rn = 1 then 'S1-' when doc_id % 2 = 0 then 'S2-' else 'S3-' end || doc_id::varchar entity_id,
  case when doc_id % 13 = 0 and rn > 1 then coalesce(t[3], '') || ' ' || t[1] || ' ' || coalesce(t[2], '') else stem end
  || case doc_id % 5 when 0 then ' Inc.' when 1 then ' LLC' when 2 then ' Pvt Ltd' when 3 then ' & Co' else '' end
  || case when doc_id % 17 = 0 then ' dba ' || coalesce(t[4], 'north') || ' ' || coalesce(t[5], 'star') else '' end as name,
  case when doc_id % 31 = 0 then '' else (100 + cid % 900 + case when doc_id % 11 = 0 and rn > 1 then 1 else 0 end)::varchar || ' ' || coalesce(t[2], 'main') || ' '
    || case doc_id % 3 when 0 then 'St' when 1 then 'Road' else 'Ave' end || case when doc_id % 7 = 0 then '' else ' ' || (10000 + cid % 90000)::varchar end end as address,
  case lang when 'en' then 'US' when 'fr' then 'France' when 'de' then 'India' else '' end as country, cid, doc_id,
  (case when rn = 1 then 1 when doc_id % 2 = 0 then 2 else 3 end)::bigint as source from cl)"""


def _list(words) -> str:
    return "[" + ",".join("'" + w + "'" for w in words) + "]"


def _map(table: dict) -> str:
    return "map {" + ",".join(f"'{k}': {v!r}" for k, v in table.items()) + "}"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def basic(x: str) -> str:
    return squeeze(rf"regexp_replace(replace(lower({fold(x)}), '&', ' and '), '[^a-z0-9\s]', ' ', 'g')")


def norm(x: str, domains=W.DOMAINS) -> str:
    low = f"replace(lower({fold(x)}), '&', ' and ')"
    low = rf"regexp_replace({low}, '[\(\[\{{]\s*id\s*:\s*\d+\s*[\)\]\}}]', ' ', 'g')"
    low = rf"regexp_replace({low}, '\bid\s*:\s*\d+\b', ' ', 'g')"
    low = "regexp_replace(" + low + ", '(" + "|".join(d.replace(".", r"\.") for d in domains) + r")\b', '', 'g')"
    return squeeze(rf"regexp_replace(replace({low}, '@', ' '), '[^a-z0-9\s]', ' ', 'g')")


def punct(x: str) -> str:
    return squeeze(rf"""regexp_replace(lower({fold(x)}), '[&@#.!?*()\[\]{{}};:,"''\\/\-_+=|~`]', ' ', 'g')""")


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda v: v <> '')"


def without(x: str, words) -> str:
    return f"list_filter({x}, lambda v: not list_contains({_list(words)}, v))"


def core(x: str) -> str:
    """The core of a normalised name, for use inside a lambda too."""
    j = f"array_to_string(list_filter(string_split({x}, ' '), lambda u: u <> '' and not list_contains({_list(W.LEGAL)}, u)), ' ')"
    return f"(case when {j} <> '' then {j} else {x} end)"


def phones(x: str) -> str:
    bare = rf"regexp_replace({x}, '[\s\-\(\)\+\.]', '', 'g')"
    return rf"list_concat(regexp_extract_all({bare}, '\d{{10,}}'), regexp_extract_all({bare}, '\d{{7,9}}'))"


def both(a: str, b: str) -> str:
    return f"(case when {a} <> '' and {b} <> '' then {a} || '_' || {b} else '' end)"


def pipe(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


_DIST = f"list_sort(list_distinct(list_filter(atoks, lambda v: length(v) >= 3 and not list_contains({_list(W.generic_address_words())}, v) and not regexp_matches(v, '^\\d+$'))))"

RECORDS = FIXTURE + f""",
r0 as (select *, source * 1099511627776 + doc_id as ord, {norm('name')} as norm, {norm('address')} as norm_addr,
  coalesce({_map(W.COUNTRIES)}[lower(trim(country))], substr(lower(trim(country)), 1, 2)) as cc,
  length(regexp_replace(name, '[^a-zA-Z]', '', 'g')) < 3 and length(trim(name)) >= 3 as non_ascii, {phones("address || ' ' || name")} as phones_raw from ent),
r1 as (select *, {toks('norm')} as toks, {toks('norm_addr')} as atoks from r0),
r2 as (select *, {without('toks', W.LEGAL)} as core_toks, array_to_string(list_transform(toks, lambda v: coalesce({_map(W.ABBREVIATIONS)}[v], v)), ' ') as exp_norm,
  regexp_extract(norm_addr, '\\b(\\d{{5,6}})\\b', 1) as postal, array_to_string(list_transform(atoks, lambda v: coalesce({_map(W.STATES | W.STREETS)}[v], v)), ' ') as clean_addr, {_DIST} as dist_addr,
  case when len(string_split_regex(norm, '\\b(?:{'|'.join(W.ALIAS_WORDS)})\\b')) > 1
    then list_filter(list_transform(string_split_regex(norm, '\\b(?:{'|'.join(W.ALIAS_WORDS)})\\b'), lambda v: trim(v)), lambda v: length(v) >= 3) else []::varchar[] end as alias_parts from r1),
r3 as (select *, case when len(core_toks) > 0 then array_to_string(core_toks, ' ') else norm end as core, {core('exp_norm')} as exp_core, coalesce(array_to_string(list_sort(core_toks), ' '), '') as sorted_key,
  coalesce(array_to_string(core_toks, ''), '') as concat_key, list_filter(toks, lambda v: length(v) >= 3 and not list_contains({_list(W.generic_words())}, v)) as brand,
  list_filter(list_transform(alias_parts, lambda v: {core('v')}), lambda v: v <> '') as aliases,
  coalesce(list_filter(regexp_extract_all(norm_addr, '\\b\\d{{1,5}}[a-z]?\\b'), lambda v: v <> postal)[1], '') as num, {phones('clean_addr')} as phones_addr,
  cast(coalesce(list_reduce(list_transform(toks, lambda v: coalesce({_map(W.category_bits())}[v], 0)), lambda a, b: a | b, 0), 0) as bigint) as cat from r2),
r4 as (select *, replace(core, ' ', '') as bare, coalesce(array_to_string(list_sort(list_slice(brand, 1, 2)), '_'), '') as bigram,
  case when num <> '' then list_transform(list_slice(dist_addr, 1, 2), lambda v: num || '_' || v) else []::varchar[] end as addr_keys from r3),
r5 as (select *, case when length(bare) >= 3 then substr(bare, 1, 3) else '' end as prefix3, case when length(bare) >= 4 then substr(bare, 1, 4) else '' end as prefix4 from r4),
rec as (select *, {both('num', 'prefix3')} as num_prefix, {both('postal', 'prefix3')} as post_prefix, {both('postal', 'num')} as post_num, {both('prefix4', 'cc')} as pfx4_country,
  {both('postal', 'prefix4')} as post_prefix4 from r5),
ids as (select entity_id as s1_id, cid from ent where source = 1),
gold as (select s1_id, entity_id as target_id from ids left join (select * from ent where source > 1) t using (cid)),
links as (select * from gold where target_id is not null)"""

_CITY = f"coalesce(list_filter(atoks, lambda v: length(v) >= 4 and not list_contains({_list(W.generic_address_words())}, v) and not regexp_matches(v, '^\\d+$'))[-1], '')"


def soundex(x: str) -> str:
    u = f"upper({x})"
    d = f"translate({u}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    kept = f"list_transform(list_filter(range(2, length({x}) + 1), lambda i: substr({d}, i, 1) <> '0' and substr({d}, i, 1) <> substr({d}, i - 1, 1)), lambda i: substr({d}, i, 1))"
    return f"(case when regexp_full_match({u}, '[A-Z]+') then rpad(substr({u}, 1, 1) || coalesce(array_to_string(list_slice({kept}, 1, 3), ''), ''), 4, '0') else '' end)"


def domain(x: str) -> str:
    host = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + fold(x) + r"), '^https?://', ''), '^[^@/]*@', ''), '^(www|m)\.', ''), '/.*$', ''), '\.[a-z.]+$', ''), '[^a-z0-9]', '', 'g')"
    return f"(case when length({host}) >= 4 then {host} else '' end)"


def route_list(route: str, query: bool, brand_words: int = 6, expanded: bool = True) -> str:
    first = "coalesce(core_toks[1], '')"
    return {
        "core": "list_concat([core" + (", case when exp_core <> core then exp_core else '' end" if expanded else "") + "], aliases)",
        "brand": f"list_slice(brand, 1, {brand_words})" if query else "brand",
        "sorted": "[sorted_key]", "concat": "[case when length(concat_key) >= 5 then concat_key else '' end]", "num_prefix": "[num_prefix]", "post_prefix": "[post_prefix]", "post_num": "[post_num]",
        "pfx4_country": "[pfx4_country]", "bigram": "[bigram]", "post_prefix4": "[post_prefix4]", "addr_key": "addr_keys", "phone": "phones_raw", "char4": "[prefix4]",
        "city_num": f"[{both(_CITY, 'num')}]", "post_dist": f"[{both('postal', 'coalesce(dist_addr[1], ' + chr(39) * 2 + ')')}]",
        "soundex": f"[{soundex(first)}]", "domain": f"[{domain('name')}]",
        "first_prefix5": f"[case when length({first}) >= 4 then substr({first}, 1, 5) else '' end]", "first_prefix4": f"[case when length({first}) >= 4 then substr({first}, 1, 4) else '' end]",
    }[route]


def keys(name: str, routes, query: bool, brand_words: int = 6, expanded: bool = True) -> str:
    parts = [f"select '{r}' as route, entity_id as id, ord, {route_list(r, query, brand_words, expanded)} as ks from rec where source {'= 1' if query else '> 1'}" for r in routes]
    return f"{name}_l as ({' union all '.join(parts)}),\n{name}_u as (select route, id, ord, unnest(ks) as key, generate_subscripts(ks, 1) as pos from {name}_l),\n{name} as (select * from {name}_u where key <> '')"


def found(caps: dict, brand_words: int = 6, expanded: bool = True, alias_cap: int | None = None) -> str:
    """Common tables qk, tk and found(s1_id, target_id, route) under caps."""
    cap = _map({k: int(v) for k, v in caps.items()})
    kept = f"select * from ranked where rn <= {cap}[route]"
    if alias_cap:  # after the first alias_cap rows of a core key its cores only, up to the cap
        late = f"select *, row_number() over (partition by key order by rn) as late from ranked where route = 'core' and pos = 1 and rn > {alias_cap}"
        kept = f"select route, key, id from ranked where rn <= case when route = 'core' then {alias_cap} else {cap}[route] end union all select route, key, id from ({late}) where late <= {caps['core'] - alias_cap}"
    return f"""{keys('qk', caps, True, brand_words, expanded)},
{keys('tk', caps, False, brand_words, expanded)},
need as (select tk.* from tk semi join qk using (route, key)),
ranked as (select *, row_number() over (partition by route, key order by ord, pos) as rn from need),
capped as ({kept}),
found as (select distinct qk.id as s1_id, capped.id as target_id, route from qk join capped using (route, key))"""


_CARRIED = ["core", "exp_core", "sorted_key", "concat_key", "norm", "aliases", "clean_addr", "postal", "num", "dist_addr", "cc", "non_ascii", "phones_raw", "phones_addr", "cat", "brand"]


def joined(name: str, source: str) -> str:
    cols = ", ".join(f"s.{c} as s_{c}, t.{c} as t_{c}" for c in _CARRIED)
    return f"""{name}_j as (select p.s1_id, p.target_id, s.ord as s_ord, t.ord as t_ord, {cols} from {source} p join rec s on s.entity_id = p.s1_id join rec t on t.entity_id = p.target_id),
{name} as (select *, s_postal <> '' and s_postal = t_postal as pm, s_num <> '' and s_num = t_num as nm, s_postal <> '' and t_postal <> '' and s_postal <> t_postal as pc,
  s_num <> '' and t_num <> '' and s_num <> t_num as nc, cast(len(list_intersect(s_dist_addr, t_dist_addr)) as bigint) as overlap, s_clean_addr <> '' as has_s, t_clean_addr <> '' as has_t,
  s_clean_addr <> '' and t_clean_addr <> '' as both_addr from {name}_j)"""


def jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"(case when len({a}) > 0 and len({b}) > 0 then {n}::double / (len(list_distinct({a})) + len(list_distinct({b})) - {n}) else 0.0 end)"


def fixed(expanded: bool) -> str:
    exp = "when s_core <> '' and t_core <> '' and s_exp_core <> '' and t_exp_core <> '' and s_exp_core = t_exp_core and s_exp_core <> s_core then 0.94" if expanded else ""
    return f"""cast(case when s_core <> '' and s_core = t_core then 0.95 {exp} when list_contains(s_aliases, t_core) or list_contains(t_aliases, s_core) then 0.94
  when s_sorted_key <> '' and s_sorted_key = t_sorted_key then 0.92
  when s_concat_key <> '' and (s_concat_key = t_concat_key or s_concat_key = replace(t_norm, ' ', '')) then case when pm or nm or overlap >= 1 or not has_s then 0.90 else 0.82 end end as double)"""


GATE = "not (both_addr and ((len(s_dist_addr) > 0 and len(t_dist_addr) > 0 and not pm and overlap = 0) or (nc and overlap = 0)))"
GUARD = "(both_addr or len(string_split(s_core, ' ')) >= 2 or length(s_core) >= 14)"
COUNTRY = "not (s_cc <> '' and t_cc <> '' and s_cc <> t_cc)"

PAIRS = f"""{found(EXACT.caps)},
cand as (select s1_id, target_id, list_sort(list(route)) as routes from found group by all),
{joined('pair', 'cand')}"""
SCORED = f"""{PAIRS},
sc0 as (select *, case when both_addr then {jaccard("string_split(s_clean_addr, ' ')", "string_split(t_clean_addr, ' ')")} end as sim, {fixed(True)} as tier from pair where {COUNTRY} and {GATE} and {GUARD}),
scored as (select s1_id, target_id, coalesce(tier, 0.0) as score, coalesce(sim, 0.5) as a_sim, pm, nm, s_ord, not has_t as t_blank, length(s_core) as core_len from sc0
  where not coalesce(sim < 0.35 or (pc and sim < 0.70), false) and coalesce(tier, 0.0) >= 0.81),
owned as (select * exclude (rn) from (select *, row_number() over (partition by target_id order by score desc, nm desc, pm desc, a_sim desc, s_ord) as rn from scored) where rn = 1),
ownedn as (select *, count(*) over (partition by s1_id) as n from owned),
matches as (select * from ownedn where not (n = 1 and score < 0.84 and a_sim < 0.65))"""


def counts(pred: str, ids: str = "ids") -> str:
    return f"""cnt as (select i.s1_id, coalesce(np, 0)::bigint as n_pred, coalesce(ng, 0)::bigint as n_gold, coalesce(tp, 0)::bigint as n_tp from {ids} i
  left join (select s1_id, count(*) ng from (select distinct * from links) group by 1) g using (s1_id)
  left join (select p.s1_id, count(*) np, count(l.target_id) tp from (select distinct s1_id, target_id from {pred}) p left join (select distinct * from links) l using (s1_id, target_id) group by 1) q using (s1_id)),
f05 as (select *, cast(case when n_pred = 0 and n_gold = 0 then 1.0 when n_tp = 0 then 0.0 else 1.25 * (n_tp / n_pred) * (n_tp / n_gold) / (0.25 * (n_tp / n_pred) + n_tp / n_gold) end as double) as f from cnt)"""


def sweep(axes: dict, keep: str, order: str) -> str:
    g = ", ".join(axes)
    grid = " cross join ".join(f"(select unnest({v})::double as {a})" for a, v in axes.items())
    return f"""grid as (select * from {grid}), kept as (select scored.*, {g} from scored, grid where {keep}),
own as (select * from (select *, row_number() over (partition by {g}, target_id order by {order}, s_ord) as rn from kept) where rn = 1),
per as (select {g}, s1_id, count(*) as np, count(l.target_id) as tp from own left join links l using (s1_id, target_id) group by all),
ng as (select s1_id, count(target_id) as n_gold from gold group by 1),
ev as (select {', '.join('grid.' + a for a in axes)}, ng.s1_id, n_gold, coalesce(np, 0) as n_pred, coalesce(tp, 0) as n_tp from grid cross join ng left join per on per.s1_id = ng.s1_id and {' and '.join(f'per.{a} = grid.{a}' for a in axes)}),
fx as (select *, cast(case when n_pred = 0 and n_gold = 0 then 1.0 when n_tp = 0 then 0.0 else 1.25 * (n_tp / n_pred) * (n_tp / n_gold) / (0.25 * (n_tp / n_pred) + n_tp / n_gold) end as double) as f from ev)
select {g}, round(avg(f), 6) as macro_f05, round(coalesce(avg(f) filter (where n_gold = 0), 0), 6) as singleton_accuracy, round(coalesce(avg(f) filter (where n_gold > 0), 0), 6) as non_singleton_f05,
  count(*) as n, count(*) filter (where n_gold = 0) as n_singletons from fx group by {g}"""


ORACLES: dict[str, str] = {}


def _add(name: str, select: str, *tables: str, base: str = RECORDS) -> None:
    ORACLES[name] = "with " + ",\n".join([base, *tables]) + ("\n" if select.startswith("select") else ",\n") + select


def _rec(name: str, **columns: str) -> None:
    _add(name, "select entity_id, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + " from rec")


_add("fixture_entities", "select entity_id, name, address, country, cid, source from ent")
_add("scan_targets_union", "select entity_id, source, source * 1099511627776 + doc_id as ord from ent where source > 1")
_add("scan_entities", "select entity_id, name, address, country from ent")
_add("scan_sniffed", "select entity_id, name, address, country from ent")
_add("scan_quoted", "select entity_id, name || ', x' as name, address, country, cid::varchar as postal_code from ent")
_add("gold_explode", "select s1_id, target_id from gold")
_add("sink_matches", "select s1_id, coalesce(string_agg(distinct target_id, ',' order by target_id), '') as matched_entity_ids from ids left join matches using (s1_id) group by s1_id", SCORED)
_add("sink_candidates", "select s1_id, coalesce(string_agg(distinct target_id, ',' order by target_id), '') as candidate_entity_ids from ids left join cand using (s1_id) group by s1_id", SCORED)
_add("sink_by_score", "select s1_id, coalesce(string_agg(target_id, ',' order by score desc, target_id), '') as matched_entity_ids from ids left join matches using (s1_id) group by s1_id", SCORED)
_add("repair_candidates", "select s1_id, target_id from cand where len(routes) > 1 union select s1_id, target_id from matches", SCORED)
_add("fold_map", "select s1_id, cast(length(s1_id) % 5 as bigint) as fold from ids")
_rec("normalize_text", norm="norm", norm_addr="norm_addr")
_rec("normalize_basic", norm=basic("name"))
_rec("normalize_punctuation", norm=punct("name"))
_rec("normalize_nine_domains", norm=norm("name", [d for d in W.DOMAINS if d not in (".de", ".ca", ".au")]))
_rec("core_tokens", toks=pipe("core_toks"), short_list=pipe(without("toks", W.LEGAL_FEATURES)))
_rec("core_name", core="core")
_rec("sorted_key", k="sorted_key")
_rec("concat_key", k="concat_key", full="replace(norm, ' ', '')")
_rec("distinctive_tokens", toks=pipe("brand"), long_toks=pipe("list_slice(list_filter(brand, lambda v: length(v) >= 4), 1, 5)"))
_rec("alias_split", parts=pipe("alias_parts"), cores=pipe("aliases"))
_rec("expand_abbrev", exp="exp_norm", exp_core="exp_core")
_rec("country_norm", cc="cc", plain="lower(trim(country))")
_rec("non_ascii_name", non_ascii="non_ascii", latin=r"not regexp_matches(name, '[^\x00-\x7F]')")
_rec("address_parts", postal="postal", num="num", clean="clean_addr", dist=pipe("dist_addr"))
_rec("address_parts_simple", postal=r"regexp_extract(address, '(\d{5,6})', 1)", num=r"regexp_extract(address, '\b(\d{1,5})\b', 1)", first_digits=r"regexp_replace(regexp_extract(norm_addr, '(\d+)', 1), '^0+', '')",
     street=r"regexp_extract(address, '^\s*(\d+)', 1)")
_V5_POSTAL = r"(case when regexp_extract({0}, '\b(\d{{5}})\b', 1) <> '' then regexp_extract({0}, '\b(\d{{5}})\b', 1) else regexp_extract({0}, '\b([1-9]\d{{5}})\b', 1) end)"
_V5_DIST = f"list_slice(list_filter(atoks, lambda v: length(v) >= 3 and not list_contains({_list(W.generic_address_words_calibrated())}, v) and not regexp_matches(v, '^\\d+$')), 1, 8)"
_rec("address_v5", postal=_V5_POSTAL.format("(norm_addr || case when doc_id % 7 = 0 then ' 560001 012345' else '' end)"), tokens=pipe(_V5_DIST))
_CFULL = f"array_to_string(list_transform({toks(punct('name'))}, lambda v: coalesce({_map(W.COMPOSITE_ABBREVIATIONS)}[v], v)), ' ')"
_CCORE = f"array_to_string({without(f'string_split({_CFULL}, chr(32))', sorted({*W.COMPOSITE_LEGAL, *W.COMPOSITE_GENERIC}))}, ' ')"
_CIN = "case " + " ".join(f"when contains({punct('address')}, '{k}') then '{v}'" for k, v in W.COMPOSITE_COUNTRIES.items()) + " else '' end"
_rec("composite_text", core=f"case when {_CCORE} <> '' then {_CCORE} else {_CFULL} end", aliases=pipe(f"list_filter(list_transform(string_split_regex(name, '(?i)\\b(?:{'|'.join(W.COMPOSITE_ALIAS_WORDS)})\\b'), lambda v: {punct('v')}), lambda v: length(v) > 2)"),
     cc=f"case when {punct('country')} <> '' then coalesce({_map(W.COMPOSITE_COUNTRIES)}[{punct('country')}], substr({punct('country')}, 1, 2)) else {_CIN} end",
     street=f"regexp_extract({punct('address')}, '^(\\d+)', 1)", postal="substr(postal, 1, 5)", phone="right(regexp_replace('+1 (555) 010-' || (1000 + doc_id)::varchar, '[^0-9]', '', 'g'), 10)")
_rec("address_clean_parts", postal="regexp_extract(clean_addr, '\\b(\\d{5,6})\\b', 1)", num="regexp_extract(clean_addr, '\\b0*(\\d{1,6})\\b', 1)")
_LAST = r"regexp_extract(address, '^.*\b(\d{5,6})\b', 1)"
_POST = rf"(case when len(regexp_extract_all(address, '\b\d{{5,6}}\b')) > 1 or not regexp_matches(address, '^\s*\d{{5,6}}\b') then {_LAST} else '' end)"
_REST = rf"(case when {_POST} <> '' then regexp_replace(address, '^(.*)\b\d{{5,6}}\b', '\1 ') else address end)"
_WORDNO = rf"lower(regexp_extract({_REST}, '(?i)\b(?:no\.?|h\.?no\.?|#|plot|flat|door|suite|bldg)\s*(\d{{1,5}}[a-z]?)\b', 1))"
_LEADNO = rf"lower(regexp_extract({_REST}, '(?i)^\s*(\d{{1,5}}[a-z]?)\b', 1))"
_rec("address_raw_parts", postal=_POST, num=rf"case when {_WORDNO} <> '' then {_WORDNO} when {_LEADNO} <> '' then {_LEADNO} else regexp_extract({_REST}, '\b(\d{{1,4}})\b', 1) end")
_STREETNO = r"regexp_extract(norm_addr, '\b(\d{1,5})\s+(?:[a-z]+\s+)?(?:st|street|rd|road|ave|avenue|blvd|lane|dr|drive|way|court|ct|boulevard|rue|all|imp)\b', 1)"
_AFTER = r"regexp_extract(norm_addr, '\b(?:no|hno|plot|shop|flat|door)\s*(\d+)\b', 1)"
_rec("street_number", num=rf"case when regexp_extract(norm_addr, '^(\d+)\b', 1) <> '' then regexp_extract(norm_addr, '^(\d+)\b', 1) when {_AFTER} <> '' then {_AFTER} else {_STREETNO} end")
_NINE = [".com", ".in", ".org", ".net", ".co", ".io", ".fr", ".co.uk", ".eu"]
_V5_ALIAS = "\\b(?:aka|dba|fka|doing business as|trading as)\\b"
_V5_IN = " + ".join(f"(case when {' or '.join(f'contains(norm, {chr(39)}{w}{chr(39)})' for w in ws)} then {1 << i} else 0 end)" for i, ws in enumerate(W.CATEGORY_PARTS))
CALIBRATED = FIXTURE + f""",
a as (select *, source * 1099511627776 + doc_id as ord, {norm('name', _NINE)} as norm, {norm('address', _NINE)} as norm_addr, {norm('country', _NINE)} as cc,
  length(regexp_replace(name, '[^a-zA-Z]', '', 'g')) < 3 and length(trim(name)) >= 3 as non_ascii from ent),
b as (select *, {without(toks('norm'), W.LEGAL_CALIBRATED)} as core_toks, {toks('norm_addr')} as atoks, {_V5_POSTAL.format('norm_addr')} as postal,
  case when regexp_extract(norm_addr, '^(\\d+)\\b', 1) <> '' then regexp_extract(norm_addr, '^(\\d+)\\b', 1) when {_AFTER} <> '' then {_AFTER} else {_STREETNO} end as num from a),
c as (select *, coalesce(array_to_string(core_toks, ' '), '') as core, {_V5_DIST} as dist_addr, norm_addr as clean_addr, '' as exp_core, []::varchar[] as phones_raw, []::varchar[] as phones_addr,
  list_slice(list_filter(core_toks, lambda v: length(v) >= 4 and not list_contains({_list(W.generic_words_calibrated())}, v)), 1, 5) as brand, cast({_V5_IN} as bigint) as cat,
  case when len(string_split_regex(norm, '{_V5_ALIAS}')) > 1 then list_filter(list_transform(string_split_regex(norm, '{_V5_ALIAS}'), lambda v: trim(v)), lambda v: length(v) >= 3) else []::varchar[] end as aliases from b),
d as (select *, case when length(core) >= 3 then substr(core, 1, 3) else '' end as prefix3, case when length(core) >= 4 then substr(core, 1, 4) else '' end as prefix4,
  coalesce(array_to_string(list_sort(core_toks), ' '), '') as sorted_key, coalesce(array_to_string(core_toks, ''), '') as concat_key, {both('postal', 'num')} as post_num from c),
rec as (select *, {both('num', 'substr(postal, 1, 3)')} as num_prefix, {both('postal', 'prefix3')} as post_prefix, {both('postal', 'prefix4')} as post_prefix4,
  case when postal <> '' and num <> '' and prefix3 <> '' then [num || '_' || postal || '_' || prefix3] else []::varchar[] end as addr_keys from d)"""
_add("prepare_v5", f"""select entity_id, norm, core, sorted_key, concat_key, cc, postal, num, num_prefix, post_prefix, post_prefix4, {pipe('addr_keys')} as addr_keys, {pipe('brand')} as brand,
  {pipe('dist_addr')} as dist_addr, {pipe('aliases')} as aliases, cat from rec""", base=CALIBRATED)
_rec("soundex_key", code=soundex("coalesce(core_toks[1], '')"))
_rec("phone_tokens", phones=pipe(phones("name || ' +1 (555) 010-' || (1000 + doc_id)::varchar")))
_rec("prefix_key", p3="prefix3", p4="prefix4")
_rec("first_token_prefix", **{f"p{n}": f"case when length(coalesce(core_toks[1], '')) >= {least} then substr(core_toks[1], 1, {n}) else '' end" for n, least in ((5, 4), (4, 4), (3, 1))})
_rec("bigram_key", k="bigram", smallest="case when len(core_toks) >= 2 then array_to_string(list_slice(list_sort(core_toks), 1, 2), '_') else '' end")
_rec("addr_keys", k2=pipe("addr_keys"), k4=pipe("case when num <> '' then list_transform(list_slice(dist_addr, 1, 4), lambda v: num || '_' || v) else []::varchar[] end"))
_rec("composite_keys", **{k: k for k in ("num_prefix", "post_prefix", "post_num", "pfx4_country", "post_prefix4")})
_rec("extract_city", city=_CITY)


def grams(x: str, n: int) -> str:
    return f"(case when {x} = '' then []::varchar[] when length({x}) < {n} then [{x}] else list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))) end)"


_rec("char_ngrams", grams=pipe(f"list_sort({grams('norm', 3)})"), four=pipe(f"list_sort({grams('replace(norm, chr(32), chr(0))', 4)})").replace("chr(0)", "''"))
_PADDED = "list_concat(list_transform(range(1, length(core) + 2), lambda i: substr(' ' || core || ' ', i, 2)), list_transform(range(1, length(core) + 1), lambda i: substr(' ' || core || ' ', i, 3)))"
_rec("padded_grams", grams=pipe(f"list_sort({_PADDED})"))
_inside = " + ".join(f"(case when {' or '.join(f'contains(nx, {chr(39)}{w}{chr(39)})' for w in ws)} then {1 << i} else 0 end)" for i, ws in enumerate(W.CATEGORY_PARTS))
_mask = f"cast(list_reduce(list_transform({toks('nm')}, lambda v: coalesce({_map(W.category_bits())}[v], 0)), lambda a, b: a | b, 0) as bigint)"
_class = _map({w: ws[0] for ws in W.CATEGORY_WORDS for w in ws})
_add("category_mask", f"select entity_id, {_mask} as mask, cast({_inside} as bigint) as inside, {pipe(f'list_sort(list_distinct(list_filter(list_transform({toks(chr(110)+chr(99))}, lambda v: {_class}[v]), lambda v: v is not null)))')} as classes from cm",
     "cm as (select entity_id, norm || ' hotel bank' || case when doc_id % 2 = 0 then ' tech' else '' end as nm, norm || 'inner bankers' as nx, norm || ' motel gym' as nc from rec)")
_rec("source_tag", is_s2="contains(lower(entity_id), 's2')", is_s3="contains(lower(entity_id), 's3')")
_rec("prepare_record", norm="norm", core="core", sorted_key="sorted_key", concat_key="concat_key", postal="postal", num="num", cc="cc", cat="cat")
_DOMAIN = f"pg as (select page_id, {domain('url')} as token from pages)"
ORACLES["domain_token"] = f"with {_DOMAIN} select page_id, token from pg"
ORACLES["route_domain"] = f"with {_DOMAIN}, ix as (select * from (select *, row_number() over (partition by token order by page_id) as rn from pg where token <> '') where rn <= 20) select a.page_id as a, b.page_id as b from pg a join ix b on a.token = b.token and a.page_id <> b.page_id"


def _gp(name: str, **columns: str) -> None:
    _add(name, "select s1_id, target_id, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + " from gp", joined("gp", "links"))


_gp("jaccard", tokens=f"""round({jaccard("string_split(s_norm, ' ')", "string_split(t_norm, ' ')")}, 9)""", dist=f"round({jaccard('s_dist_addr', 't_dist_addr')}, 9)")
_gp("overlap_count", overlap="overlap", share="case when greatest(len(s_dist_addr), len(t_dist_addr)) > 0 then round(overlap / greatest(len(s_dist_addr), len(t_dist_addr)), 9) else 0.0 end")
_EDIT = "(least(length(s_core), length(t_core)) between 3 and 7 and greatest(length(s_core), length(t_core)) <= 8 and levenshtein(s_core, t_core) <= 1)"
_gp("levenshtein_one", edit=_EDIT)
_gp("jaro_winkler", jw="round(jaro_winkler_similarity(s_norm, t_norm), 6)")
for _k in ("ratio", "token_sort", "token_set", "partial", "weighted"):
    _add(f"fuzz_{_k}", f"select s1_id, target_id, round({_k}, 9) as score from gp join kn on a = s_norm and b = t_norm", joined("gp", "links"), Q.kernels("kn", "select s_norm as a, t_norm as b from gp", True))
_gp("match_flags", pm="pm", nm="nm", pc="pc", nc="nc")
_gp("country_relation", fe="cast(case when s_cc = '' or t_cc = '' then -1 when s_cc = t_cc then 1 else 0 end as double)", v4="cast(case when s_cc = '' or t_cc = '' then 0 when s_cc = t_cc then 1 else -1 end as double)")
ORACLES["cosine_embeddings"] = """with e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select q.id as q, e.id as t, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) as cos from e q, e where q.id % 100 = 0 and q.id <> e.id),
r as (select *, row_number() over (partition by q order by round(cos, 9) desc, t) as rank from c) select q, t, round(cos, 6) as cos, rank from r where rank <= 10"""
for _r, _cap in (V6.caps | {"post_prefix4": 20, "city_num": 20, "char4": 15, "post_dist": 20, "first_prefix5": 20, "first_prefix4": 100, "soundex": 150}).items():
    _add(f"route_{_r}", "select distinct s1_id, target_id from found", found({_r: _cap}))
_add("route_rare_token", "select distinct a.id as s1_id, b.id as target_id from rw a join (select * from ri where rn <= 200) b using (key)",
     "rw as (select entity_id as id, ord, unnest(list_distinct(list_filter(core_toks, lambda v: length(v) >= 4))) as key from rec where source = 1)",
     "rt as (select entity_id as id, ord, unnest(list_distinct(list_filter(core_toks, lambda v: length(v) >= 4))) as key from rec where source > 1)",
     "rf as (select key from rt group by key having count(*) <= greatest(5, floor(0.005 * (select count(*) from rec where source > 1))))",
     "ri as (select rt.*, row_number() over (partition by key order by ord) as rn from rt semi join rf using (key))")
_GRAMS = f"""pgr as (select entity_id as id, source, {_PADDED} as gs from rec),
gdf as (select gram, ln((n + 1) / (count(*) + 1)) + 1 as idf from (select unnest(list_distinct(gs)) as gram from pgr where source > 1), (select count(*) as n from pgr where source > 1) group by gram, n having count(*) >= 2 and count(*) <= 0.3 * n),
gtf as (select id, source, gram, count(*) * any_value(idf) as w from (select id, source, unnest(gs) as gram from pgr) join gdf using (gram) group by all),
gw as (select id, source, gram, w / sqrt(sum(w * w) over (partition by id)) as w from gtf),
gc as (select a.id as s1_id, b.id as target_id, sum(a.w * b.w) as cos from gw a join gw b using (gram) where a.source = 1 and b.source > 1 group by 1, 2),
gr as (select *, row_number() over (partition by s1_id order by round(cos, 9) desc, target_id) as rank from gc where cos > 0.15)"""
_add("route_tfidf_topk", "select s1_id, target_id, round(cos, 6) as cos, rank from gr where rank <= 20", _GRAMS)
_WORDGRAMS = "list_concat(list_transform(range(1, greatest(length(v), 1) + 1), lambda i: substr(' ' || v || ' ', i, 3)), list_transform(range(1, length(v)), lambda i: substr(' ' || v || ' ', i, 4)))"
_add("tfidf_word_grams", "select s1_id, target_id, round(cos, 6) as cos, rank from gr where rank <= 40", _GRAMS.replace(_PADDED, f"flatten(list_transform(toks, lambda v: {_WORDGRAMS}))").replace("where cos > 0.15", "where cos > 0"))
_add("gate_three_way", sweep({"tau2": [0.82, 0.94], "tau3": [0.9, 0.94], "tau_gate": [0.82, 0.93]}, "score >= case when target_id like 'S2%' then tau2 else tau3 end and best >= tau_gate", "score desc").replace("from scored, grid", "from (select *, max(score) over (partition by s1_id) as best from scored) scored, grid"), SCORED)
_add("order_check", "select line_no, s1_id, expected from (select row_number() over (order by s1_id) as line_no, s1_id as expected from ids) full join (select row_number() over (order by s1_id) as line_no, s1_id from ids where s1_id <> (select s1_id from ids order by s1_id limit 1 offset 5)) using (line_no) where s1_id is distinct from expected")
_add("needed_keys", "select route, count(*) as n_keys, count(distinct id) as n_targets from need group by route", found(EXACT.caps))
_add("cap_per_key", "select route, key, id from (select *, row_number() over (partition by route, key order by ord, pos) as rn from bk) where rn <= 3", keys("bk", ["brand"], False))
ORACLES["part_brand_cap"] = "select p_name as key, p_partkey as id from (select *, row_number() over (partition by p_name order by p_partkey) as rn from part) where rn <= 5"
_add("route_union", f"select s1_id, target_id, {pipe('routes')} as routes from cand", PAIRS)
_add("incremental_recall", "select step, route, captured, total, round(captured / total, 6) as recall, round(100 * (captured - first_value(captured) over (order by step)) / total, 6) as gain, round((select count(*) from cand) / (select count(*) from ids), 6) as mean_candidates from st2",
     PAIRS, f"ro as (select unnest({_list(EXACT.caps)}) as route, generate_subscripts({_list(EXACT.caps)}, 1) as step)",
     "fs as (select l.s1_id, l.target_id, min(step) as step from links l left join (select * from found join ro using (route)) using (s1_id, target_id) group by all)",
     "st2 as (select cast(ro.step as bigint) as step, route, (select count(*) from fs where fs.step <= ro.step) as captured, (select count(*) from fs) as total from ro)")
_add("country_theta", f"select s1_id, target_id from pair where {COUNTRY}", PAIRS)
_add("core_postal_join", "select s1_id, target_id from strict union select rq.entity_id, lone.target_id from rq join lone on rq.core = lone.core where rq.cc = '' or lone.cc = '' or rq.cc = lone.cc",
     "strict as (select distinct a.entity_id as s1_id, b.entity_id as target_id from rec a join rec b on a.core = b.core and a.postal = b.postal where a.source = 1 and b.source > 1 and a.core <> '' and a.postal <> '')",
     "lone as (select core, min(entity_id) as target_id, min(cc) as cc from rec where source > 1 and core <> '' group by core having count(*) = 1)",
     "rq as (select * from rec where source = 1 and core <> '' and entity_id not in (select s1_id from strict))")
_add("core_count_join", "select a.entity_id as s1_id, b.entity_id as target_id from rec a join rec b on a.core = b.core join cn on cn.core = a.core where a.source = 1 and b.source > 1",
     "cn as (select core from rec where source > 1 and length(core) >= 4 group by core having count(*) = 1 or (count(*) <= 3 and length(core) >= 8))")
_add("anti_join_ids", "select target_id from links where target_id not in (select entity_id from ent where source = 2)")
_gp("gold_lookup", s_cc="s_cc", t_cc="t_cc", t_core="t_core")
_add("global_truncate", "select s1_id, array_to_string(list_slice(list_sort(list(target_id)), 1, 5), ',') as ids from cand group by s1_id", PAIRS)
_add("candidate_rank_pool", "select s1_id, target_id, row_number() over (partition by s1_id order by target_id) as cand_rank, count(*) over (partition by s1_id) as pool_size from cand", PAIRS)
_add("address_gate", f"select s1_id, target_id from pair where {GATE}", PAIRS)
_add("missing_address_guard", f"select s1_id, target_id from pair where {GUARD}", PAIRS)
_add("category_veto", "select s1_id, target_id from (select s1_id, target_id, case when s_num > '500' then 4 else s_cat end as sc, case when t_postal > '10500' then 8 else t_cat end as tc from pair) where not (sc <> 0 and tc <> 0 and (sc & tc) = 0)", PAIRS)
_add("fixed_tiers", f"select s1_id, target_id, {fixed(True)} as tier from pair", PAIRS)
_add("tier_score_exact", "select s1_id, target_id, score, round(a_sim, 9) as a_sim, pm, nm from scored", SCORED)
_add("resolve_exact", "select s1_id, target_id, score, round(a_sim, 9) as a_sim, pm, nm from matches", SCORED)
_add("mutual_best", "select target_id, s1_id, score from owned", SCORED)
_add("owner_by_score_and_address", "select target_id, s1_id from (select *, row_number() over (partition by target_id order by score desc, round(a_sim, 9) desc, s_ord) as rn from scored) where rn = 1", SCORED)
_add("gate_lone", "select s1_id, target_id from ownedn where not (n = 1 and score < 0.93 and a_sim < 0.9)", SCORED)
_FEW = "(pm::int + nm::int + (a_sim >= 0.65)::int < 2)"
_add("gate_signals", f"select s1_id, target_id from ownedn where not (n = 1 and score < 0.90 and {_FEW} and (score < 0.84 or (core_len < 5 and score < 0.87)))", SCORED)
_add("gate_blank_address", "select s1_id, target_id from ownedn where not (n = 1 and ((score < 0.84 and a_sim < 0.65) or (t_blank and score < 0.95)))", SCORED)
_add("gate_short", f"select s1_id, target_id from ownedn where not (n = 1 and {_FEW} and (score < 0.94 or core_len < 5))", SCORED)
_add("gate_blank_targets", "select s1_id, target_id from (select *, bool_and(t_blank) over (partition by s1_id) as blank from ownedn) where not (blank and s_ord % 2 = 0) and not (n = 1 and score < 0.93 and a_sim < 0.65)", SCORED)
_add("gate_fuzzy_only", "select s1_id, target_id from (select *, max(score) over (partition by s1_id) as best, max(a_sim) over (partition by s1_id) as near from ownedn) where not (best <= 0.92 and near < 0.80)", SCORED)
_add("gate_probability", "select s1_id, target_id from ownedn where not (n = 1 and score < 0.94)", SCORED)
_add("confidence_gate", "select s1_id, target_id from owned semi join ok using (s1_id)", SCORED,
     "ok as (select s1_id from owned group by s1_id having max(score) >= 0.95 or (max(score) >= 0.85 and arg_max(nm, row(score, target_id))))")
_add("hybrid_ensemble", "select target_id, s1_id, round(weight, 9) as weight from (select *, row_number() over (partition by target_id order by weight desc, s_ord) as rn from en) where rn = 1", SCORED,
     "en as (select s1_id, target_id, 0.90 + 0.05 * score as weight, s_ord from matches union all select s1_id, target_id, cast(0.5 + 0.1 * overlap as double), s_ord from pair where 0.5 + 0.1 * overlap >= 0.6 and nm)")
_add("match_histogram", "select least(n, 11) as matches, count(*) as entities from (select s1_id, count(distinct target_id) as n from gold group by 1) group by 1")
_add("gold_stats_country", "select cast(grouping(country) as bigint) as is_total, country, count(*) as entities, count(*) filter (where n = 0) as singletons, sum(n)::bigint as links, sum(n2)::bigint as links_s2, sum(n3)::bigint as links_s3 from gs group by rollup (country)",
     "gs as (select g.s1_id, any_value(rec.cc) as country, count(target_id) as n, count(*) filter (where target_id like 'S2%') as n2, count(*) filter (where target_id like 'S3%') as n3 from gold g join rec on rec.entity_id = g.s1_id group by 1)")
_add("index_percentiles", "select share, n as value from mr join (select unnest([0.5, 0.9, 0.99])::double as share) on rn = floor(total * share) + 1",
     "mr as (select n, row_number() over (order by n) as rn, count(*) over () as total from (select s1_id, count(distinct target_id) as n from gold group by 1))")
_add("exclusivity_audit", "select target_id, count(distinct s1_id) as owners from cand group by 1 having count(distinct s1_id) > 1", PAIRS)
_add("cardinality", "select n_s2, n_s3, count(*) as n from (select s1_id, count(*) filter (where target_id like 'S2%') as n_s2, count(*) filter (where target_id like 'S3%') as n_s3 from gold group by 1) group by all")
_add("idf", "select token, count(*) as df, round(ln((n + 1) / (count(*) + 1)) + 1, 9) as idf from (select unnest(list_distinct(core_toks)) as token from rec where source > 1), (select count(*) as n from rec where source > 1) group by token, n")
_T3 = "list_sort(list({0}), 'desc')[1:3]"
_add("entity_aggregate", f"select s1_id, count(*) as n, count(*) filter (where target_id like 'S2%') as n_s2, count(*) filter (where target_id like 'S3%') as n_s3, max(score) as max_score, round(list_avg({_T3.format('score')}), 6) as top3_score, max(a) as max_a_sim, round(list_avg({_T3.format('a')}), 6) as top3_a_sim from (select *, round(a_sim, 9) as a from scored) group by s1_id", SCORED)
_add("gate_features", "select s1_id, round(coalesce(p[1], 0), 6) as p_max, round(coalesce(p[2], 0), 6) as p_2nd, round(coalesce(p[1], 0) - coalesce(p[2], 0), 6) as gap, round(coalesce(p[1], 0) + coalesce(p[2], 0) + coalesce(p[3], 0), 6) as top3_sum, coalesce(len(p), 0)::bigint as n, coalesce(len(list_filter(p, lambda v: v > 0.3)), 0)::bigint as n_over, cast(p is null as bigint) as empty from gf", SCORED,
     "gf as (select ids.s1_id, list_sort(list(score) filter (where score is not null), 'desc') as p from ids left join scored using (s1_id) group by 1)")
_add("country_breakdown", "select country, count(*) as entities, round(avg((nc > 0)::int), 6) as with_candidates, round(avg(nc), 6) as mean_candidates, round(avg((nm > 0)::int), 6) as matched, round(avg(nm) filter (where nm > 0), 6) as matches_per_matched from cb group by country", SCORED,
     "cb as (select e.country, (select count(*) from cand c where c.s1_id = e.entity_id) as nc, (select count(*) from matches m where m.s1_id = e.entity_id) as nm from ent e where source = 1)")
_add("score_histogram", "select round(score, 2) as score, count(*) as n from scored where s1_id in (select s1_id from gold where target_id is null) group by 1", SCORED)
_add("address_presence", "select has_s, has_t, count(*) as n from gp group by all", joined("gp", "links"))
_add("conflict_matrix", "select count(*) as pairs, count(*) filter (where pc and nc) as both_conflict, count(*) filter (where nc) as num_conflict, count(*) filter (where pc) as postal_conflict from gp where s_postal <> '' and t_postal <> '' and s_num <> '' and t_num <> ''", joined("gp", "links"))
_add("entity_f05", "select s1_id, n_pred, n_gold, n_tp, round(f, 9) as f05 from f05", SCORED, counts("matches"))
_add("macro_f05", "select round(avg(f), 6) as macro_f05, round(coalesce(avg(f) filter (where n_gold = 0), 0), 6) as singleton_accuracy, round(coalesce(avg(f) filter (where n_gold > 0), 0), 6) as non_singleton_f05, count(*) as n, count(*) filter (where n_gold = 0) as n_singletons from f05", SCORED, counts("matches"))
_add("f_of_means", "select round(p, 6) as p, round(r, 6) as r, round(case when p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0 end, 6) as f05 from (select avg(case when n_pred = 0 then (n_gold = 0)::int else n_tp / n_pred end) as p, avg(case when n_gold = 0 then (n_pred = 0)::int else n_tp / n_gold end) as r from cnt)", SCORED, counts("matches"))
_add("blocking_recall", "select sum(n_gold)::bigint as links, sum(n_tp)::bigint as captured, round(avg(n_pred), 6) as mean_pool, count(*) filter (where n_gold > 0 and n_tp = n_gold) as full, count(*) filter (where n_gold > 0 and n_tp > 0 and n_tp < n_gold) as part from cnt", PAIRS, counts("cand"))
_add("error_taxonomy", "select case when n_gold = 0 and n_pred > 0 then 'missed_singleton' when n_gold > 0 and n_pred = 0 then 'false_singleton' when n_gold = n_tp and n_pred = n_tp then 'perfect' when n_tp > 0 then 'partial' else 'zero' end as kind, count(*) as n from cnt group by 1", SCORED, counts("matches"))
_rf = list(EXACT.caps)
_add("route_flags", "select l.s1_id, l.target_id, " + ", ".join(f"list_has_any(list_filter(a.q_{r}, lambda v: v <> ''), list_filter(b.t_{r}, lambda v: v <> '')) as \"{r}\"" for r in _rf) + " from links l join fl a on a.entity_id = l.s1_id join fl b on b.entity_id = l.target_id",
     "fl as (select entity_id, " + ", ".join(f"{route_list(r, True)} as q_{r}, {route_list(r, False)} as t_{r}" for r in _rf) + " from rec)")
_add("unindexed_targets", "select s1_id, target_id from links where target_id not in (select target_id from cand)", PAIRS)
ORACLES["connected_components"] = "with recursive " + RECORDS + """,
e as (select s1_id as a, target_id as b from links union select target_id, s1_id from links),
reach(node, other) as (select a, a from e union select r.node, e.b from reach r join e on e.a = r.other)
select node, min(other) as component from reach group by node"""
_add("fold_leakage", "select target_id, count(distinct length(s1_id) % 3) as folds from cand group by 1 having count(distinct length(s1_id) % 3) > 1", PAIRS)
_add("validate_output", "select \"check\", n, array_to_string(list_slice(xs, 1, 5), ',') as examples from (select \"check\", count(*) as n, list_sort(list(x)) as xs from pr group by 1)", SCORED,
     "li as (select s1_id, coalesce(string_agg(distinct target_id, ',' order by target_id), '') as ids from ids left join matches using (s1_id) group by s1_id)",
     "br as (select * from li where s1_id not like '%7' union all select s1_id, ids || ',S1-9,X,S2-0,S2-0' from li where s1_id like '%1')",
     "it as (select s1_id, id from (select s1_id, unnest(string_split(ids, ',')) as id from br) where id <> '')",
     """pr as (select 'duplicate_s1' as "check", s1_id as x from br group by 2 having count(*) > 1 union all select 'repeated_id', s1_id from it group by s1_id, id having count(*) > 1
  union all select distinct 'self_match', id from it where id like 'S1-%' union all select distinct 'wrong_prefix', id from it where not regexp_matches(id, '^S[123]-')
  union all select 'missing_s1', s1_id from ids where s1_id not in (select s1_id from br) union all select distinct 'unknown_id', id from it where regexp_matches(id, '^S[23]-') and id not in (select entity_id from ent where source > 1))""")
_add("matches_outside_candidates", "select s1_id, target_id from matches anti join (select * from cand where len(routes) > 2) using (s1_id, target_id)", SCORED)
_add("set_differences", "select 'both' as kind, s1_id, target_id from links semi join cand using (s1_id, target_id) union all select 'missed', s1_id, target_id from links anti join cand using (s1_id, target_id) union all select 'extra', s1_id, target_id from cand anti join links using (s1_id, target_id)", PAIRS)
ORACLES["duplicate_rows"] = "select o_custkey, o_orderpriority, count(*) as n from orders group by all having count(*) > 1"
_add("training_matrix", "select s1_id, target_id, case when l.k = 1 then 1 else 0 end::bigint as label from (select s1_id, target_id from cand union select s1_id, target_id from links) left join (select *, 1 as k from links) l using (s1_id, target_id)", PAIRS)
_add("negative_sampling", "select s1_id, label, case when label = 1 then count(*) else least(count(*), 5) end as n from (select s1_id, (l.target_id is not null)::bigint as label from cand left join links l using (s1_id, target_id)) group by s1_id, label", PAIRS)
_add("gate_analysis", "select n_gold = 0 as singleton, coalesce(p, 0) >= 0.94 as passes, count(*) as n from (select s1_id, count(target_id) as n_gold from gold group by 1) left join (select s1_id, max(score) as p from scored group by 1) using (s1_id) group by all", SCORED)
_add("class_weight", "select label, count(*) as n, round(max(case when label = 1 then greatest(1.0, (t - p) / (2.0 * p)) else 1.0 end), 6) as w from (select *, sum(label) over () as p, count(*) over () as t from ck) group by label", PAIRS,
     "ck as (select * from (select s1_id, (l.target_id is not null)::bigint as label, row_number() over (partition by s1_id, l.target_id is not null order by target_id) as rn from cand left join links l using (s1_id, target_id)) where label = 1 or rn <= 10)")
_add("entity_sampling", "select s1_id from ids order by s1_id limit 100")
_tk = lambda p: f"list_filter(string_split({p}_norm, ' '), lambda v: v <> '')"
_D = {
    "core_exact": "s_core <> '' and s_core = t_core", "sorted_exact": "s_sorted_key <> '' and s_sorted_key = t_sorted_key", "name_token_jaccard": jaccard(_tk("s"), _tk("t")),
    "brand_overlap_count": "len(list_intersect(list_distinct(s_brand), list_distinct(t_brand)))", "brand_overlap_flag": "len(list_intersect(s_brand, t_brand)) > 0", "max_shared_idf": "coalesce(mx, 0)", "mean_shared_idf": "coalesce(av, 0)",
    "addr_dist_jaccard": jaccard("s_dist_addr", "t_dist_addr"), "addr_dist_overlap_count": "overlap", "postal_match": "pm", "postal_conflict": "pc", "has_both_postal": "pm or pc", "num_match": "nm", "num_conflict": "nc",
    "has_both_num": "nm or nc", "s1_has_addr": "has_s", "c_has_addr": "has_t", "both_have_addr": "both_addr", "either_addr_missing": "not both_addr",
    "country_rel": "case when s_cc = '' or t_cc = '' then -1 when s_cc = t_cc then 1 else 0 end", "s1_non_ascii": "s_non_ascii", "c_non_ascii": "t_non_ascii", "cross_script": "s_non_ascii <> t_non_ascii",
    "is_s2": "target_id like 'S2%'", "is_s3": "target_id like 'S3%'", "cand_rank": "row_number() over (partition by s1_id order by target_id)", "pool_size": "count(*) over (partition by s1_id)"}
_add("pair_features_native", "select s1_id, target_id, " + ", ".join(f"round(cast({v} as double), 6) as {k}" for k, v in _D.items()) + " from pair left join si using (s1_id, target_id)", PAIRS,
     "df as (select token, ln((n + 1) / (count(*) + 1)) + 1 as idf from (select unnest(list_distinct(core_toks)) as token from rec where source > 1), (select count(*) as n from rec where source > 1) group by token, n)",
     "si as (select s1_id, target_id, max(idf) as mx, avg(idf) as av from (select s1_id, target_id, unnest(list_intersect(list_distinct(string_split(s_core, ' ')), list_distinct(string_split(t_core, ' ')))) as token from pair) join df using (token) group by all)")
_add("sweep_tau", sweep({"tau": [0.82, 0.9, 0.92, 0.94, 0.95]}, "score >= tau", "score desc"), SCORED)
_add("sweep_two_sources", sweep({"tau2": [0.82, 0.92, 0.95], "tau3": [0.9, 0.94]}, "score >= case when target_id like 'S2%' then tau2 else tau3 end", "score desc"), SCORED)
_add("sweep_rules", sweep({"cutoff": [0.81, 0.85, 0.93], "min_len": [4.0, 14.0]}, "score >= cutoff and (not t_blank or core_len >= min_len)", "score desc, nm desc, pm desc"), SCORED)
ORACLES["sweep_best"] = "select * from (" + ORACLES["sweep_tau"] + ") order by macro_f05 desc, tau limit 1"

# --- what takes fuzzy scores ---
_CORES, _NORMS, _ADDRESSES, _EXPANDED = (f"select s_{x} as a, t_{x} as b from " for x in ("core", "norm", "clean_addr", "exp_core"))
_on = lambda table, x: f"{table}.a = s_{x} and {table}.b = t_{x}"
_JW = lambda x: f"case when s_{x} = '' or t_{x} = '' then 0.0 else jaro_winkler_similarity(s_{x}, t_{x}) end"
_CLASH = "(s_cat <> 0 and t_cat <> 0 and (s_cat & t_cat) = 0)"
_add("screener", "select s1_id, target_id from pair join kc on " + _on("kc", "core") + " where s_core = t_core or pm or nm or overlap >= 1 or s_sorted_key = t_sorted_key or kc.ratio >= 0.48", PAIRS, Q.kernels("kc", _CORES + "pair"))
_add("top_by_similarity", "select s1_id, target_id, score, rank from (select *, row_number() over (partition by s1_id order by score desc, target_id) as rank from ts) where rank <= 5", PAIRS, Q.kernels("kc", _CORES + "pair"),
     f"ts as (select s1_id, target_id, round(case when s_core = '' or t_core = '' then 50 else 100 * kc.ratio end + case when nm then 25 else 0 end, 9) as score from pair join kc on {_on('kc', 'core')})")
_BONUS = f"case when pm then 0.10 else 0 end + case when nm then 0.05 else 0 end + case when {jaccard(Q.words('s_clean_addr'), Q.words('t_clean_addr'))} > 0.5 then 0.05 else 0 end"
_add("composite_score", "select s1_id, target_id, round(least(1.0, name_sim + bonus), 6) as composite from cs where name_sim >= 0.30", PAIRS, Q.kernels("kc", _CORES + "pair"), Q.kernels("kn", _NORMS + "pair"),
     f"cs as (select s1_id, target_id, greatest(kc.token_sort, kn.token_sort, {_JW('core')}) as name_sim, ({_BONUS})::double as bonus from pair join kc on {_on('kc', 'core')} join kn on {_on('kn', 'norm')} where {COUNTRY})")
_bare = lambda p: grams(f"replace({p}_norm, ' ', '')", 4)
_gap = " or ".join(f"list_has_any(list_filter(a.q_{r}, lambda v: v <> ''), list_filter(b.t_{r}, lambda v: v <> ''))" for r in _rf)
_add("blocking_gaps", f"select s1_id, target_id, {jaccard(_bare('s'), _bare('t'))} >= 0.10 as by_grams, kn.token_sort >= 0.65 as by_words, pc as postal_conflict, nc as num_conflict from gm join kn on {_on('kn', 'norm')}",
     "fl as (select entity_id, " + ", ".join(f"{route_list(r, True)} as q_{r}, {route_list(r, False)} as t_{r}" for r in _rf) + " from rec)",
     f"ms as (select l.s1_id, l.target_id from links l join fl a on a.entity_id = l.s1_id join fl b on b.entity_id = l.target_id where not ({_gap}))", joined("gm", "ms"), Q.kernels("kn", _NORMS + "gm"))
_quotas = [("core", 20), ("sorted", 15), ("concat", 12), ("num_prefix", 10), ("post_num", 15), ("addr_key", 10)]
_add("fair_quota", f"select s1_id, target_id, place from q{len(_quotas)} where place <= 20", PAIRS, "fo as (select s1_id, target_id, route, ord from found join rec on rec.entity_id = target_id)",
     "q0 as (select s1_id, target_id, 0::bigint as place from fo where false)",
     *(f"""q{i + 1} as (select * from q{i} union all select s1_id, target_id, coalesce(had, 0) + rn from (select s1_id, target_id, row_number() over (partition by s1_id order by ord, target_id) as rn
  from fo anti join q{i} using (s1_id, target_id) where route = '{r}') left join (select s1_id, count(*) as had from q{i} group by 1) using (s1_id) where rn <= {n})""" for i, (r, n) in enumerate(_quotas)))  # fmt: skip
_SHARED = f"case when len(list_intersect({_tk('s')}, {_tk('t')})) > 0 then 5.0 else 0.0 end"
_ALL = {k: f"cast({v} as double)" for k, v in (_D | {"max_shared_idf": _SHARED, "mean_shared_idf": _SHARED, "char_ngram_jaccard": jaccard(grams("s_norm", 3), grams("t_norm", 3)), "token_sort": "kn.token_sort", "token_set": "kn.token_set",
        "lev_ratio": "kc.ratio", "jaro_winkler": _JW("norm"), "partial_ratio": "kn.partial", "addr_token_set": "ka.token_set", "addr_token_sort": "ka.token_sort"}).items()}
_STRENGTH = {"name_strength": "name_strength", "addr_strength": "addr_strength", "name_x_addr": "name_strength * addr_strength", "strong_name_weak_addr": "(name_strength > 0.88 and both_addr and addr_strength < 0.30)::double",
             "weak_name_strong_addr": "(name_strength < 0.50 and both_addr and addr_strength > 0.85)::double"}
_add("pair_features", "select s1_id, target_id, " + ", ".join(f"round({k}, 6) as {k}" for k in _ALL) + ", " + ", ".join(f"round({v}, 6) as {k}" for k, v in _STRENGTH.items()) + " from fs", PAIRS,
     Q.kernels("kn", _NORMS + "pair", True), Q.kernels("kc", _CORES + "pair"), Q.kernels("ka", _ADDRESSES + "pair"),
     "fw as (select s1_id, target_id, both_addr, " + ", ".join(f"{v} as {k}" for k, v in _ALL.items()) + f" from pair join kn on {_on('kn', 'norm')} join kc on {_on('kc', 'core')} join ka on {_on('ka', 'clean_addr')})",
     "fs as (select *, greatest(token_sort, token_set, lev_ratio, jaro_winkler) as name_strength, case when both_addr then greatest(addr_token_set, addr_dist_jaccard, postal_match) else 0.5 end as addr_strength from fw)")
_LENGTHS = "length(s_core), length(t_core)"
_add("pair_features_compact", f"""select s1_id, target_id, cast(case when s_core <> '' and s_core = t_core then 1 when list_contains(s_aliases, t_core) or list_contains(t_aliases, s_core) then 0.95 else 0 end as double) as core_exact,
  (s_concat_key <> '' and s_concat_key = t_concat_key)::double as concat_exact, {_CLASH}::double as cat_conflict, least({_LENGTHS})::double as core_len_min, (greatest({_LENGTHS}) - least({_LENGTHS}))::double as core_len_diff,
  (s_cc <> '' and s_cc = t_cc)::double as country_match, (s_cc <> '' and t_cc <> '' and s_cc <> t_cc)::double as country_conflict from pair""", PAIRS)


# --- whole resolutions with fuzzy scores ---
_EV1 = "(pm or nm or overlap >= 1)"


def moderate(p: Profile) -> str:
    """The branches after the exact tiers, first to last, as when ... then."""
    scripts = "when (s_non_ascii or t_non_ascii) and nm then case when overlap >= 2 and sim1 >= 0.80 then 0.88 "
    near = f"when name >= 0.88 then case when {_EV1} or not both_addr then 0.87 else 0 end"
    postal = "when name >= 0.72 then case when pm and (nm or overlap >= 1) then 0.84 when nm and overlap >= 1 then 0.82"
    if p.tiers == "strict":
        return f"{scripts} when pm and overlap >= 1 and sim1 >= 0.88 then 0.86 else 0 end {near} {postal} else 0 end"
    if p.tiers == "brand":
        return f"""when nm and overlap >= 2 then 0.89 when name >= 0.86 then case when {_EV1} or (not has_s and not has_t and name >= 0.92) then 0.87 else 0 end
  when name >= 0.80 and (len(list_intersect(s_brand, t_brand)) > 0 or (nm and overlap >= 2)) then case when pm or nm then 0.83 when overlap >= 2 and sim1 >= 0.80 then 0.81 else 0 end"""
    phone = "when list_has_any(s_phones_raw, t_phones_addr) then case when name >= 0.60 then 0.86 else 0 end" if p.phone else ""
    part = f"when name >= 0.60 and part >= {p.partial_from} then case when pm and nm then 0.83 when pm and overlap >= 1 then 0.82 else 0 end" if p.moderate_partial else ""
    return f"{scripts} when overlap >= 1 and sim1 >= 0.90 then 0.86 else 0 end {near} {phone} {postal} when overlap >= 2 and sim1 >= 0.82 then 0.80 else 0 end {part}"


_FEW = "(pm::int + nm::int + (a_sim >= 0.65)::int) < 2"
_WEAK = {"none": "false", "lone": "score < {0} and a_sim < {1}", "blank_address": "((score < {0} and a_sim < {1}) or (t_blank and score < 0.95))", "signals": f"score < 0.90 and {_FEW} and (score < 0.84 or (core_len < 5 and score < 0.87))"}


def resolution(p: Profile) -> str:
    """The profile's matches, from the records on."""
    windows = p.moderate_partial or "weighted" in p.fuzzy or "partial" in p.fuzzy
    names = {"core": "kc.ratio", "sorted": "kn.token_sort", "weighted": "kc.weighted", "expanded": "ke.ratio", "partial": "part0"}
    tier = f"case {moderate(p)} else 0 end"
    if p.tiers not in ("strict", "brand"):
        tier = f"case when {tier} < 0.80 and {_EDIT} and {_EV1} then 0.83 else {tier} end"
    if p.tiers == "tightened":
        tier = f"case when {tier} >= 0.81 and name < 0.60 and ({_CLASH} or ({tier} < 0.87 and name < 0.55)) then 0 else {tier} end"
    keep = {"none": "true", "soft": f"(not {_CLASH} or fix is not null or name >= 0.85)", "hard": f"not {_CLASH}"}[p.category]
    order = ", ".join(f"{c} desc" for c in p.order)
    return f"""{found(p.caps, p.brand_words, p.expanded, p.alias_cap)},
cand as (select distinct s1_id, target_id from found),
{joined('pair', 'cand')},
g0 as materialized (select *, {fixed(p.expanded)} as fix from pair where {COUNTRY} and {GATE} and {GUARD}),
{Q.kernels('kc', _CORES + 'g0', windows)},
{Q.kernels('kn', _NORMS + 'g0')},
{Q.kernels('ke', _EXPANDED + 'g0')},
{Q.kernels('ka', _ADDRESSES + 'g0 where both_addr')},
g1 as (select g0.*, case when both_addr then ka.token_set end as sim, {"case when greatest(length(s_core), length(t_core)) > 6 then kc.partial else 0 end" if windows else "0.0"} as part0, {'greatest(' if len(p.fuzzy) > 1 else '('}{', '.join(names[x] for x in p.fuzzy)}) as name
  from g0 join kc on {_on('kc', 'core')} join kn on {_on('kn', 'norm')} join ke on {_on('ke', 'exp_core')} left join ka on {_on('ka', 'clean_addr')}),
g2 as (select *, part0 as part, coalesce(sim, -1.0) as sim1 from g1 where not coalesce(sim < 0.35 or (pc and sim < 0.70), false) and {keep}),
scored as (select s1_id, target_id, coalesce(fix, {tier})::double as score, coalesce(sim, 0.5) as a_sim, pm, nm, s_ord, not has_t as t_blank, length(s_core) as core_len from g2),
owned as (select * exclude (rn) from (select *, row_number() over (partition by target_id order by {order}, s_ord) as rn from scored where score >= {p.cutoff}) where rn = 1),
ownedn as (select *, count(*) over (partition by s1_id) as n from owned)
select s1_id, target_id, score, round(a_sim, 9) as a_sim, pm, nm from ownedn where not (n = 1 and {_WEAK[p.gate].format(p.gate_score, p.gate_address)})"""


for _p in PROFILES.values():
    if _p.fuzzy:
        ORACLES[f"resolve_{_p.name}"] = "with " + {"standard": RECORDS, "calibrated": CALIBRATED}[_p.text] + ",\n" + resolution(_p)


# --- the composite profile's routes ---
_CSTART = "case when length(ccore) >= 3 then substr(ccore, 1, 3) else '' end"
_CKEYS = {"core": "ccore", "sorted": f"array_to_string(list_sort({Q.words('ccore')}), ' ')", "bigram": f"case when len({Q.words('ccore')}) >= 2 then array_to_string(list_slice(list_sort({Q.words('ccore')}), 1, 2), '_') else '' end",
          "postal_core": both("code", f"({_CSTART})"), "street_core": both("street", f"({_CSTART})"), "postal_street": both("code", "street")}
_add("routes_v7", "select distinct s1_id, target_id, route from (select s1_id, target_id, route from vq join vi using (route, key) where rn <= 30 union all select s1_id, target_id, 'alias' from va join vi using (key) where route = 'core' and rn <= 10)",
     f"""v0 as (select entity_id, ord, source, case when {_CCORE} <> '' then {_CCORE} else {_CFULL} end as ccore, regexp_extract(address, '(\\d{{5}})$', 1) as code, regexp_extract({punct('address')}, '^(\\d+)', 1) as street,
  list_filter(list_transform(string_split_regex(name, '(?i)\\b(?:{'|'.join(W.COMPOSITE_ALIAS_WORDS)})\\b'), lambda v: {punct('v')}), lambda v: length(v) > 2) as others from rec)""",
     "vk as (" + " union all ".join(f"select entity_id, ord, source, '{r}' as route, {k} as key from v0" for r, k in _CKEYS.items()) + ")",
     "vq as (select entity_id as s1_id, route, key from vk where source = 1 and key <> '')", "va as (select distinct entity_id as s1_id, unnest(others) as key from v0 where source = 1)",
     "vi as (select entity_id as target_id, route, key, row_number() over (partition by route, key order by ord) as rn from vk where source > 1 and key <> '')")
