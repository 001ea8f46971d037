"""DuckDB SQL of the fuzzy similarities, for the oracles: by tables of subsequence lengths instead of bit vectors."""
from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: the table's rows, one for each letter of a, from the row before."""
    none = f"[list_transform(string_split({b}, ''), lambda d: 0)]"
    equal = f"list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda d: (c = d)::int))"
    row = "list_transform(range(1, len(x) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(x[i], coalesce(x[i - 1], 0) + y[i]))))"
    return f"(case when {a} = '' or {b} = '' then 0 else list_reduce(list_concat({none}, {equal}), lambda x, y: {row})[-1] end)"


def ratio(a: str, b: str) -> str:
    return f"(case when {a} = '' or {b} = '' then 0.0::double else 2::double * {lcs(a, b)} / (length({a}) + length({b})) end)"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda v: v <> '')"


def line(xs: str) -> str:
    return f"coalesce(array_to_string(list_sort({xs}), ' '), '')"


def best_window(name: str, pairs: str) -> str:
    """Tables up to name(a, b, part): the best ratio of the shorter string and a window of its length in the longer one."""
    return f"""{name}_0 as (select distinct a, b, case when length(a) <= length(b) then a else b end as lo, case when length(a) <= length(b) then b else a end as hi from ({pairs})),
{name}_1 as (select distinct lo, hi from {name}_0 where lo <> '' and not contains(hi, lo)),
{name}_2 as (select lo, hi, substr(hi, greatest(beg, 0) + 1, beg + length(lo) - greatest(beg, 0)) as piece from (select lo, hi, unnest(range(1 - length(lo), length(hi))) as beg from {name}_1)),
{name}_3 as (select lo, piece, {ratio('lo', 'piece')} as r from (select distinct lo, piece from {name}_2)),
{name}_4 as (select lo, hi, max(r) as r from {name}_2 join {name}_3 using (lo, piece) group by lo, hi),
{name} as (select a, b, case when {name}_0.lo = '' then 0.0::double when contains({name}_0.hi, {name}_0.lo) then 1.0::double else r end as part from {name}_0 left join {name}_4 using (lo, hi))"""


def kernels(name: str, pairs: str, windows: bool = False) -> str:
    """Tables up to name(a, b, ratio, token_sort, token_set), with windows also partial and weighted, for pairs(a, b)."""
    base = f"""{name}_a as (select distinct a, b, {line(words('a'))} as sa, {line(words('b'))} as sb, list_distinct({words('a')}) as xa, list_distinct({words('b')}) as xb from ({pairs})),
{name}_b as (select *, length({line('list_intersect(xa, xb)')}) as sh, {line('list_filter(xa, lambda v: not list_contains(xb, v))')} as da, {line('list_filter(xb, lambda v: not list_contains(xa, v))')} as db from {name}_a),
{name}_c as (select *, sh + (sh > 0)::int + length(da) as n, sh + (sh > 0)::int + length(db) as m, {ratio('a', 'b')} as ratio, {ratio('sa', 'sb')} as token_sort, {lcs('da', 'db')} as common from {name}_b),
{name}_d as (select *, case when len(xa) = 0 or len(xb) = 0 then 0.0::double when sh > 0 and (da = '' or db = '') then 1.0::double
  else greatest(1 - (length(da) + length(db) - 2 * common)::double / (n + m), case when sh > 0 then greatest(2 * sh::double / (sh + n), 2 * sh::double / (sh + m)) else 0 end) end as token_set,
  case when a = '' or b = '' then 1 else greatest(length(a), length(b))::double / least(length(a), length(b)) end as longer from {name}_c),
"""
    if not windows:
        return base + f"{name} as (select a, b, ratio, token_sort, token_set from {name}_d)"
    return base + f"""{best_window(name + '_w', f"select a, b from {name}_d union all select sa, sb from {name}_d where longer >= 1.5 and sh = 0 union all select da, db from {name}_d where longer >= 1.5 and sh = 0")},
{name}_e as (select d.*, p.part as partial, case when sh > 0 then 1.0::double else greatest(q.part, r.part) end as partial_tokens from {name}_d d join {name}_w p on p.a = d.a and p.b = d.b
  left join {name}_w q on q.a = d.sa and q.b = d.sb left join {name}_w r on r.a = d.da and r.b = d.db),
{name} as (select a, b, ratio, token_sort, token_set, partial, case when a = '' or b = '' then 0.0::double when longer < 1.5 then greatest(ratio, 0.95 * token_sort, 0.95 * token_set)
  else greatest(ratio, case when longer <= 8 then 0.9 else 0.6 end * partial, 0.95 * case when longer <= 8 then 0.9 else 0.6 end * partial_tokens) end as weighted from {name}_e)"""
