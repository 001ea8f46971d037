"""String similarities. Sets, edit distance and flags are built-in expressions; fuzzy ratios run in Arrow batches."""
from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# --- kernels: plain functions of two strings, in [0, 1] ---
def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by a bit vector over a's positions."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return (~row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insertions-and-deletions similarity; 0 if either is empty."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Of shared and other words: 1 if one side has no words of its own, else the best of three ratios."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    mine, yours = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not mine or not yours):
        return 1.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    n, m = shared + gap + len(mine), shared + gap + len(yours)
    differ = len(mine) + len(yours) - 2 * lcs_length(mine, yours)
    best = 1 - differ / (n + m)
    if shared:
        best = max(best, 2 * shared / (shared + n), 2 * shared / (shared + m))
    return best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string and a window of its length in the longer one, ends cut short included."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    n, letters, best = len(a), set(a), 0.0
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        edge = window[-1] if start <= len(b) - n else window[0]
        if edge in letters and 2 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(a, window))
    return best


def partial_tokens(a: str, b: str) -> float:
    """The better of the partial ratio of sorted words and of the words that aren't shared; 1 if a word is shared."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 1.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted(a: str, b: str) -> float:
    """The greatest of several ratios, each weighted by how far the lengths are apart."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial_tokens(a, b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common start of up to four letters where it is above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, (b[j] for j in range(len(b)) if used[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


KERNELS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "token_sort": token_sort, "token_set": token_set, "partial": partial, "weighted": weighted, "jaro_winkler": jaro_winkler}


@lru_cache
def _udf(kernel: str):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        f, out = KERNELS[kernel], []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


def fuzzy(kernel: str, a: Column, b: Column) -> Column:
    """A kernel over two string columns in Arrow batches; equal pairs of a batch are worked out once."""
    return _udf(kernel)(a, b)


@lru_cache
def _list_udf(kernel: str):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        f = KERNELS[kernel]
        return pd.Series([max((f(x, y) for x in xs for y in ys), default=0.0) for xs, ys in zip(a, b)], dtype="float64")

    return run


def best_of_lists(kernel: str, a: Column, b: Column) -> Column:
    """The greatest of a kernel over all pairs of two short lists, 0 where one is empty; lists with a common member need no
    kernel."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.arrays_overlap(a, b), 1.0).otherwise(_list_udf(kernel)(a, b))).otherwise(0.0)


@lru_cache
def _name_scores():
    schema = "address double, core double, sorted double, weighted double, expanded double, partial double"

    @F.pandas_udf(schema)
    def run(addr_a: pd.Series, addr_b: pd.Series, core_a: pd.Series, core_b: pd.Series, norm_a: pd.Series, norm_b: pd.Series, exp_a: pd.Series, exp_b: pd.Series, names: pd.Series) -> pd.DataFrame:
        known: dict[tuple, float] = {}

        def of(kernel: str, x: str, y: str) -> float:
            key = (kernel, x, y)
            if key not in known:
                known[key] = KERNELS[kernel](x, y)
            return known[key]

        rows = []
        for aa, ab, ca, cb, na, nb, ea, eb, full in zip(addr_a, addr_b, core_a, core_b, norm_a, norm_b, exp_a, exp_b, names):
            address = of("token_set", aa, ab) if aa and ab else None
            if full:
                rows.append((address, of("ratio", ca, cb), of("token_sort", na, nb), of("weighted", ca, cb), of("ratio", ea, eb), of("partial", ca, cb) if max(len(ca), len(cb)) > 6 else 0.0))
            else:
                rows.append((address, None, None, None, None, None))
        return pd.DataFrame(rows, columns=["address", "core", "sorted", "weighted", "expanded", "partial"], dtype="float64")

    return run


def pair_scores(*columns: Column) -> Column:
    """One Arrow pass for all fuzzy scores of a pair: struct of address, core, sorted, weighted, expanded, partial.

    The last column says whether names need scores; the address score is null where an address is missing.
    """
    return _name_scores()(*columns)


# --- built-in expressions ---
def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared members over those of the larger set."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most > 0, overlap(a, b) / most).otherwise(0.0)


def matches(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)


def conflicts(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def country_relation(a: Column, b: Column, match: float = 1.0, conflict: float = 0.0, unknown: float = -1.0) -> Column:
    return F.when((a == "") | (b == ""), unknown).when(a == b, match).otherwise(conflict)


def one_edit(a: Column, b: Column) -> Column:
    """Short names one edit apart at most: the shorter of three to seven letters, the longer of eight at most."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb).between(3, 7) & (F.greatest(la, lb) <= 8) & F.levenshtein(a, b, 1).between(0, 1)
