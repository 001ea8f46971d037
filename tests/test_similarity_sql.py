"""The oracles' SQL of the fuzzy scores against the engine's kernels, over made-up names with empty, equal and long ones."""
import random

import duckdb
import pandas as pd
import pytest

from sparlink.functions.similarity import KERNELS
from sparlink.plans.similarity_sql import kernels, lcs


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(7)
    words = ["alpha", "north", "stone", "river", "blue", "inc", "dba", "x1", "a", "rivers", "alhpa"]
    name = lambda n: " ".join(r.choices(words, k=r.randint(0, n)))
    rows = {(name(5), name(5)) for _ in range(300)} | {(name(2), name(12)) for _ in range(60)} | {("", ""), ("", "a"), ("alpha", "alpha"), ("north " * 40 + "x", "north " * 40 + "y")}
    return pd.DataFrame(sorted(rows), columns=["a", "b"])


def test_kernels(pairs):
    c = duckdb.connect()
    c.register("p", pairs)
    got = c.sql("with " + kernels("k", "select a, b from p", True) + " select * from k").df()
    assert len(got) == len(pairs)
    for r in got.itertuples():
        for k in ("ratio", "token_sort", "token_set", "partial", "weighted"):
            assert getattr(r, k) == pytest.approx(KERNELS[k](r.a, r.b), abs=1e-12), (k, r.a, r.b)


def test_subsequence_by_hand():
    c = duckdb.connect()
    for a, b, n in (("abcbdab", "bdcaba", 4), ("", "x", 0), ("same", "same", 4), ("ab", "cd", 0)):
        assert c.execute(f"select {lcs('a', 'b')} from (select ? as a, ? as b)", [a, b]).fetchone()[0] == n
