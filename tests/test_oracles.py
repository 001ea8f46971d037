"""Every query with an oracle gives what DuckDB gives; every query runs."""
import glob
import os

import pytest

import __spark_entry__ as entry
from sparlink.plans.catalog import QUERIES
from sparlink.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(str).replace({"<NA>": "nan", "None": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_learned_scores_separate(spark, sf):
    rows = QUERIES["gbt_train_score"](spark, sf).collect()
    mean = lambda xs: sum(xs) / max(len(xs), 1)
    assert mean([r.prob for r in rows if r.label == 1]) > mean([r.prob for r in rows if r.label == 0])


def test_folds_and_owners(spark, sf):
    folds = QUERIES["fold_assign"](spark, sf).collect()
    assert {r.fold for r in folds} <= set(range(5)) and len(folds) == len({r.component for r in folds})
