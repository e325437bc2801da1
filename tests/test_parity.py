"""Some of the catalogue beside its SQL; the driver compares all of it."""

import os

import duckdb
import pytest

from brindle.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
NAMES = ["flagship", "predicates_mix", "not_in_subquery", "scalar_subquery", "left_nest", "left_unnest", "agg_empty", "group_join", "order_nulls_desc", "json_paths", "fn_string", "fn_math", "fn_array", "fn_date", "fts_match_and", "fts_phrase", "dml_update", "kv_counter", "txn_cas_conflicts", "conflict_timestamp", "index_scan"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in catalogue.KEYS:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
