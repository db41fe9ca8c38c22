"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lexispark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def rows(names, data):
    plain = lambda v: None if v is None else v if isinstance(v, str) else round(float(v), 9)
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in at]) for r in data)


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if not n.startswith(("suffix_tree", "inverse", "lc_"))])
def test_matches_sql(spark, sql, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    want = sql.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(want.columns, want.fetchall())


def test_entry_points_do_not_need_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
