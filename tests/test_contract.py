"""Every contract query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest
from lamina.plans import contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted([tuple(plain(r[k]) for k in order) for r in data], key=repr), sorted(names)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(contract.oracle_sql()[name])
    assert found == rows([d[0] for d in cur.description], cur.fetchall())
    assert found[0]


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
