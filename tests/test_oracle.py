"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sluicework.plans import catalog
from sluicework.plans.adapters import TABLES


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return repr(round(x, 4) + 0.0) if isinstance(x, float) else str(x)

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    told = duck.sql(catalog.ORACLE[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(told.fetchall(), told.columns)
