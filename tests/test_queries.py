from __future__ import annotations

import os

import duckdb
import pytest

from marklake.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    d = catalog.queries()[name](spark, SF)
    cols = sorted(d.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in d.collect())
    q = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in q.fetchall())


def test_one_python_stage(spark):
    plan = catalog.queries()["f07_fm_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
