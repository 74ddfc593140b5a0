"""Every registered query on the smallest tables, against its SQL where there is one."""

import importlib
import os
import sys

import pytest

from seqloom import plans
from tests.conftest import SMALL

duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = plans.registry()
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")


def canon(values):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6g}"
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(one(v) for v in r) for r in values)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = [[r[c] for c in cols] for r in df.collect()]
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(want.columns) == cols
        want = want[cols].astype(object).where(want[cols].notna(), None)
        assert canon(got) == canon(want.itertuples(index=False, name=None))
    assert len(set(map(str, got))) == len(got)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_rest_works_without_llm(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("seqloom.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "seqloom.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    sys.modules.pop("__spark_entry__")
