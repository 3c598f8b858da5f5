import importlib
import math
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
entry_module = importlib.import_module("__spark_entry__")
CORE = sorted(importlib.import_module("causeway.plans.queries").SQL)


def test_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p2_found", "p3_found"} <= set(queries)


def test_core_stands_without_the_text_package():
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('causeway.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'p3_found' in e.queries() and 'p8_ids' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark, small):
    assert entry_module.entry(spark).columns


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 12))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="session")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{small}/{name}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, small, duck, name):
    df = entry_module.queries()[name](spark, small)
    result = duck.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    got = sorted(str([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert got == want
