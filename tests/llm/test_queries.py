import os

import pytest

from causeway.llm import queries as Q

FOUND = {
    "p4_found": {"row_id": "bigint", "side": "string", "concept_id": "int"},
    "p5_found": {"row_id": "bigint", "defect": "string"},
    "p6_found": {"row_id": "bigint"},
    "p7_found": {"source_table": "string", "record_id": "bigint", "line_no": "int", "noise": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p10_found": {"doc_id": "bigint", "kind": "string"},
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_queries(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    assert dict(df.dtypes) == FOUND[name]
    got = [tuple(map(str, r)) for r in df.collect()]
    assert got and len(got) == len(set(got)) and not any("None" in r for r in got)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(FOUND)))
def test_other_queries_run(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, small, name):
    """Only the queries that SQL can express on whole tables have a twin."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{small}/{file}')")
    df = Q.QUERIES[name](spark, small)
    result = con.execute(Q.SQL[name])
    columns = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    assert columns == sorted(df.columns)
    plain = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    assert sorted([plain(r[i]) for i in at] for r in result.fetchall()) == sorted([plain(r[c]) for c in columns] for r in df.collect())
