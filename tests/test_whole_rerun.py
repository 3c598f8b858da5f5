import importlib

import pytest

entry_module = importlib.import_module("__spark_entry__")


def test_every_later_delivery_supersedes(spark, small):
    """Odd row ids too: each key has its last row."""
    parquet = pytest.importorskip("pyarrow.parquet")
    last = {}
    for r in parquet.read_table(f"{small}/pair_results.parquet").to_pylist():
        key = (r["excerpt_id"], r["model"])
        if key[0] is not None and r["row_id"] > last.get(key, (-1,))[0]:
            last[key] = (r["row_id"], r["status"], r["correct"])
    got = entry_module.queries()["mrg_1_supersede"](spark, small).select("excerpt_id", "model", "row_id", "status", "correct").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((k + v for k, v in last.items()), key=repr)
