import json

from causeway.operators import schema_drift as S
from tests.conftest import rows


def lines(spark, runs, series="s"):
    data = [
        (n, series, run, r if r is None or isinstance(r, str) else json.dumps(r), 1)
        for n, (run, r) in enumerate(((run, r) for run, rs in runs.items() for r in rs), 1)
    ]
    return spark.createDataFrame(data, "line_id BIGINT, series STRING, run_no INT, record_json STRING, names INT")


def rec(k, **fields):
    return {"excerpt_id": f"e{k}", **fields}


def test_changes(spark):
    runs = {
        1: [rec(1, a="x", b=1, e=[{"c": "p", "d": "q"}], gone=None), rec(2, a="y", b=2, e=[]), rec(2, a="y", b=2, e=[]), "", "{", None, {"error": "x", "zzz": 1}],
        3: [rec(1, A="x", b="1", e=[{"c": "p", "to": "q"}], new=None), rec(2, A="y", b="2", e=[]), rec(9, A="w", b="3", e=[])],
        4: [rec(1, A="x", b="1", f=[{"c": "p", "to": "q"}], new=True, other={"k": 1}), rec(2, A="y", b="2", f=[], new=False, other={"k": 2})],
    }
    assert rows(S.schema_changes(lines(spark, runs))) == sorted([
        ("s", 3, "a", "renamed", "A"), ("s", 3, "b", "retyped", "b"), ("s", 3, "e.d", "renamed", "e.to"),
        ("s", 3, "gone", "removed", "gone"), ("s", 3, "new", "added", "new"),
        ("s", 4, "e", "renamed", "f"), ("s", 4, "other", "added", "other"),
    ], key=repr)


def test_same_type_but_other_values_is_no_rename(spark):
    runs = {1: [rec(1, a="x"), rec(2, a="y")], 2: [rec(1, b="x"), rec(2, b="z")]}
    assert {r[3] for r in rows(S.schema_changes(lines(spark, runs)))} == {"added", "removed"}


def test_one_table(spark):
    runs = {
        0: [rec(k, predicted_cause="x", mode="soft", elapsed_sec=1.5) for k in (1, 2, 3)],
        1: [rec(1, predicted_cause="x", mode="soft", elapsed_sec=1.5)],
        2: [rec(1, cause_hat="x", mode=2, elapsed_sec="1.5 s")],
        3: [rec(1, cause_hat={"label": "x", "score": 1}, mode={"name": "soft"}, elapsed_sec="soon", extra=[1]), {"error": "no", "excerpt_id": "e2"}],
    }
    got = {r.line_id - 3: r for r in S.consistent_table(lines(spark, runs)).collect()}
    assert [got[k].predicted_cause for k in (1, 2, 3)] == ["x", "x", "x"]
    assert [got[k].mode for k in (1, 2, 3)] == ["soft", "2", "soft"]
    assert [got[k].elapsed_sec for k in (1, 2, 3)] == [1.5, 1.5, None] and got[3].failed_casts == ["elapsed_sec"]
    assert got[3].extra == "[1]" and got[3].other_fields == {} and got[4].error == "no"


def test_columns_follow_the_statistics(spark):
    runs = {1: [rec(k, mode="soft", score=1, tags=["a"], Ok=True, line_id="own") for k in range(300)] + [rec(300, rare=1)], 2: [rec(k, mode="soft", score="x", tags=["a"], ok=False) for k in range(9)]}
    table = S.consistent_table(lines(spark, runs))
    assert dict(table.dtypes) == {
        "line_id": "bigint", "series": "string", "run_no": "int", "excerpt_id": "string", "mode": "string", "score": "double", "tags": "string", "Ok": "boolean", "error": "string",
        "other_fields": "map<string,string>", "failed_casts": "array<string>",
    }
    got = {r.line_id: r for r in table.collect()}
    assert got[301].other_fields == {"rare": "1"} and got[1].other_fields == {"line_id": '"own"'} and got[302].failed_casts == ["score"] and got[302].Ok is False


def test_a_run_with_a_third_of_all_lines(spark):
    """Broadcast and salted joins give the same; the large run spreads over the salts."""
    runs = {1: [rec(k, a=f"x{k}") for k in range(20)], 2: [rec(k % 20, b=f"x{k % 20}", n=k) for k in range(400)], 3: [rec(k, b=f"x{k}") for k in range(20)]}
    df = lines(spark, runs)
    of_run = spark.createDataFrame([("s", 2, "two"), ("s", 3, "three")], "series STRING, run_no INT, asked STRING")
    for how in ("inner", "left"):
        small, large = (S.with_run(df, of_run, how, most=most) for most in (10, 0))
        assert rows(small.select("line_id", "asked")) == rows(large.select("line_id", "asked")) and "salt" in large._jdf.queryExecution().toString()
    assert rows(S.schema_changes(df)) == [("s", 2, "a", "renamed", "b"), ("s", 2, "n", "added", "n"), ("s", 3, "n", "removed", "n")]


def test_all_values_of_an_excerpt_must_agree(spark):
    runs = {1: [rec(1, a="x"), rec(1, a="y")], 2: [rec(1, b="x"), rec(1, b="z")]}
    assert {r[3] for r in rows(S.schema_changes(lines(spark, runs)))} == {"added", "removed"}


def test_paths_and_shapes():
    record = {"a": {"b": 1, "c": None}, "a.b": "x", "e": [{"k": 1}, {"k": "y", "m": []}, 3], "z": [[1], [None]]}
    assert dict(S.typed_paths(S._example(S.shape_of(record)))) == dict(S.typed_paths(record))
    for path, found in S.walk_paths(record).items():
        assert sorted(map(repr, S.values_at(record, path))) == sorted(map(repr, found)), path


def test_empty_and_null_series(spark):
    df = lines(spark, {1: [rec(1, a=1)]})
    assert S.schema_changes(df.limit(0)).count() == 0 and S.consistent_table(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, 1, '{"a": 1}', 0), (2, "s", None, '{"a": 1}', 0)], df.schema)
    assert S.schema_changes(nulls).count() == 0 and S.consistent_table(nulls).count() == 2


def test_types_and_values():
    assert S.raw_type([None, []]) is None and S.raw_type([1, None]) == "array<number>" and S.raw_type(True) == "boolean"
    assert S.canonical({"b": 1.0, "a": [2]}) == S.canonical({"a": [2.0], "b": 1})
