import json

import pytest
from pyspark.sql import types as T

from causeway.sources import files, sinks
from causeway.streaming import append_log
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("excerpt_id", T.StringType()), T.StructField("text", T.StringType())])


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_tolerant_scan_keeps_line_numbers(spark, tmp_path):
    long = "x" * 40
    lines = ["", '{"text": "%s"}' % long, "{broken", '{"text": "short"}', "[1]", '{"text": null}', '  {"text": "%s", "excerpt_id": "b"}' % long]
    write(tmp_path / "a" / "one.jsonl", "\n".join(lines))
    write(tmp_path / "b" / "two.jsonl", "\n")
    scanned = files.read_tiers(spark, {"Bank": str(tmp_path / "a"), "Unused": str(tmp_path / "b")})
    assert rows(files.scan_tolerant(scanned, SCHEMA).select("file", "lineno", "excerpt_id")) == [("one.jsonl", 2, None), ("one.jsonl", 7, "b")]
    assert {r[0] for r in scanned.select("tier").collect()} == {"Bank", "Unused"}
    assert rows(files.completed_ids(scanned)) == [("b",)]


def test_strict_scan(spark, tmp_path):
    good = write(tmp_path / "g.jsonl", '{"excerpt_id": "a", "text": "1"}\n{"excerpt_id": "a", "text": "2"}\n{"excerpt_id": "b"}')
    lines = files.read_lines(spark, good)
    assert rows(files.scan_strict(lines, SCHEMA).select("lineno", "text")) == [(1, "1"), (2, "2"), (3, None)]
    assert rows(files.scan_keyed(lines, SCHEMA, ["excerpt_id"]).select("excerpt_id", "text")) == [("a", "2"), ("b", None)]
    bad = files.read_lines(spark, write(tmp_path / "b.jsonl", '{"excerpt_id": "a"}\n{oops'))
    with pytest.raises(Exception, match="undecodable line 2"):
        files.scan_strict(bad, SCHEMA).collect()


def test_names_ids_arrays(spark, tmp_path):
    lines = files.read_lines(spark, write(tmp_path / "n.txt", " B \n\nA\nB"))
    assert rows(files.ordered_names(lines, 3)) == [(0, "B"), (1, "A"), (2, "B")] and rows(files.id_list(lines)) == [("A",), ("B",)]
    with pytest.raises(Exception, match="names: 3"):
        files.ordered_names(lines, 13).collect()
    array = write(tmp_path / "a.json", json.dumps([{"excerpt_id": "a"}, {"text": "t"}]))
    assert rows(files.read_array(spark, array, SCHEMA)) == sorted([("a", None), (None, "t")], key=repr)


def test_matrix_round_trip(spark, tmp_path):
    path = write(tmp_path / "m.csv", sinks.matrix_header(["A", "B c"]) + "\nA,0,1\nB c,1,0\n")
    assert rows(files.read_matrix(spark, path)) == [("A", "B c", 1), ("B c", "A", 1)]
    summary = write(tmp_path / "s.csv", "Cause,Effect,Ground truth\nA,B c,1\n")
    assert rows(files.read_edge_summary(spark, summary)) == [("A", "B c", "1")]


def test_blocks_and_metric_text(spark):
    graphs = spark.createDataFrame([(1, "e", None, "ok"), (2, None, "f", None)], "k INT, excerpt_id STRING, firm STRING, status STRING")
    edges = spark.createDataFrame([(1, 0, 1)], "k INT, i INT, j INT")
    got = dict(rows(sinks.stacked_blocks(graphs, edges, "k", 2)))
    assert got[1] == "excerpt_id: e\nfirm: \nstatus: ok\n0,1\n0,0\n" and got[2].endswith("0,0\n0,0\n")
    df = spark.createDataFrame([(1, 0.12345, None, 7), (2, 2.0, 1.0, None)], "k INT, a DOUBLE, b DOUBLE, c INT")
    assert rows(sinks.metric_text(df, ["k"])) == [(1, "0.1235", "", "7"), (2, "2.0000", "1.0000", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], SCHEMA)
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.append_log(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert text.count('{"excerpt_id":"a"}') == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_csv(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2 and not (tmp_path / "none").exists()


def test_stream_appends_each_answer_once(spark, tmp_path):
    line = lambda k, a: json.dumps({"excerpt_id": k, "model": "m", "raw_response": a, "delivered_at": "2024-01-01T00:00:00Z"})
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write(source / "1.json", line("a", "FINAL: X -> Y") + "\n" + line("b", "FINAL: NONE"))
    append_log.append(append_log.parsed_stream(spark, str(source)), out, state).awaitTermination(60)
    write(source / "2.json", line("a", "FINAL: X -> Z") + "\n" + line("c", ""))
    append_log.append(append_log.parsed_stream(spark, str(source)), out, state).awaitTermination(60)
    assert rows(spark.read.json(out).select("excerpt_id", "cause", "effect", "status")) == sorted(
        [("a", "X", "Y", "ok"), ("b", None, None, "none"), ("c", None, None, "malformed")], key=repr
    )


def test_line_numbers_over_splits(spark, tmp_path):
    """A file read in many splits has the numbers of the whole."""
    lines = ["x" * (i % 37) for i in range(3_000)]
    path = write(tmp_path / "long.txt", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = files.read_lines(spark, path)
        assert read.rdd.getNumPartitions() >= 1 and [tuple(r) for r in read.orderBy("lineno").collect()] == [("long.txt", i, x) for i, x in enumerate(lines, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stream_keeps_answers_without_excerpt(spark, tmp_path):
    """Identifiers are folded; rows without one are no copies of each other; rows too late are told."""
    at = lambda d: f"2024-0{d}-01T00:00:00Z"
    data = [("a", "m", at(5)), (" A ", "M", at(5)), (None, "m", at(5)), (None, "m", at(5)), ("b", "m", at(1))]
    write(tmp_path / "in" / "one.json", "\n".join(json.dumps({"excerpt_id": e, "model": m, "raw_response": "A -> B", "delivered_at": t}) for e, m, t in data))
    query = append_log.append(append_log.parsed_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = [r.excerpt_id for r in spark.read.json(str(tmp_path / "out")).collect()]
    assert len(got) == 4 and got.count(None) == 2
    assert rows(append_log.late_rows(spark, str(tmp_path / "in")).select("excerpt_id")) == [("b",)]


def test_console_lines(spark):
    df = spark.createDataFrame([("m", 0.5, None), ("a name longer than its column", 2.0, 3.0)], "model STRING, a DOUBLE, b DOUBLE")
    got = sorted(r.line for r in sinks.console_lines(df, [("model", 8, None), ("a", 7, 3), ("b", 5, 1)]).collect())
    assert got == ["a name longer than its column   2.000   3.0", "m          0.500     —"]
