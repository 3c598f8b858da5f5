from pyspark.sql import functions as F

from causeway.operators import answers as A
from causeway.operators import grading as G
from tests.conftest import rows


def parsed(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_thinking_and_fallback(spark):
    texts = ["<think>a\n-> b</think> X -> Y", "<THINK>open X", "<|think|>q<|/think|>z"]
    assert parsed(spark, texts, A.strip_thinking) == ["X -> Y", "<THINK>open X", "z"]
    df = spark.createDataFrame([(1, " \n", "t"), (2, "r", "t"), (3, None, None)], "i INT, r STRING, t STRING")
    assert [r[0] for r in df.orderBy("i").select(A.answer_text(F.col("r"), F.col("t"))).collect()] == ["t", "r", ""]


def test_single(spark):
    texts = ["So\nA -> B\n\n", "FINAL: A -> B\nFINAL: C -> D -> E\nbye", "CAUSE -> EFFECT: X -> Y\nFINAL ANSWER: P -> Q", "A -> B.", "none", "", "-> x", "FINAL: NONE"]
    one = lambda v: [None if p is None else (p.cause, p.effect, p.status) for p in parsed(spark, texts, lambda c: A.parse_single(c, v))]
    assert one("hard")[0] == ("A", "B", "ok") and one("hard")[3] == ("A", "B.", "ok") and one("instruct")[3] == ("A", "B", "ok")
    assert [x[2] for x in one("hard")[4:7]] == ["none", "malformed", "malformed"]
    assert one("soft")[1] == ("C", "D -> E", "ok") and one("soft")[7] == (None, None, "none") and one("soft")[0][2] == "malformed"
    assert one("marked")[2] == ("X", "Y", "ok")  # a later pattern beats a later match


def test_multi(spark):
    texts = ["text\n1. A -> B.\n* C -> D\nNONE", "NONE", "A -> B\nNONE", "A -> B\nbut\nNONE", "A -> B\nwords", "", "NONE\nx -> y"]
    got = [([(e.cause, e.effect) for e in p.edges], p.status) for p in parsed(spark, texts, A.parse_multi_hard)]
    assert got == [
        ([("A", "B"), ("C", "D")], "ok"), ([], "none"), ([("A", "B")], "ok"), ([], "malformed"), ([], "malformed"), ([], "malformed"), ([("x", "y")], "ok"),
    ]
    soft = ["FINAL: A -> B\n  final: C -> D\nFINAL: words", "FINAL: NONE", "x FINAL: A -> B", ""]
    got = [([(e.cause, e.effect) for e in p.edges], p.status) for p in parsed(spark, soft, A.parse_multi_soft)]
    assert got == [([("A", "B"), ("C", "D")], "ok"), ([], "none"), ([], "malformed"), ([], "malformed")]


def test_resolve(spark):
    concepts = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, None)], "concept_id INT, label STRING")
    df = spark.createDataFrame([(1, "ALPHA", "beta", "ok"), (2, "alpha", "x", "ok"), (3, None, None, "none")], "i INT, cause STRING, effect STRING, status STRING")
    assert rows(A.resolve_pair(df, concepts)) == sorted([(1, "Alpha", "Beta", "ok"), (2, "alpha", "x", "not_in_ontology"), (3, None, None, "none")], key=repr)
    assert A.resolve_pair(df.limit(0), concepts).count() == 0


def test_grading(spark):
    edge = "ARRAY<STRUCT<cause: STRING, effect: STRING>>"
    df = spark.createDataFrame(
        [(1, [("A", "X"), ("a2", "X"), ("A", "X")], [["M", "X"]]), (2, None, []), (3, [("A", None)], [["M", "X"]])],
        f"i INT, p {edge}, t ARRAY<ARRAY<STRING>>",
    )
    got = df.select("i", G.edges_match(F.col("p"), G.pairs_to_edges(F.col("t")), ["a", "A2"], "M"))
    assert rows(got) == [(1, True), (2, True), (3, False)]


def test_runs(spark):
    a = spark.createDataFrame([("e1", "ok", 1), ("e2", None, 2), ("e2", "x", 3)], "excerpt_id STRING, status STRING, n INT")
    b = spark.createDataFrame([("e2", "new", 9), ("e7", "only", 8)], "excerpt_id STRING, status STRING, n INT")
    assert rows(G.supersede(a, b, ["excerpt_id"])) == [("e1", "ok", 1), ("e2", "new", 9), ("e2", "new", 9)]
    assert rows(G.latest_per_key(a, ["excerpt_id"], "n")) == [("e1", "ok", 1), ("e2", "x", 3)]
    assert rows(G.not_completed(a, b, ["excerpt_id"]).select("excerpt_id")) == [("e1",)]
    assert rows(G.unmatched_ids(a, b)) == [("e7",)] and G.only_listed(a, b).count() == 2
    assert rows(G.count_check(a, "excerpt_id", 1)) == [("e2", 2)]


def test_prompts(spark):
    concepts = spark.createDataFrame([(2, "B"), (1, "A")], "concept_id INT, label STRING")
    p = A.build_prompts(spark.createDataFrame([(1, "passage"), (2, None)], "i INT, text STRING"), concepts, "instruct").orderBy("i").collect()
    assert "- A\n- B" in p[0].prompt and p[0].prompt.endswith("passage\n\n/no_think") and p[1].prompt
