import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import grading as G
from causeway.operators import graph_metrics as M
from causeway.operators import graphs as H
from tests.conftest import rows


# ---- the definitions, written down on matrices -------------------------------------------------


def ratio(a, b):
    return a / b if b else 0.0


def brute(pred, true, n):
    p, g = {e for e in pred if e[0] != e[1]}, {e for e in true if e[0] != e[1]}
    ps, gs = {frozenset(e) for e in p}, {frozenset(e) for e in g}
    tp, fp, fn = len(p & g), len(p - g), len(g - p)
    tn = n * (n - 1) - tp - fp - fn
    shared = ps & gs
    on = lambda s: {e for e in s if frozenset(e) in shared}
    differing = sum({e for e in p if frozenset(e) == k} != {e for e in g if frozenset(e) == k} for k in shared)
    add = dele = rev = 0
    for i, j in itertools.combinations(range(n), 2):
        a, b, c, d = ((i, j) in p, (j, i) in p, (i, j) in g, (j, i) in g)
        if (a or b) and not (c or d):
            add += a + b
        elif (c or d) and not (a or b):
            dele += c + d
        elif (a, b) != (c, d):
            if a == d and b == c and a != c:
                rev += 1
            else:
                add += (a and not c) + (b and not d)
                dele += (c and not a) + (d and not b)
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "adj_precision": ratio(len(shared), len(ps)), "adj_recall": ratio(len(shared), len(gs)),
        "ori_precision": ratio(len(on(p) & on(g)), len(on(p))), "ori_recall": ratio(len(on(p) & on(g)), len(on(g))),
        "shd_strict": fp + fn, "shd_reversal": len(ps ^ gs) + differing, "shd_additions": add, "shd_deletions": dele, "shd_reversals": rev,
        "mcc": (tp * tn - fp * fn) / math.sqrt(den) if den else 0.0, "exact_match": int(p == g),
    }


def separated(edges, x, y, given):
    """By paths: every path is blocked (a chain or fork node in the set, or a collider without descendants in it)."""
    if x in given or y in given:
        return True
    children, nodes = {}, {v for e in edges for v in e}
    for a, b in edges:
        children.setdefault(a, set()).add(b)

    def below(v):
        seen, todo = {v}, [v]
        while todo:
            for c in children.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    def walk(path):
        if path[-1] == y:
            return all(
                (below(b) & given) if ((a, b) in edges and (c, b) in edges) else b not in given
                for a, b, c in zip(path, path[1:], path[2:])
            )
        return any(walk([*path, v]) for v in nodes if v not in path and ((path[-1], v) in edges or (v, path[-1]) in edges))

    return not walk([x])


def dag(rnd, n, share):
    order = rnd.sample(range(n), n)
    return {(order[a], order[b]) for a in range(n) for b in range(a + 1, n) if rnd.random() < share}


def as_masks(edges, n):
    out = [0] * n
    for i, j in edges:
        out[i] |= 1 << j
    return out


def brute_distance(pred, true, n):
    below = lambda v: {w for w in range(n) if M.reach_of(as_masks(true, n), 1 << v) >> w & 1}
    wrong = 0
    for x, y in itertools.permutations(range(n), 2):
        given = {i for i, j in pred if j == x} - {y}
        cut = {(i, j) for i, j in true if j != x}
        wrong += bool(given & below(x)) or not separated(cut, x, y, given)
    return wrong


def test_d_separation_against_paths():
    rnd = random.Random(1)
    for _ in range(60):
        n = 6
        edges = dag(rnd, n, 0.35)
        parent = M.transpose(as_masks(edges, n))
        for x, y in itertools.combinations(range(n), 2):
            given = {v for v in range(n) if v not in (x, y) and rnd.random() < 0.3}
            assert M.d_separated(parent, x, y, sum(1 << v for v in given)) == separated(edges, x, y, given)


def test_intervention_distance_against_brute_force():
    rnd = random.Random(2)
    for _ in range(40):
        n = 6
        p, g = dag(rnd, n, 0.3), dag(rnd, n, 0.3)
        assert M.intervention_distance(as_masks(p, n), as_masks(g, n)) == brute_distance(p, g, n)


def test_intervention_distance_of_a_chain():
    chain = as_masks({(0, 1), (1, 2), (2, 3)}, 12)
    assert M.intervention_distance(chain, chain) == 6 and M.intervention_distance([0] * 12, chain) == 6
    assert M.intervention_distance(as_masks({(0, 1), (1, 0)}, 12), chain) is None


def test_metrics_against_brute_force(spark):
    rnd, n = random.Random(3), 7
    cases = [({(i, j) for i in range(n) for j in range(n) if rnd.random() < a}, {(i, j) for i in range(n) for j in range(n) if rnd.random() < b})
             for a, b in [(0.2, 0.2), (0.0, 0.2), (0.3, 0.0), (0.0, 0.0), (0.5, 0.5), (0.9, 0.9)] * 3]
    graphs = spark.createDataFrame([(k,) for k in range(len(cases))], "k INT")
    frame = lambda which: spark.createDataFrame([(k, i, j) for k, c in enumerate(cases) for i, j in c[which] if i != j], "k INT, i INT, j INT")
    pred, true = frame(0), frame(1)
    got = {r.k: r for r in M.all_metrics(graphs, true, pred, "k", n).collect()}
    assert len(got) == len(cases)
    for k, (p, g) in enumerate(cases):
        for name, value in brute(p, g, n).items():
            assert math.isclose(got[k][name], value, abs_tol=1e-12), (k, name)
    cyc = {r.k: r for r in M.closure_metrics(graphs, true, pred, "k", n).collect()}
    for k, (p, _) in enumerate(cases):
        masks = as_masks({e for e in p if e[0] != e[1]}, n)
        cyclic = any(M.reach_of(masks, masks[v]) >> v & 1 for v in range(n))
        assert cyc[k].is_dag == (not cyclic) and (cyc[k].sid is None) == cyclic


def test_views_and_outcomes(spark):
    concepts = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "concept_id INT, label STRING")
    view = H.node_view(concepts, ["b", "D"], "M")
    assert rows(view) == [("a", "A", 0), ("b", "M", 1), ("c", "C", 2), ("d", "M", 1)] and H.view_size(view) == 3
    edge = "ARRAY<STRUCT<cause: STRING, effect: STRING, status: STRING>>"
    graphs = spark.createDataFrame([
        (1, [("a", "B", "ok"), ("A", "d", "ok"), ("B", "D", "ok"), ("x", "A", "ok"), ("A", "C", "not_in_ontology"), (None, "A", None)], [["A", "B"], ["A", "D"], ["Q", "A"], ["C"]]),
        (2, None, None), (3, [], []),
    ], f"k INT, predicted_edges {edge}, ground_truth_edges ARRAY<ARRAY<STRING>>")
    assert rows(H.predicted_outcomes(graphs, view, "k").select("pos", "outcome")) == [
        (0, "kept"), (1, "duplicate"), (2, "self_loop"), (3, "unknown"), (4, "off_list"), (5, "unknown"),
    ]
    assert rows(H.truth_edges(graphs, view, "k")) == [(1, 0, 1)] and rows(H.predicted_edges(graphs, view, "k")) == [(1, 0, 1)]
    assert rows(H.edge_classes(H.truth_edges(graphs, view, "k"), H.predicted_edges(graphs, view, "k").limit(0), ["k"])) == [(1, 0, 1, "FN")]
    empty = graphs.limit(0)
    assert M.all_metrics(empty, H.truth_edges(empty, view, "k"), H.predicted_edges(empty, view, "k"), "k", 3).count() == 0
    only = graphs.where("k = 2")
    row = M.all_metrics(only, H.truth_edges(only, view, "k"), H.predicted_edges(only, view, "k"), "k", 3).first()
    assert row.tn == 6 and row.mcc == 0.0 and row.exact_match == 1 and row.adj_f1 == 0.0


def test_macro_means_skip_null(spark):
    df = spark.createDataFrame([("m", 1.0, 2), ("m", 0.0, None)], "model STRING, f DOUBLE, sid INT")
    assert rows(M.macro_means(df, "model", ["f", "sid"])) == [("m", 2, 0.5, 2.0, 0.5)]


def test_union_truth_raises_for_unknown_names(spark):
    import pytest

    concepts = spark.createDataFrame([(1, "A")], "concept_id INT, label STRING")
    pairs = spark.createDataFrame([("A", "Z")], "c STRING, e STRING")
    with pytest.raises(Exception, match="not on the concept list"):
        H.union_truth(pairs, H.node_view(concepts), "c", "e").collect()


def test_masks_are_guarded(spark):
    edges = spark.createDataFrame([(1, 0, 62)], "k INT, i INT, j INT")
    assert M.masks(edges, "k", 63).first().adjacency[0] == 1 << 62
    with pytest.raises(ValueError):
        M.masks(edges, "k", 64)


def test_surgery(spark):
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 3)], "k INT, i INT, j INT")
    cut = M.masks(edges, "k", 4).select(M.surgery(F.col("adjacency"), F.lit(2)).alias("a")).first().a
    assert list(cut) == [0, 0, 8, 0]


def test_several_rerun_rows_of_a_key(spark):
    schema = "id STRING, row_id INT, status STRING"
    first = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "x")], schema)
    again = spark.createDataFrame([("a", 7, "y"), ("a", 9, None), ("c", 8, "y")], schema)
    assert rows(G.supersede(first, again, ["id"])) == [("a", 9, None), ("a", 9, None), ("b", 2, "x")]
