import json
import random
from collections import Counter

from causeway.operators import nested_records as N
from tests.conftest import rows


def records(spark, *texts):
    data = [(i, t, "x", 5) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(data, "chain_id BIGINT, record_json STRING, parent_node STRING, pre INT")


def test_shapes(spark):
    one = {
        "source_location": {"pages": [3, None, " ", 4]},
        "edges_claimed": [None, {"from": "A", "evidence": ["x", None, {"quote": "y"}]}, {"evidence": "z"}],
        "surface_forms": {"A": ["f", "", {"form": "g", "hits": 1}], "B": "h", "C": None},
    }
    two = [{"source_location": [None, {"pages": 7}], "surface_forms": [{"node": "A", "forms": ["k"]}, {"node": "A", "forms": ["l"]}, {"node": None, "forms": ["m"]}]}]
    got = rows(N.children(records(spark, json.dumps(one), json.dumps(two))))
    assert got == sorted([
        (1, "location", "", 1), (1, "page", "1", 1), (1, "page", "1", 4), (1, "edge", "", 2), (1, "edge", "", 3),
        (1, "evidence", "2", 1), (1, "evidence", "2", 3), (1, "evidence", "3", 1),
        (1, "form", "A", 1), (1, "form", "A", 3), (1, "form", "B", 1),
        (2, "location", "", 2), (2, "page", "2", 1), (2, "form", "A", 1),
    ], key=repr)


def test_no_record(spark):
    df = records(spark, None, "", "{", "[]", "[{}, {}]", "3", '"a"', "null", '{"edges_claimed": [1, "x"]}')
    assert N.children(df).count() == 0
    assert N.children(df.limit(0)).count() == 0


def test_intervals_nest(spark):
    text = json.dumps({"source_location": [{"pages": list(range(500))}, {"pages": [1]}], "edges_claimed": {"evidence": ["a" * 100_000]}})
    nodes = {(r.kind, r.pre): r for r in N.label_nodes(records(spark, text)).collect()}
    assert sorted(r.pre for r in nodes.values()) == sorted(r.post for r in nodes.values()) == list(range(len(nodes)))
    root = nodes["record", 0]
    assert all(n.pre > root.pre and n.post < root.post for k, n in nodes.items() if k != ("record", 0))
    linked = N.link_nodes(N.label_nodes(records(spark, text))).where("kind = 'page'").collect()
    assert all(r.parent_node.pre < r.pre and r.parent_node.post > r.post for r in linked)
    assert len(linked) == 501
    assert N.node_table(records(spark, text), "evidence").first().quote == "a" * 100_000


def _random(rnd, depth=0):
    names = ["source_location", "pages", "edges_claimed", "evidence", "surface_forms", "node", "forms", "form", "nodes_mentioned", "causal_markers", "notes", "excerpt", "text", "x", "A"]
    pick = rnd.random()
    if depth < 4 and pick < 0.35:
        return {n: _random(rnd, depth + 1) for n in rnd.sample(names, rnd.randint(0, 5))}
    if depth < 4 and pick < 0.6:
        return [_random(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([None, True, False, 0, 7, 1.5, "", " ", "word", "ü\n", "A"])


def _leaves(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _leaves(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v, path)]
    return [(path, value if value is None or isinstance(value, str) else json.dumps(value))]


def test_every_leaf_is_found_again(spark):
    """Random records of known and unknown parts: no scalar is lost, each lies in its owner's interval."""
    rnd = random.Random(3)
    made = [{n: _random(rnd, 1) for n in ("source_location", "edges_claimed", "surface_forms", "nodes_mentioned", "causal_markers", "notes", "other")} for _ in range(60)]
    df = records(spark, *map(json.dumps, made))
    nodes = N.label_nodes(df).collect()
    for i, record in enumerate(made, 1):
        own = [r for r in nodes if r.chain_id == i]
        assert sorted(r.pre for r in own) == list(range(len(own)))
        leaves = Counter((r.path, r.value) for r in own if r.type in ("string", "number", "boolean", "null"))
        assert leaves == Counter(_leaves(record))
    fields = N.field_table(df).collect()
    by_pre = {(r.chain_id, r.pre): r for r in nodes}
    for r in fields:
        owner = by_pre[r.chain_id, r.owner_pre]
        inner = [n for n in nodes if n.chain_id == r.chain_id and n.kind not in ("field", "part") and n.pre < r.pre and n.post > r.post]
        assert owner.kind == r.owner and owner.pre == max(n.pre for n in inner)


def test_tables_of_further_parts(spark):
    text = json.dumps({"nodes_mentioned": ["A", None, {"name": "B"}], "causal_markers": "so", "notes": ["n", " "], "excerpt": "e", "surface_forms": {"C": "c"}, "extra": {"deep": [1, {"k": "v"}]}})
    df = records(spark, text)
    assert [(r.pos, r.mention) for r in N.node_table(df, "mention").orderBy("pre").collect()] == [(1, "A"), (3, "B")]
    assert [r.marker for r in N.node_table(df, "marker").collect()] == ["so"] and [r.note for r in N.node_table(df, "note").collect()] == ["n"]
    assert [r.excerpt for r in N.node_table(df, "excerpt").collect()] == ["e"] and [r.node for r in N.node_table(df, "node").collect()] == ["C"]
    assert {(r.path, r.value) for r in N.field_table(df).where("owner = 'record'").collect()} >= {("extra.deep", "1"), ("extra.deep.k", "v")}


def test_other_records(spark):
    """Another specification shreds other records."""
    spec = N.Part("order", parts={"lines": N.Part("line", parts={"tags": N.Part("tag", ())})})
    nodes = N.label_nodes(records(spark, json.dumps({"no": 1, "lines": [{"sku": "a", "tags": ["x", "y"]}, {"sku": "b"}]})), spec=spec)
    assert rows(nodes.groupBy("kind").count()) == sorted([("order", 1), ("line", 2), ("tag", 2), ("field", 3), ("part", 2)], key=repr)
