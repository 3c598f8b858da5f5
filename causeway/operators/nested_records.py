"""Flat, linked tables out of deeply nested records.

Every record is walked depth-first once; each node (object, list or scalar, known or not) gets the interval (pre-order number,
post-order number) of its walk. A node lies inside another exactly if its interval does, so the
tables per node type carry all parent-child links without any path bookkeeping, and a link is an
interval containment. What the types are is stated by a specification (``CHAIN`` for the chain annotations, a
parameter for others); nodes without a type of their own come as ``field`` (scalars) or ``part`` (objects and lists), so nothing is lost.

The walk runs where the row is read (no shuffle); the containment join is one window per record ordered by pre-order: of each
parent type the nearest preceding node, taken if its post-order number is greater. Nodes of a type never contain each other, so that is
the only candidate. It costs O(n log n) per record and never pairs nodes; a record is one row of the input, so no partition of the
window is larger than one record. Queries on some types ask the walk for these only; the numbers stay those of the whole walk.

Defined results: null, undecodable or incomplete records, and records that are neither an object nor
a one-element array of one, give no rows; null and blank entries have no type but keep their
place; parts written alone instead of in a list have place 1; keys that repeat within an object
keep the last value; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "chain_id BIGINT, kind STRING, pre INT, post INT, depth INT, pos INT, name STRING, path STRING, type STRING, label STRING, value STRING"
)


@dataclass(frozen=True)
class Part:
    """A part of a record that becomes a node type.

    It is written alone or in a list. With ``text``, an entry is a scalar or an object that has the text in one of these members; without,
    it is an object with own fields and further ``parts``. A ``keyed`` part is an object whose keys name the nodes, or
    entries that have their name and their inner part in the two members given.
    """

    kind: str
    text: tuple[str, ...] | None = None
    parts: dict[str, Part] = field(default_factory=dict)
    keyed: tuple[str, str] | None = None


#: The parts of a chain annotation.
CHAIN = Part(
    "record",
    parts={
        "source_location": Part("location", parts={"pages": Part("page", ("page",))}),
        "edges_claimed": Part("edge", parts={"evidence": Part("evidence", ("quote", "text"))}),
        "surface_forms": Part("node", keyed=("node", "forms"), parts={"forms": Part("form", ("form",))}),
        "nodes_mentioned": Part("mention", ("node", "name", "label")),
        "causal_markers": Part("marker", ("marker", "text")),
        "notes": Part("note", ("note", "text")),
        "excerpt": Part("excerpt", ("text",)),
    },
)


def _json_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "list"


def _plain(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _text(entry: object, names: Sequence[str]) -> str | None:
    """The text of an entry: itself or the first of the named members; None if blank."""
    if isinstance(entry, dict):
        entry = next((entry[n] for n in names if entry.get(n) is not None), None)
    if entry is None or isinstance(entry, (dict, list)):
        return None
    text = _plain(entry)
    return text if text.strip() else None


_ALONE, _LISTED, _NAMED = range(3)


class _Walk:
    """Depth-first numbering of one record; pre and post come from two counters.

    Children are tuples (value, part, place, name, path, how): a part that may be a list, an entry of one, or a node that its key names.
    Nodes of types that are not asked for are numbered and no more.
    """

    def __init__(self, key: int, out: list[tuple], kinds: frozenset[str] | None, values: bool):
        self.key, self.out, self.kinds, self.values, self.pre, self.post = key, out, kinds, values, 0, 0

    def node(self, kind: str, depth: int, pos: int, name, path: str, sort: str, label, own, children) -> None:
        pre = self.pre
        self.pre += 1
        for value, part, place, key, inner, how in children:
            self.visit(value, part, depth + 1, place, key, inner, how)
        if self.kinds is None or kind in self.kinds:
            content = (name, path, sort, label, own) if self.values else (None, None, None, label, None)
            self.out.append((self.key, kind, pre, self.post, depth, pos, *content))
        self.post += 1

    def visit(self, value, part: Part | None, depth: int, pos: int, name: str | None, path: str, how: int = _ALONE) -> None:
        kind = type(value)
        if part is None and kind is not dict and kind is not list:
            if self.kinds is None or "field" in self.kinds:
                self.out.append((self.key, "field", self.pre, self.post, depth, pos, name, path, _json_type(value), None, _plain(value)))
            self.pre += 1
            self.post += 1
            return
        if how == _NAMED:
            self.node(part.kind, depth, pos, name, path, "key", name, None, ((value, part.parts[part.keyed[1]], 1, None, path, _ALONE),))
            return
        sort = _json_type(value)
        if part is not None and sort == "list" and how == _ALONE:
            self.node("part", depth, pos, name, path, sort, None, None, [(x, part, i, None, path, _LISTED) for i, x in enumerate(value, 1)])
        elif part is not None and part.keyed:
            self._keyed(value, part, depth, pos, name, path, how)
        elif part is None or (_text(value, part.text) is None if part.text is not None else sort != "object"):
            inner = sort in ("object", "list")
            self.node("part" if inner else "field", depth, pos, name, path, sort, None, None if inner else _plain(value), self._inner(value, sort, {}, path))
        elif part.text is not None:
            self.node(part.kind, depth, pos, name, path, sort, None, _text(value, part.text), self._inner(value, sort, {}, path))
        else:
            self.node(part.kind, depth, pos, name, path, sort, None, self._own(value, part.kind, part.parts), self._inner(value, sort, part.parts, path))

    def _keyed(self, value, part: Part, depth: int, pos: int, name, path: str, how: int) -> None:
        name_of, inner_of = part.keyed
        if isinstance(value, dict) and how == _ALONE and not (name_of in value and inner_of in value):
            named = [(v, part if k.strip() else None, i, k, f"{path}.{k}", _NAMED if k.strip() else _ALONE) for i, (k, v) in enumerate(value.items(), 1)]
            self.node("part", depth, pos, name, path, "object", None, None, named)
            return
        label = value.get(name_of) if isinstance(value, dict) else None
        if not isinstance(label, str) or not label.strip():
            self.visit(value, None, depth, pos, name, path)
            return
        own = self._own(value, part.kind, part.parts)
        self.node(part.kind, depth, pos, name, path, "object", label, own, self._inner(value, "object", part.parts, path))

    def _own(self, value: dict, kind: str, parts: dict[str, Part]) -> str | None:
        """The members of a node that are no parts, as JSON."""
        if not self.values or self.kinds is not None and kind not in self.kinds:
            return None
        return json.dumps({k: v for k, v in value.items() if k not in parts}, ensure_ascii=False)

    @staticmethod
    def _inner(value, sort: str, parts: dict[str, Part], path: str) -> list | tuple:
        if sort == "object":
            return [(v, parts.get(k), 1, k, f"{path}.{k}" if path else k, _ALONE) for k, v in value.items()]
        return [(x, None, i, None, path, _ALONE) for i, x in enumerate(value, 1)] if sort == "list" else ()


def decode_record(text: object) -> dict | None:
    """The one object that a record is, or None."""
    if not isinstance(text, str):
        return None
    try:
        record = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if isinstance(record, list) and len(record) == 1:
        record = record[0]
    return record if isinstance(record, dict) else None


def label_nodes(records: DataFrame, kinds: Sequence[str] | None = None, spec: Part = CHAIN, values: bool = True) -> DataFrame:
    """One row per node of every record with its interval, type, place and own content; of all types or of ``kinds`` only.

    Without ``values`` nodes come with their label alone, for queries on links.
    """
    wanted = frozenset(kinds) if kinds is not None else None

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for frame in frames:
            out: list[tuple] = []
            for key, text in zip(frame["chain_id"], frame["record_json"]):
                record = decode_record(text)
                if record is not None:
                    _Walk(key, out, wanted, values).visit(record, spec, 0, 1, None, "")
            yield pd.DataFrame(out, columns=names)

    return records.select("chain_id", "record_json").mapInPandas(batches, NODE_SCHEMA)


#: child type -> (parent type, whether the parent is named by its label instead of its place)
LINKS = {"page": ("location", False), "evidence": ("edge", False), "form": ("node", True)}
#: Types whose parent is the record itself.
TOP = ("location", "edge", "node", "mention", "marker", "note", "excerpt")


def enclosing(kind: str) -> Column:
    """The node of a type that contains the row, null if none: the last one begun before it, if it ends after it."""
    before = Window.partitionBy("chain_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == kind, F.struct("pre", "post", "pos", "label", "kind")), ignorenulls=True).over(before)
    return F.when(last["post"] > F.col("post"), last)


def link_nodes(nodes: DataFrame) -> DataFrame:
    """Each node with its nearest enclosing node of its parent type (interval containment)."""
    parents = sorted({p for p, _ in LINKS.values()})
    linked = nodes.select("*", *[enclosing(p).alias(f"__{p}") for p in parents])
    up = F.coalesce(*[F.when(F.col("kind") == child, F.col(f"__{p}")) for child, (p, _) in LINKS.items()])
    return linked.withColumn("parent_node", up).drop(*[f"__{p}" for p in parents])


CHILDREN = ("location", "page", "edge", "evidence", "form")


def children(records: DataFrame) -> DataFrame:
    """``chain_id, child, parent, pos`` of each location, page, edge, evidence and form."""
    by_label = F.col("kind").isin([c for c, (_, named) in LINKS.items() if named])
    parent = F.when(by_label, F.col("parent_node.label")).otherwise(
        F.coalesce(F.col("parent_node.pos").cast("string"), F.lit(""))
    )
    return (
        link_nodes(label_nodes(records, (*CHILDREN, "node"), values=False))
        .where(F.col("kind").isin(*CHILDREN))
        .select("chain_id", F.col("kind").alias("child"), parent.alias("parent"), "pos")
        .dropDuplicates(["chain_id", "child", "parent", "pos"])
    )


def node_table(records: DataFrame, kind: str) -> DataFrame:
    """The flat table of one node type: interval, place, parent interval and own fields."""
    kinds = (kind, LINKS[kind][0]) if kind in LINKS else (kind,)
    rows = link_nodes(label_nodes(records, kinds)).where(F.col("kind") == kind)
    common = [
        "chain_id", "pre", "post", "pos",
        F.col("parent_node.pre").alias("parent_pre"),
        F.col("parent_node.pos").alias("parent_pos"),
    ]
    member = lambda name: F.get_json_object("value", f"$.{name}")
    own = {
        "location": [member("file").alias("file"), member("section").alias("section"), member("subsection").alias("subsection")],
        "edge": [member("from").alias("from_node"), member("to").alias("to_node"), member("sign").alias("sign"),
                 member("direction").alias("direction"), member("explicit").cast("boolean").alias("explicit")],
        "node": [F.col("label").alias("node")],
        "page": [F.col("value").try_cast("int").alias("page")],
        "evidence": [F.col("value").alias("quote")],
        "form": [F.col("parent_node.label").alias("node"), F.col("value").alias("form")],
    }
    return rows.select(*common, *own.get(kind, [F.col("value").alias(kind)]))


def leaves(records: DataFrame) -> DataFrame:
    """``chain_id, path, type, value`` of every scalar of every record, typed nodes or not."""
    return label_nodes(records).where(F.col("type").isin("string", "number", "boolean", "null")).select("chain_id", "path", "type", F.when(F.col("type") != "null", F.col("value")).alias("value"))


def field_table(records: DataFrame) -> DataFrame:
    """Every other scalar, whatever part it stands in: its path, value, and the nearest typed node that contains it.

    Together with the values of the typed tables these are all leaves of all records.
    """
    nodes = label_nodes(records)
    owners = ("record", *TOP, *LINKS)
    around = [enclosing(k) for k in owners]
    nearest = F.array_max(F.array_compact(F.array(*around)))
    return (
        nodes.withColumn("owner", nearest).where("kind = 'field'")
        .select("chain_id", "pre", "post", "pos", "name", "path", "type", "value", F.col("owner.kind").alias("owner"), F.col("owner.pre").alias("owner_pre"))
    )
