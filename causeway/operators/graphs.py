"""Causal graphs as edge lists: views of the node list, canonical edges, outcomes of predicted edges, edge classes.

A view maps concept names to node indexes: identity, or with some names merged into one node at the place of
the first. Views are small dimensions; Spark broadcasts them where it measures them small. Edges are rows (graph, i, j); matrices are made at the sinks only.
Null or unknown names are off the list; null edge arrays have no edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_view(concepts: DataFrame, members: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """GRA-1, 2: ``item`` (lower case), ``node``, ``idx`` from 0; ``members`` share one node."""
    low = F.lower("label")
    merged = low.isin([m.lower() for m in members]) if members else F.lit(False)
    named = concepts.where("label IS NOT NULL").select(
        "concept_id", low.alias("item"), F.when(merged, F.lit(label)).otherwise(F.col("label")).alias("node")
    )
    # the list is a dimension: one window over it is one small task
    first = Window.partitionBy("node")
    placed = named.withColumn("__first", F.min("concept_id").over(first))
    return placed.select("item", "node", (F.dense_rank().over(Window.orderBy("__first")) - 1).cast("int").alias("idx"))


def view_size(view: DataFrame) -> int:
    """Number of nodes of a view."""
    return view.select("idx").distinct().count()


def _indexed(edges: DataFrame, view: DataFrame) -> DataFrame:
    """Edges (.., cause, effect) with ``i`` and ``j``, null for names off the list."""
    side = lambda n: view.select(F.col("item").alias(f"__{n}"), F.col("idx").alias(n))
    return (
        edges.join(side("i"), F.lower("cause") == F.col("__i"), "left").join(side("j"), F.lower("effect") == F.col("__j"), "left").drop("__i", "__j")
    )


def truth_edges(graphs: DataFrame, view: DataFrame, key: str, edges: str = "ground_truth_edges") -> DataFrame:
    """GRA-3: distinct ``key, i, j`` of [cause, effect] arrays, unknown names and self-loops left out."""
    rows = graphs.select(key, F.explode(edges).alias("e")).select(key, F.get("e", F.lit(0)).alias("cause"), F.get("e", F.lit(1)).alias("effect"))
    return _indexed(rows, view).where("i IS NOT NULL AND j IS NOT NULL AND i <> j").select(key, "i", "j").distinct()


def predicted_outcomes(graphs: DataFrame, view: DataFrame, key: str, edges: str = "predicted_edges") -> DataFrame:
    """GRA-4: ``key, pos, i, j, outcome`` of each predicted edge: off_list, unknown, self_loop, duplicate or kept."""
    rows = graphs.select(key, F.posexplode(edges).alias("pos", "e")).select(
        key, "pos", F.col("e.cause").alias("cause"), F.col("e.effect").alias("effect"), F.col("e.status").alias("edge_status")
    )
    placed = _indexed(rows, view)
    outcome = (
        F.when(F.col("edge_status") == "not_in_ontology", "off_list")
        .when(F.col("i").isNull() | F.col("j").isNull(), "unknown")
        .when(F.col("i") == F.col("j"), "self_loop")
        .otherwise("kept")
    )
    placed = placed.withColumn("outcome", outcome)
    nth = F.row_number().over(Window.partitionBy(key, "outcome", "i", "j").orderBy("pos"))
    return placed.withColumn("outcome", F.when((F.col("outcome") == "kept") & (nth > 1), "duplicate").otherwise(F.col("outcome"))).select(
        key, "pos", "i", "j", "outcome"
    )


def predicted_edges(graphs: DataFrame, view: DataFrame, key: str, edges: str = "predicted_edges") -> DataFrame:
    """GRA-4 without statistics: distinct ``key, i, j``."""
    rows = graphs.select(key, F.explode(edges).alias("e")).where("e.status IS NULL OR e.status <> 'not_in_ontology'")
    named = rows.select(key, F.col("e.cause").alias("cause"), F.col("e.effect").alias("effect"))
    return _indexed(named, view).where("i IS NOT NULL AND j IS NOT NULL AND i <> j").select(key, "i", "j").distinct()


def outcome_counts(outcomes: DataFrame, key: str) -> DataFrame:
    """Per graph the predicted edges of each outcome."""
    kinds = ("kept", "duplicate", "self_loop", "unknown", "off_list")
    return outcomes.groupBy(key).agg(*[F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds])


def union_truth(pairs: DataFrame, view: DataFrame, cause: str, effect: str) -> DataFrame:
    """GRA-5: distinct ``i, j`` over all records; a name off the list is an error."""
    rows = pairs.select(F.col(cause).alias("cause"), F.col(effect).alias("effect")).distinct()
    placed = _indexed(rows, view)
    bad = F.raise_error(F.concat(F.lit("not on the concept list: "), F.coalesce("cause", F.lit("null")), F.lit(" -> "), F.coalesce("effect", F.lit("null"))))
    checked = placed.withColumn("i", F.when(F.col("i").isNull() | F.col("j").isNull(), bad.cast("int")).otherwise(F.col("i")))
    return checked.select("i", "j").distinct()


def union_predicted(pairs: DataFrame, view: DataFrame, by: str, cause: str = "predicted_cause", effect: str = "predicted_effect") -> DataFrame:
    """GRA-6: distinct ``by, i, j`` of ok records; self-loops stay."""
    rows = pairs.where("status = 'ok'").select(by, F.col(cause).alias("cause"), F.col(effect).alias("effect"))
    return _indexed(rows, view).where("i IS NOT NULL AND j IS NOT NULL").select(by, "i", "j").distinct()


def distinct_truths(graphs: DataFrame, edges: str = "ground_truth_edges") -> DataFrame:
    """GRA-7: the number of different ground truths; 1 if they are uniform."""
    return graphs.select(F.array_sort(F.array_distinct(edges)).alias("t")).agg(F.count_distinct("t").alias("n_truths"))


def with_missing(models: Column, excerpts: DataFrame, graphs: DataFrame) -> DataFrame:
    """GRA-8: every one of the few models with every excerpt; pairs without a record have status missing and no edges.

    The grid is the meaning of the result: a model that skipped an excerpt still scores on it.
    """
    grid = excerpts.withColumn("model", F.explode(models))
    joined = grid.join(graphs, ["model", "excerpt_id"], "left")
    return joined.withColumn("status", F.when(F.col("result_id").isNull(), "missing").otherwise(F.col("status")))


def edge_classes(truth: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GRA-9: ``keys, i, j, class`` with TP, FP and FN."""
    on = [*keys, "i", "j"]
    t, p = truth.withColumn("__t", F.lit(True)), predicted.withColumn("__p", F.lit(True))
    joined = t.join(p, on, "full_outer")
    kind = F.when(F.col("__t") & F.col("__p"), "TP").when(F.col("__p"), "FP").otherwise("FN")
    return joined.select(*on, kind.alias("class"))


def reciprocal(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GRA-10: node pairs with edges both ways."""
    pair = [F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")]
    return edges.where("i <> j").groupBy(*keys, *pair).agg(F.count_distinct("i").alias("n")).where("n > 1").drop("n")


def label_points(edges: DataFrame, n: int, offset: float = 0.1) -> DataFrame:
    """GRA-11: where an edge's label goes: the middle of the edge on a circle layout, moved at right angles."""
    angle = lambda c: F.col(c) * (2 * 3.141592653589793 / n)
    x0, y0, x1, y1 = F.cos(angle("i")), F.sin(angle("i")), F.cos(angle("j")), F.sin(angle("j"))
    dx, dy = x1 - x0, y1 - y0
    size = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    return edges.withColumn("x", (x0 + x1) / 2 - dy / size * offset).withColumn("y", (y0 + y1) / 2 + dx / size * offset)
