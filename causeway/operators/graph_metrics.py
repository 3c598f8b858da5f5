"""Scores of predicted graphs against true ones.

Count metrics come from one full outer join of the edge lists, one aggregation to node pairs and one to graphs.
Closure metrics use bitmasks of up to 63 nodes: cycles and ancestors by Warshall's fold in column
expressions, the intervention distance in an Arrow pass over (graph, masks).

A ratio with denominator 0 is 0.0; the intervention distance of a cyclic prediction is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.patterns import share


def f1(p: Column, r: Column) -> Column:
    return share(2 * p * r, p + r)


def _pairs(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Per unordered node pair the four direction flags."""
    t = truth.where("i <> j").select(key, "i", "j", F.lit(1).alias("g"))
    p = predicted.where("i <> j").select(key, "i", "j", F.lit(1).alias("p"))
    cells = t.join(p, [key, "i", "j"], "full_outer").select(
        key, "i", "j", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p")
    )
    up = F.col("i") < F.col("j")
    flag = lambda c, side: F.max(F.when(side, F.col(c)).otherwise(0))
    return cells.groupBy(key, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(
        flag("p", up).alias("p1"), flag("p", ~up).alias("p2"), flag("g", up).alias("g1"), flag("g", ~up).alias("g2")
    )


def counts(graphs: DataFrame, truth: DataFrame, predicted: DataFrame, key: str, n: int) -> DataFrame:
    """MET-1..4, 7, 9..11, 23: the counts all other metrics are made of, for every graph of ``graphs``."""
    p, g = F.col("p1") + F.col("p2"), F.col("g1") + F.col("g2")
    both1, both2 = F.col("p1") * F.col("g1"), F.col("p2") * F.col("g2")
    shared = (p > 0) & (g > 0)
    same = (F.col("p1") == F.col("g1")) & (F.col("p2") == F.col("g2"))
    swapped = shared & (F.col("p1") == F.col("g2")) & (F.col("p2") == F.col("g1")) & (F.col("p1") != F.col("g1"))
    on = lambda test, value: F.sum(F.when(test, value).otherwise(0))
    tp = both1 + both2
    rest = shared & ~swapped
    per_graph = _pairs(truth, predicted, key).groupBy(key).agg(
        F.sum(tp).alias("tp"), F.sum(p - tp).alias("fp"), F.sum(g - tp).alias("fn"),
        F.count_if(shared).alias("tp_skeleton"), F.count_if((p > 0) & (g == 0)).alias("fp_skeleton"), F.count_if((p == 0) & (g > 0)).alias("fn_skeleton"),
        on(shared, tp).alias("ori_correct_on_shared"), on(shared, p - tp).alias("__ori_fp"), on(shared, g - tp).alias("__ori_fn"),
        F.count_if(shared & ~same).alias("__differing"),
        (on((g == 0) & (p > 0), p) + on(rest, p - tp)).alias("shd_additions"),
        (on((g > 0) & (p == 0), g) + on(rest, g - tp)).alias("shd_deletions"), F.count_if(swapped).alias("shd_reversals"),
        F.sum(p).alias("pred_edge_count"), F.sum(g).alias("gt_edge_count"),
    )
    joined = graphs.select(key).join(per_graph, key, "left")
    filled = joined.select(key, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in per_graph.columns if c != key])
    return (
        filled.withColumn("tn", F.lit(n * (n - 1)) - F.col("tp") - F.col("fp") - F.col("fn"))
        .withColumn("tn_skeleton", F.lit(n * (n - 1) // 2) - F.col("tp_skeleton") - F.col("fp_skeleton") - F.col("fn_skeleton"))
        .withColumn("ori_shared_skeleton_count", F.col("tp_skeleton"))
    )


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """MET-12..14."""
    specificity, sensitivity = share(tn, tn + fp), share(tp, tp + fn)
    d = lambda c: c.cast("double")
    factors = d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn)
    return {
        "specificity": specificity, "fdr": share(fp, tp + fp), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp),
        "accuracy": share(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (sensitivity + specificity) / 2,
        "mcc": F.when(factors > 0, (d(tp) * d(tn) - d(fp) * d(fn)) / F.sqrt(factors)).otherwise(0.0),
    }


def all_metrics(graphs: DataFrame, truth: DataFrame, predicted: DataFrame, key: str, n: int) -> DataFrame:
    """MET-24: one row of all count metrics per graph."""
    c = counts(graphs, truth, predicted, key, n)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    stp, sfp, sfn = (F.col(f"{x}_skeleton") for x in ("tp", "fp", "fn"))
    adj_p, adj_r = share(stp, stp + sfp), share(stp, stp + sfn)
    oc, of, on = F.col("ori_correct_on_shared"), F.col("__ori_fp"), F.col("__ori_fn")
    ori_p, ori_r = share(oc, oc + of), share(oc, oc + on)
    full_p, full_r = share(tp, tp + fp), share(tp, tp + fn)
    strict, aware = fp + fn, sfp + sfn + F.col("__differing")
    shd = F.col("shd_additions") + F.col("shd_deletions") + F.col("shd_reversals")
    least = F.greatest(F.col("gt_edge_count"), F.lit(1))
    own = {
        "adj_precision": adj_p, "adj_recall": adj_r, "adj_f1": f1(adj_p, adj_r),
        "skeleton_precision": adj_p, "skeleton_recall": adj_r, "skeleton_f1": f1(adj_p, adj_r), "skeleton_shd": sfp + sfn,
        "ori_precision": ori_p, "ori_recall": ori_r, "ori_f1": f1(ori_p, ori_r),
        "ori_precision_full": full_p, "ori_recall_full": full_r, "ori_f1_full": f1(full_p, full_r),
        "shd_strict": strict, "shd_reversal": aware, "shd_breakdown": shd,
        "shd_strict_norm_edges": strict / least, "shd_strict_norm_possible": strict / F.lit(n * (n - 1)),
        "shd_reversal_norm_edges": aware / least, "shd_reversal_norm_possible": aware / F.lit(n * (n - 1)),
        "exact_match": F.when(strict == 0, 1).otherwise(0), "density": F.col("pred_edge_count") / F.lit(n * n),
    } | rates(tp, fp, fn, tn)
    keep = [x for x in c.columns if not x.startswith("__")]
    return c.select(*keep, *[v.alias(k) for k, v in own.items()])


#: Nodes that a mask of 64 bits with sign holds.
MOST_NODES = 63


def bit(k: Column) -> Column:
    """The mask with bit ``k``."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


def has_bit(mask: Column, k: Column) -> Column:
    return F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1


def masks(edges: DataFrame, key: str, n: int) -> DataFrame:
    """MET-18: per graph ``adjacency``: an array of n bitmasks of children; more than ``MOST_NODES`` nodes are an error."""
    if n > MOST_NODES:
        raise ValueError(f"masks hold at most {MOST_NODES} nodes, not {n}")
    rows = edges.groupBy(key, "i").agg(F.bit_or(bit(F.col("j"))).alias("m"))
    by_node = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("m"))
    nodes = F.sequence(F.lit(0), F.lit(n - 1))
    return by_node.select(key, F.transform(nodes, lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("bigint"))).alias("adjacency"))


def parents(adjacency: Column) -> Column:
    """MET-18: bitmasks of parents."""
    size = F.size(adjacency)
    zero = F.lit(0).cast("bigint")

    def of(j: Column) -> Column:
        hits = F.transform(adjacency, lambda m, i: F.when(has_bit(m, j), bit(i)).otherwise(zero))
        return F.aggregate(hits, zero, lambda a, b: a.bitwiseOR(b))

    return F.transform(F.sequence(F.lit(0), size - 1), of)


def closure(adjacency: Column) -> Column:
    """MET-19: bitmasks of all nodes reachable over at least one edge (Warshall)."""
    nodes = F.sequence(F.lit(0), F.size(adjacency) - 1)

    def through(reach: Column, k: Column) -> Column:
        via = F.element_at(reach, k + 1)
        return F.transform(reach, lambda m: F.when(has_bit(m, k), m.bitwiseOR(via)).otherwise(m))

    return F.aggregate(nodes, adjacency, through)


def is_cyclic(reach: Column) -> Column:
    """MET-17: whether some node reaches itself."""
    own = F.transform(reach, lambda m, i: has_bit(m, i))
    return F.exists(own, lambda x: x)


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def transpose(adjacency: list[int]) -> list[int]:
    out = [0] * len(adjacency)
    for i, m in enumerate(adjacency):
        for j in _bits(m):
            out[j] |= 1 << i
    return out


def reach_of(adjacency: list[int], start: int) -> int:
    """Nodes reachable from the set ``start``, itself included."""
    seen, todo = start, start
    while todo:
        low = todo & -todo
        fresh = adjacency[low.bit_length() - 1] & ~seen
        seen |= fresh
        todo = (todo ^ low) | fresh
    return seen


def d_separated(parent: list[int], x: int, y: int, given: int) -> bool:
    """MET-20: by the moral graph of the ancestors; a conditioned end counts as separated, x = y as not."""
    if x == y:
        return False
    if given >> x & 1 or given >> y & 1:
        return True
    near = reach_of(parent, 1 << x | 1 << y | given)
    moral = [0] * len(parent)
    for v in _bits(near):
        family = parent[v] & near
        moral[v] |= family
        for p in _bits(family):
            moral[p] |= 1 << v | (family & ~(1 << p))
    free = [m & ~given for m in moral]
    return not reach_of(free, 1 << x) >> y & 1


def cut_incoming(parent: list[int], x: int) -> list[int]:
    """MET-21: graph surgery on parent masks."""
    return [*parent[:x], 0, *parent[x + 1 :]]


def surgery(adjacency: Column, x: Column) -> Column:
    """MET-21: graph surgery on child masks: no edge into x is left."""
    return F.transform(adjacency, lambda m: m.bitwiseAND(F.bitwise_not(bit(x))))


def intervention_distance(predicted: list[int], truth: list[int]) -> int | None:
    """MET-22: pairs (x, y) for which the predicted parents of x fail as adjustment set; null for cyclic predictions.

    The set fails if it holds a descendant of x, or if x and y are not d-separated by it in the true graph
    without the edges into x. This is not the published distance: causal paths count as failures, so the truth
    itself does not score 0.
    """
    n = len(predicted)
    pred_parent, true_parent = transpose(predicted), transpose(truth)
    if any(reach_of(predicted, predicted[v]) >> v & 1 for v in range(n)):
        return None
    linked = 0
    for i, m in enumerate(truth):
        if m:
            linked |= 1 << i | m
    wrong = 0
    for x in range(n):
        bad = pred_parent[x] & reach_of(truth, 1 << x)
        without = cut_incoming(true_parent, x)
        if bad.bit_count() > 1:
            wrong += n - 1
            continue
        # with one bad parent, only that parent itself as y escapes the first test
        wrong += n - 2 if bad else 0
        for y in _bits(bad if bad else linked & ~(1 << x)):
            if linked >> x & 1 and linked >> y & 1 and not d_separated(without, x, y, pred_parent[x] & ~(1 << y)):
                wrong += 1
    return wrong


def closure_metrics(graphs: DataFrame, truth: DataFrame, predicted: DataFrame, key: str, n: int) -> DataFrame:
    """MET-17, 22: ``key, is_dag, sid`` of every graph of ``graphs``; n at most 63."""
    none = F.array_repeat(F.lit(0).cast("bigint"), n)
    joined = (
        graphs.select(key).join(masks(predicted, key, n).withColumnRenamed("adjacency", "p"), key, "left")
        .join(masks(truth, key, n).withColumnRenamed("adjacency", "g"), key, "left")
        .select(key, F.coalesce("p", none).alias("p"), F.coalesce("g", none).alias("g"))
    )
    kind = graphs.schema[key].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, int | None] = {}
        for frame in frames:
            out = []
            for k, p, g in zip(frame[key], frame["p"], frame["g"]):
                both = (tuple(map(int, p)), tuple(map(int, g)))
                if both not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[both] = intervention_distance([*both[0]], [*both[1]])
                out.append((k, known[both]))
            yield pd.DataFrame(out, columns=[key, "sid"]).astype({"sid": "Int64"})

    distance = joined.mapInPandas(batches, f"`{key}` {kind}, sid BIGINT")
    return distance.withColumn("is_dag", F.when(F.col("sid").isNull(), 0).otherwise(1))


def macro_means(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """AGG-9: means over graphs, nulls skipped, and the share of graphs with a distance."""
    means = [F.avg(m).alias(f"{m}_mean") for m in metrics]
    extra = [F.avg(F.col("sid").isNotNull().cast("double")).alias("sid_computable_fraction")] if "sid" in metrics else []
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_graphs"), *means, *extra)
