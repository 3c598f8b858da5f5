"""Queries on graphs and their scores, and their SQL twins (stage D: GRA, MET, AGG-9, pivots)."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import grading as G
from causeway.operators import graph_metrics as M
from causeway.operators import graphs as H
from causeway.plans.answer_queries import COMPOUND, MEMBERS
from causeway.plans.report_queries import strip
from causeway.sources import read_table, sinks

KEY = "result_id"


def _graphs(s, d):
    return read_table(s, d, "dag_results")


def _view(s, d, compound=False):
    concepts = read_table(s, d, "concepts")
    return H.node_view(concepts, MEMBERS, COMPOUND) if compound else H.node_view(concepts)


def _edges(s, d, compound=False):
    graphs, view = _graphs(s, d), _view(s, d, compound)
    return H.truth_edges(graphs, view, KEY), H.predicted_edges(graphs, view, KEY), H.view_size(view)


def metrics(s, d, compound=False):
    truth, predicted, n = _edges(s, d, compound)
    return M.all_metrics(_graphs(s, d), truth, predicted, KEY, n)


def _metric(*columns, compound=False):
    return lambda s, d: metrics(s, d, compound).select(KEY, *columns)


def _closure(s, d, compound=False):
    truth, predicted, n = _edges(s, d, compound)
    return M.closure_metrics(_graphs(s, d), truth, predicted, KEY, n)


def _dags(s, d):
    _, predicted, n = _edges(s, d)
    m = M.masks(predicted, KEY, n)
    cyc = m.select(KEY, M.is_cyclic(M.closure(F.col("adjacency"))).alias("c"))
    return _graphs(s, d).select(KEY).join(cyc, KEY, "left").select(KEY, F.when(F.coalesce("c", F.lit(False)), 0).otherwise(1).alias("is_dag"))


def _degrees(s, d):
    _, predicted, n = _edges(s, d)
    m = M.masks(predicted, KEY, n).select(KEY, F.col("adjacency").alias("c"), M.parents(F.col("adjacency")).alias("p"))
    rows = m.select(KEY, F.posexplode(F.arrays_zip("c", "p")).alias("node", "z"))
    return rows.select(KEY, "node", F.bit_count("z.p").alias("n_parents"), F.bit_count("z.c").alias("n_children")).where("n_parents + n_children > 0")


def _reach(s, d):
    _, predicted, n = _edges(s, d)
    m = M.masks(predicted, KEY, n).select(KEY, F.posexplode(M.closure(F.col("adjacency"))).alias("node", "r"))
    itself = M.bit(F.col("node"))
    return m.where("r <> 0").select(KEY, "node", F.bit_count(F.col("r").bitwiseOR(itself)).alias("n_descendants"))


def _surgery(s, d):
    """MET-21: the edges that are left of every true graph when those into one of its nodes are cut, for each node."""
    truth, _, n = _edges(s, d)
    nodes = truth.select(KEY, F.explode(F.array("i", "j")).alias("node")).distinct()
    cut = M.masks(truth, KEY, n).join(nodes, KEY).select(KEY, "node", F.posexplode(M.surgery(F.col("adjacency"), F.col("node"))).alias("i", "m"))
    left = cut.where("m <> 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.where(M.has_bit(F.col("m"), F.col("j"))).select(KEY, "node", "i", "j")


def _separation(s, d):
    """MET-20: for every true graph the linked node pairs x < y that one linked node z separates."""
    truth, _, n = _edges(s, d)
    rows = M.masks(truth, KEY, n)

    def batches(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for key, adjacency in zip(frame[KEY], frame["adjacency"]):
                own = [int(x) for x in adjacency]
                parent = M.transpose(own)
                nodes = [v for v in range(len(own)) if own[v] or parent[v]]
                out += [(key, x, y, z) for x in nodes for y in nodes for z in nodes if x < y and z not in (x, y) and M.d_separated(parent, x, y, 1 << z)]
            yield pd.DataFrame(out, columns=[KEY, "x", "y", "z"])

    return rows.mapInPandas(batches, f"{KEY} BIGINT, x INT, y INT, z INT")


METRIC_NAMES = ["tp", "fp", "fn", "tn", "adj_f1", "ori_f1", "ori_f1_full", "shd_strict", "shd_reversal", "mcc", "accuracy", "exact_match"]


def _macro(compound):
    def run(s, d):
        scored = metrics(s, d, compound).join(_graphs(s, d).select(KEY, G.model_key().alias("model")), KEY)
        rows = M.macro_means(scored, "model", METRIC_NAMES)
        return rows.select("model", "n_graphs", *[F.round(f"{m}_mean", 9).alias(f"{m}_mean") for m in METRIC_NAMES])

    return run


def _macro_sid(s, d):
    scored = _closure(s, d).join(_graphs(s, d).select(KEY, G.model_key().alias("model")), KEY)
    return M.macro_means(scored, "model", ["sid", "is_dag"])


def _with_models(s, d):
    graphs = _graphs(s, d).withColumn("model", G.model_key()).where("excerpt_id IS NOT NULL")
    first = graphs.groupBy("model", "excerpt_id").agg(F.min_by(F.struct("result_id", "status"), "result_id").alias("r")).select("model", "excerpt_id", "r.*")
    excerpts = graphs.select("excerpt_id").distinct()
    return H.with_missing(graphs.agg(F.collect_set("model")).scalar(), excerpts, first)


def _matrix(s, d):
    """SNK-3: the matrix of how many true graphs have each edge, dense, one column per effect."""
    view = _view(s, d)
    nodes = view.select("idx", "node").distinct()
    truth, _, n = _edges(s, d)
    cells = truth.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy("i").pivot("j", list(range(n))).agg(F.first("n"))
    return nodes.join(wide, F.col("idx") == F.col("i"), "left").select("idx", "node", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"to_{k}") for k in range(n)])


def _summary(s, d):
    """SNK-5: status summary with a ground-truth row."""
    rows = G.status_counts(_graphs(s, d), True)
    truth, _, _ = _edges(s, d)
    gt = truth.agg(F.count_distinct(KEY).alias("n_records")).select(F.lit("ground truth").alias("model"), "n_records", *[F.lit(None).cast("bigint").alias(c) for c in rows.columns[2:]])
    return rows.unionByName(gt)


#: Models that get a column of their own at most.
MOST_MODELS = 200


def _names(models):
    """The models in order, for tables with a column each; too many are an error."""
    names = [r[0] for r in models.select("model").distinct().orderBy("model").limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    return names


def _safe(model):
    return "n_" + "".join(c if c.isalnum() else "_" for c in model)


def _edge_summary(s, d):
    """SNK-6: per edge the number of graphs of the truth and of each model, ordered by node indexes."""
    truth, predicted, _ = _edges(s, d)
    models = _graphs(s, d).select(KEY, G.model_key().alias("model"))
    names = _names(models)
    gt = truth.select("i", "j", F.lit("ground truth").alias("model"))
    both = gt.unionByName(predicted.join(models, KEY).select("i", "j", "model"))
    wide = both.groupBy("i", "j").pivot("model", ["ground truth", *names]).count()
    return wide.select("i", "j", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(_safe(m)) for m in ["ground truth", *names]]).orderBy("i", "j")


def _transposed(s, d):
    """SNK-8: one row per metric, one column per model."""
    long = _macro(False)(s, d).unpivot(["model"], [f"{m}_mean" for m in METRIC_NAMES], "metric", "value")
    names = _names(_graphs(s, d).select(G.model_key().alias("model")))
    wide = long.groupBy("metric").pivot("model", names).agg(F.first("value"))
    return wide.select("metric", *[F.col(f"`{m}`").alias(_safe(m)) for m in names])


#: The columns of the console table: name, width, decimals.
CONSOLE = (("model", 28, None), ("adj_f1_mean", 8, 3), ("ori_f1_mean", 8, 3), ("shd_strict_mean", 8, 2), ("mcc_mean", 8, 3), ("exact_match_mean", 10, 3), ("sid_mean", 8, 1), ("sid_computable_fraction", 8, 2))


def _console(s, d):
    """SNK-12: macro means of each model as lines of fixed widths."""
    return sinks.console_lines(_macro(False)(s, d).join(_macro_sid(s, d).drop("n_graphs"), "model"), list(CONSOLE))


QUERIES = {
    "gra_1_identity_view": lambda s, d: _view(s, d),
    "gra_2_compound_view": lambda s, d: _view(s, d, True),
    "gra_3_truth_edges": lambda s, d: _edges(s, d)[0],
    "gra_3_truth_edges_compound": lambda s, d: _edges(s, d, True)[0],
    "gra_4_outcomes": lambda s, d: H.predicted_outcomes(_graphs(s, d), _view(s, d), KEY),
    "gra_4_outcome_counts": lambda s, d: H.outcome_counts(H.predicted_outcomes(_graphs(s, d), _view(s, d, True), KEY), KEY),
    "gra_5_union_truth": lambda s, d: H.union_truth(read_table(s, d, "pair_results").where("ground_truth_cause IS NOT NULL AND ground_truth_effect IS NOT NULL"), _view(s, d), "ground_truth_cause", "ground_truth_effect"),
    "gra_6_union_predicted": lambda s, d: H.union_predicted(read_table(s, d, "pair_results").withColumn("model", G.model_key()), _view(s, d), "model"),
    "gra_7_uniform_truth": lambda s, d: H.distinct_truths(_graphs(s, d)),
    "gra_8_grid": _with_models,
    "gra_9_edge_classes": lambda s, d: H.edge_classes(*_edges(s, d)[:2], [KEY]),
    "gra_10_reciprocal": lambda s, d: H.reciprocal(_edges(s, d)[1], [KEY]),
    "gra_11_label_points": lambda s, d: H.label_points(_edges(s, d)[0].select("i", "j").distinct(), 34).select("i", "j", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y")),
    "met_1_directed": lambda s, d: _edges(s, d)[1],
    "met_2_skeleton": lambda s, d: _edges(s, d)[1].select(KEY, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).distinct(),
    "met_3_confusion": _metric("tp", "fp", "fn", "tn"),
    "met_3_confusion_compound": _metric("tp", "fp", "fn", "tn", compound=True),
    "met_4_skeleton_confusion": _metric("tp_skeleton", "fp_skeleton", "fn_skeleton", "tn_skeleton"),
    "met_5_adjacency": _metric("adj_precision", "adj_recall", "adj_f1"),
    "met_6_skeleton": _metric("skeleton_precision", "skeleton_recall", "skeleton_f1", "skeleton_shd"),
    "met_7_orientation_shared": _metric("ori_precision", "ori_recall", "ori_f1", "ori_shared_skeleton_count", "ori_correct_on_shared"),
    "met_8_orientation_full": _metric("ori_precision_full", "ori_recall_full", "ori_f1_full"),
    "met_9_shd_strict": _metric("shd_strict"),
    "met_10_shd_reversal": _metric("shd_reversal"),
    "met_11_shd_breakdown": _metric("shd_additions", "shd_deletions", "shd_reversals", "shd_breakdown"),
    "met_12_rates": _metric("specificity", "fdr", "fpr", "fnr", "accuracy"),
    "met_13_balanced_accuracy": _metric("balanced_accuracy"),
    "met_14_mcc": _metric("mcc"),
    "met_15_normalised_shd": _metric("shd_strict_norm_edges", "shd_strict_norm_possible", "shd_reversal_norm_edges", "shd_reversal_norm_possible"),
    "met_16_exact_match": _metric("exact_match"),
    "met_17_is_dag": _dags,
    "met_18_degrees": _degrees,
    "met_19_descendants": _reach,
    "met_20_d_separation": _separation,
    "met_21_surgery": _surgery,
    "met_22_intervention_distance": _closure,
    "met_22_intervention_distance_compound": lambda s, d: _closure(s, d, True),
    "met_23_edge_counts": _metric("pred_edge_count", "gt_edge_count"),
    "met_24_all": lambda s, d: metrics(s, d),
    "met_24_all_compound": lambda s, d: metrics(s, d, True),
    "met_25_density": _metric("density"),
    "agg_9_macro": _macro(False),
    "agg_9_macro_compound": _macro(True),
    "agg_9_macro_distance": _macro_sid,
    "snk_3_matrix": _matrix,
    "snk_5_status_summary": _summary,
    "snk_6_edge_summary": _edge_summary,
    "snk_8_transposed": _transposed,
    "snk_12_console": _console,
}

# ------------------------------------------------------------------------------------------ SQL

_MODEL = f"coalesce(lower({strip('model')}), '')"


def _view_sql(compound: bool) -> str:
    node = "CASE WHEN lower(label) IN ('equity valuation', 'share quotation') THEN 'Market Value' ELSE label END" if compound else "label"
    return f"""SELECT item, node, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INT) AS idx FROM (
      SELECT *, min(concept_id) OVER (PARTITION BY node) AS first FROM (SELECT concept_id, lower(label) AS item, {node} AS node FROM concepts WHERE label IS NOT NULL))"""


def _n(compound: bool) -> int:
    return 33 if compound else 34


def _base(compound: bool) -> str:
    return f"""v AS MATERIALIZED ({_view_sql(compound)}),
      gr AS (SELECT result_id, e[1] AS cause, e[2] AS effect FROM (SELECT result_id, unnest(ground_truth_edges) AS e FROM dag_results)),
      t AS MATERIALIZED (SELECT DISTINCT result_id, a.idx AS i, b.idx AS j FROM gr JOIN v a ON lower(cause) = a.item JOIN v b ON lower(effect) = b.item WHERE a.idx <> b.idx),
      pr AS (SELECT result_id, pos, e.cause AS cause, e.effect AS effect, e.status AS s FROM (SELECT result_id, unnest(predicted_edges) AS e, CAST(generate_subscripts(predicted_edges, 1) - 1 AS INT) AS pos FROM dag_results)),
      po AS MATERIALIZED (SELECT result_id, pos, a.idx AS i, b.idx AS j, s FROM pr LEFT JOIN v a ON lower(cause) = a.item LEFT JOIN v b ON lower(effect) = b.item),
      p AS MATERIALIZED (SELECT DISTINCT result_id, i, j FROM po WHERE i <> j AND s IS DISTINCT FROM 'not_in_ontology')"""


def _with(select: str, compound: bool = False, more: str = "") -> str:
    return f"WITH RECURSIVE {_base(compound)}{', ' + more if more else ''} {select}"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"


def _metric_ctes(compound: bool) -> str:
    n = _n(compound)
    return f"""cell AS (SELECT coalesce(t.result_id, p.result_id) AS result_id, coalesce(t.i, p.i) AS i, coalesce(t.j, p.j) AS j, CASE WHEN t.i IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS q
        FROM t FULL OUTER JOIN p ON t.result_id = p.result_id AND t.i = p.i AND t.j = p.j),
      pair AS (SELECT result_id, least(i, j) AS lo, greatest(i, j) AS hi, max(CASE WHEN i < j THEN q ELSE 0 END) AS p1, max(CASE WHEN i > j THEN q ELSE 0 END) AS p2,
        max(CASE WHEN i < j THEN g ELSE 0 END) AS g1, max(CASE WHEN i > j THEN g ELSE 0 END) AS g2 FROM cell GROUP BY ALL),
      w AS (SELECT *, p1 + p2 AS pn, g1 + g2 AS gn, p1 * g1 + p2 * g2 AS hit, p1 + p2 > 0 AND g1 + g2 > 0 AS shared,
        p1 + p2 > 0 AND g1 + g2 > 0 AND p1 = g2 AND p2 = g1 AND p1 <> g1 AS swapped FROM pair),
      c0 AS (SELECT result_id, sum(hit) AS tp, sum(pn - hit) AS fp, sum(gn - hit) AS fn, count(*) FILTER (WHERE shared) AS tp_skeleton,
        count(*) FILTER (WHERE pn > 0 AND gn = 0) AS fp_skeleton, count(*) FILTER (WHERE pn = 0 AND gn > 0) AS fn_skeleton,
        coalesce(sum(hit) FILTER (WHERE shared), 0) AS ori_correct_on_shared, coalesce(sum(pn - hit) FILTER (WHERE shared), 0) AS ofp, coalesce(sum(gn - hit) FILTER (WHERE shared), 0) AS ofn,
        count(*) FILTER (WHERE shared AND NOT (p1 = g1 AND p2 = g2)) AS differing,
        coalesce(sum(pn) FILTER (WHERE gn = 0), 0) + coalesce(sum(pn - hit) FILTER (WHERE shared AND NOT swapped), 0) AS shd_additions,
        coalesce(sum(gn) FILTER (WHERE pn = 0), 0) + coalesce(sum(gn - hit) FILTER (WHERE shared AND NOT swapped), 0) AS shd_deletions,
        count(*) FILTER (WHERE swapped) AS shd_reversals, sum(pn) AS pred_edge_count, sum(gn) AS gt_edge_count FROM w GROUP BY result_id),
      c AS (SELECT d.result_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('tp', 'fp', 'fn', 'tp_skeleton', 'fp_skeleton', 'fn_skeleton', 'ori_correct_on_shared', 'ofp', 'ofn', 'differing', 'shd_additions', 'shd_deletions', 'shd_reversals', 'pred_edge_count', 'gt_edge_count'))}
        FROM dag_results d LEFT JOIN c0 USING (result_id)),
      c2 AS (SELECT *, {n * (n - 1)} - tp - fp - fn AS tn, {n * (n - 1) // 2} - tp_skeleton - fp_skeleton - fn_skeleton AS tn_skeleton, tp_skeleton AS ori_shared_skeleton_count FROM c),
      m1 AS (SELECT *, {_div('tp_skeleton', 'tp_skeleton + fp_skeleton')} AS adj_precision, {_div('tp_skeleton', 'tp_skeleton + fn_skeleton')} AS adj_recall,
        {_div('ori_correct_on_shared', 'ori_correct_on_shared + ofp')} AS ori_precision, {_div('ori_correct_on_shared', 'ori_correct_on_shared + ofn')} AS ori_recall,
        {_div('tp', 'tp + fp')} AS ori_precision_full, {_div('tp', 'tp + fn')} AS ori_recall_full, {_div('tn', 'tn + fp')} AS specificity, {_div('fp', 'tp + fp')} AS fdr,
        {_div('fp', 'fp + tn')} AS fpr, {_div('fn', 'fn + tp')} AS fnr, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, fp + fn AS shd_strict, fp_skeleton + fn_skeleton + differing AS shd_reversal,
        CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) AS factors FROM c2),
      m AS (SELECT *, {_div('2 * adj_precision * adj_recall', 'adj_precision + adj_recall')} AS adj_f1, {_div('2 * ori_precision * ori_recall', 'ori_precision + ori_recall')} AS ori_f1,
        {_div('2 * ori_precision_full * ori_recall_full', 'ori_precision_full + ori_recall_full')} AS ori_f1_full, (ori_recall_full + specificity) / 2 AS balanced_accuracy,
        adj_precision AS skeleton_precision, adj_recall AS skeleton_recall, {_div('2 * adj_precision * adj_recall', 'adj_precision + adj_recall')} AS skeleton_f1, fp_skeleton + fn_skeleton AS skeleton_shd,
        CASE WHEN factors > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(factors) ELSE 0.0 END AS mcc,
        shd_additions + shd_deletions + shd_reversals AS shd_breakdown, shd_strict / greatest(gt_edge_count, 1) AS shd_strict_norm_edges, shd_strict / {n * (n - 1)} AS shd_strict_norm_possible,
        shd_reversal / greatest(gt_edge_count, 1) AS shd_reversal_norm_edges, shd_reversal / {n * (n - 1)} AS shd_reversal_norm_possible,
        CASE WHEN shd_strict = 0 THEN 1 ELSE 0 END AS exact_match, pred_edge_count / {n * n} AS density FROM m1)"""


def _metric_sql(*columns: str, compound: bool = False) -> str:
    return _with(f"SELECT result_id, {', '.join(columns)} FROM m", compound, _metric_ctes(compound))


_LINKED = "linked AS MATERIALIZED (SELECT result_id, i AS node FROM t UNION SELECT result_id, j FROM t)"
#: For each question q of ``asked`` (a true graph without the edges into ``cut``, x, y) and its conditioned nodes ``given``, the nodes
#: ``seen`` from x in the moral graph of the ancestors.
_SEPARATION = """anc AS (SELECT q, node FROM (SELECT q, x AS node FROM asked UNION SELECT q, y FROM asked UNION SELECT q, z FROM given)
        UNION SELECT anc.q, t.i FROM anc JOIN asked ON asked.q = anc.q JOIN t ON t.result_id = asked.result_id AND t.j = anc.node AND t.j <> asked.cut),
      own AS MATERIALIZED (SELECT anc.q, t.i, t.j FROM anc JOIN asked ON asked.q = anc.q JOIN t ON t.result_id = asked.result_id AND t.j = anc.node AND t.j <> asked.cut),
      moral AS MATERIALIZED (SELECT q, i AS a, j AS b FROM own UNION SELECT q, j, i FROM own UNION SELECT l.q, l.i, r.i FROM own l JOIN own r ON l.q = r.q AND l.j = r.j AND l.i <> r.i),
      seen AS (SELECT q, x AS node FROM asked UNION SELECT seen.q, moral.b FROM seen JOIN moral ON moral.q = seen.q AND moral.a = seen.node
        WHERE NOT EXISTS (SELECT 1 FROM given WHERE given.q = seen.q AND given.z = moral.b))"""


def _distance_sql(compound: bool) -> str:
    """MET-22: for each node x the number of its predicted parents that are true descendants; then the questions left."""
    n = _n(compound)
    more = f"""{_REACH}, rt AS (SELECT result_id, i, j FROM t UNION SELECT rt.result_id, rt.i, t.j FROM rt JOIN t ON rt.result_id = t.result_id AND rt.j = t.i), {_LINKED},
      bad AS MATERIALIZED (SELECT p.result_id, p.j AS x, p.i AS y FROM p JOIN rt ON rt.result_id = p.result_id AND rt.i = p.j AND rt.j = p.i),
      many AS MATERIALIZED (SELECT result_id, x, count(*) AS k FROM bad GROUP BY ALL),
      asked AS MATERIALIZED (SELECT *, x AS cut, row_number() OVER () AS q FROM (SELECT a.result_id, a.node AS x, b.node AS y FROM linked a JOIN linked b ON a.result_id = b.result_id AND a.node <> b.node
        LEFT JOIN many m ON m.result_id = a.result_id AND m.x = a.node LEFT JOIN bad ON bad.result_id = a.result_id AND bad.x = a.node AND bad.y = b.node WHERE m.k IS NULL OR (m.k = 1 AND bad.y IS NOT NULL))),
      given AS MATERIALIZED (SELECT q, p.i AS z FROM asked JOIN p ON p.result_id = asked.result_id AND p.j = asked.x WHERE p.i <> asked.y), {_SEPARATION},
      failed AS (SELECT result_id, count(*) AS k FROM asked WHERE EXISTS (SELECT 1 FROM seen WHERE seen.q = asked.q AND seen.node = asked.y) GROUP BY ALL),
      sure AS (SELECT result_id, sum(CASE WHEN k > 1 THEN {n - 1} ELSE {n - 2} END) AS k FROM many GROUP BY ALL)"""
    return _with(f"""SELECT result_id, CASE WHEN cyclic THEN 0 ELSE 1 END AS is_dag, CASE WHEN cyclic THEN NULL ELSE CAST(coalesce(f.k, 0) + coalesce(u.k, 0) AS BIGINT) END AS sid FROM (
      SELECT result_id, result_id IN (SELECT result_id FROM r WHERE i = j) AS cyclic FROM dag_results) LEFT JOIN failed f USING (result_id) LEFT JOIN sure u USING (result_id)""", compound, more)


def _macro_distance_sql() -> str:
    return f"SELECT {_MODEL} AS model, count(*) AS n_graphs, avg(sid) AS sid_mean, avg(s.is_dag) AS is_dag_mean, avg(CASE WHEN sid IS NULL THEN 0.0 ELSE 1.0 END) AS sid_computable_fraction FROM ({_distance_sql(False)}) s JOIN dag_results USING (result_id) GROUP BY 1"


def _macro_sql(compound: bool) -> str:
    means = ", ".join(f"round(avg({x}), 9) AS {x}_mean" for x in METRIC_NAMES)
    return _with(f"SELECT {_MODEL} AS model, count(*) AS n_graphs, {means} FROM m JOIN dag_results d USING (result_id) GROUP BY 1", compound, _metric_ctes(compound))


#: The columns of the edge summary in the test tables.
MODELS = ("ground truth", "brisa2.6:11b", "marlo2:7b", "opal-r2:12b", "quill1.4:7b", "quill1.4:7b-instruct", "tarn2:e6b")
_REACH = "r AS (SELECT result_id, i, j FROM p UNION SELECT r.result_id, r.i, p.j FROM r JOIN p ON r.result_id = p.result_id AND r.j = p.i)"
_ALL = (
    "tp", "fp", "fn", "tn", "tp_skeleton", "fp_skeleton", "fn_skeleton", "tn_skeleton", "ori_correct_on_shared", "ori_shared_skeleton_count",
    "shd_additions", "shd_deletions", "shd_reversals", "pred_edge_count", "gt_edge_count", "adj_precision", "adj_recall", "adj_f1",
    "skeleton_precision", "skeleton_recall", "skeleton_f1", "skeleton_shd", "ori_precision", "ori_recall", "ori_f1", "ori_precision_full",
    "ori_recall_full", "ori_f1_full", "shd_strict", "shd_reversal", "shd_breakdown", "shd_strict_norm_edges", "shd_strict_norm_possible",
    "shd_reversal_norm_edges", "shd_reversal_norm_possible", "exact_match", "density", "specificity", "fdr", "fpr", "fnr", "accuracy",
    "balanced_accuracy", "mcc",
)
_OUTCOME = "CASE WHEN s = 'not_in_ontology' THEN 'off_list' WHEN i IS NULL OR j IS NULL THEN 'unknown' WHEN i = j THEN 'self_loop' ELSE 'kept' END"
_OUTCOMES = f"""SELECT result_id, pos, i, j, CASE WHEN o = 'kept' AND row_number() OVER (PARTITION BY result_id, o, i, j ORDER BY pos) > 1 THEN 'duplicate' ELSE o END AS outcome
      FROM (SELECT *, {_OUTCOME} AS o FROM po)"""

SQL = {
    "gra_1_identity_view": _view_sql(False),
    "gra_2_compound_view": _view_sql(True),
    "gra_3_truth_edges": _with("SELECT * FROM t"),
    "gra_3_truth_edges_compound": _with("SELECT * FROM t", True),
    "gra_4_outcomes": _with(_OUTCOMES),
    "gra_4_outcome_counts": _with(f"SELECT result_id, {', '.join(f"count(*) FILTER (WHERE outcome = '{k}') AS n_{k}" for k in ('kept', 'duplicate', 'self_loop', 'unknown', 'off_list'))} FROM ({_OUTCOMES}) GROUP BY result_id", True),
    "gra_5_union_truth": f"WITH v AS ({_view_sql(False)}) SELECT DISTINCT a.idx AS i, b.idx AS j FROM pair_results JOIN v a ON lower(ground_truth_cause) = a.item JOIN v b ON lower(ground_truth_effect) = b.item",
    "gra_6_union_predicted": f"WITH v AS ({_view_sql(False)}) SELECT DISTINCT {_MODEL} AS model, a.idx AS i, b.idx AS j FROM pair_results JOIN v a ON lower(predicted_cause) = a.item JOIN v b ON lower(predicted_effect) = b.item WHERE status = 'ok'",
    "gra_7_uniform_truth": "SELECT count(DISTINCT list_sort(list_distinct(ground_truth_edges))) AS n_truths FROM dag_results",
    "gra_8_grid": f"""WITH g AS (SELECT {_MODEL} AS model, excerpt_id, result_id, status FROM dag_results WHERE excerpt_id IS NOT NULL), f AS (SELECT model, excerpt_id, min(result_id) AS result_id, arg_min(coalesce(status, chr(0)), result_id) AS status FROM g GROUP BY ALL)
      SELECT m.model, e.excerpt_id, f.result_id, CASE WHEN f.result_id IS NULL THEN 'missing' ELSE nullif(f.status, chr(0)) END AS status FROM (SELECT DISTINCT model FROM g) m CROSS JOIN (SELECT DISTINCT excerpt_id FROM g) e LEFT JOIN f ON f.model = m.model AND f.excerpt_id = e.excerpt_id""",
    "gra_9_edge_classes": _with("SELECT coalesce(t.result_id, p.result_id) AS result_id, coalesce(t.i, p.i) AS i, coalesce(t.j, p.j) AS j, CASE WHEN t.i IS NULL THEN 'FP' WHEN p.i IS NULL THEN 'FN' ELSE 'TP' END AS class FROM t FULL OUTER JOIN p ON t.result_id = p.result_id AND t.i = p.i AND t.j = p.j"),
    "gra_10_reciprocal": _with("SELECT result_id, least(i, j) AS lo, greatest(i, j) AS hi FROM p GROUP BY ALL HAVING count(DISTINCT i) > 1"),
    "met_1_directed": _with("SELECT * FROM p"),
    "met_2_skeleton": _with("SELECT DISTINCT result_id, least(i, j) AS lo, greatest(i, j) AS hi FROM p"),
    "met_3_confusion": _metric_sql("tp", "fp", "fn", "tn"),
    "met_3_confusion_compound": _metric_sql("tp", "fp", "fn", "tn", compound=True),
    "met_4_skeleton_confusion": _metric_sql("tp_skeleton", "fp_skeleton", "fn_skeleton", "tn_skeleton"),
    "met_5_adjacency": _metric_sql("adj_precision", "adj_recall", "adj_f1"),
    "met_6_skeleton": _metric_sql("skeleton_precision", "skeleton_recall", "skeleton_f1", "skeleton_shd"),
    "met_7_orientation_shared": _metric_sql("ori_precision", "ori_recall", "ori_f1", "ori_shared_skeleton_count", "ori_correct_on_shared"),
    "met_8_orientation_full": _metric_sql("ori_precision_full", "ori_recall_full", "ori_f1_full"),
    "met_9_shd_strict": _metric_sql("shd_strict"),
    "met_10_shd_reversal": _metric_sql("shd_reversal"),
    "met_11_shd_breakdown": _metric_sql("shd_additions", "shd_deletions", "shd_reversals", "shd_breakdown"),
    "met_12_rates": _metric_sql("specificity", "fdr", "fpr", "fnr", "accuracy"),
    "met_13_balanced_accuracy": _metric_sql("balanced_accuracy"),
    "met_14_mcc": _metric_sql("mcc"),
    "met_15_normalised_shd": _metric_sql("shd_strict_norm_edges", "shd_strict_norm_possible", "shd_reversal_norm_edges", "shd_reversal_norm_possible"),
    "met_16_exact_match": _metric_sql("exact_match"),
    "met_17_is_dag": _with("SELECT result_id, CASE WHEN result_id IN (SELECT result_id FROM r WHERE i = j) THEN 0 ELSE 1 END AS is_dag FROM dag_results", more=_REACH),
    "met_18_degrees": _with("SELECT result_id, node, CAST(sum(inn) AS INT) AS n_parents, CAST(sum(outt) AS INT) AS n_children FROM (SELECT result_id, j AS node, 1 AS inn, 0 AS outt FROM p UNION ALL SELECT result_id, i, 0, 1 FROM p) GROUP BY ALL"),
    "met_19_descendants": _with("SELECT result_id, i AS node, CAST(count(*) FILTER (WHERE j <> i) + 1 AS INT) AS n_descendants FROM r GROUP BY ALL", more=_REACH),
    "met_21_surgery": _with("SELECT t.result_id, node, i, j FROM t JOIN (SELECT result_id, i AS node FROM t UNION SELECT result_id, j FROM t) x ON x.result_id = t.result_id WHERE j <> node"),
    "met_23_edge_counts": _metric_sql("pred_edge_count", "gt_edge_count"),
    "met_24_all": _metric_sql(*_ALL),
    "met_24_all_compound": _metric_sql(*_ALL, compound=True),
    "met_25_density": _metric_sql("density"),
    "agg_9_macro": _macro_sql(False),
    "agg_9_macro_compound": _macro_sql(True),
    "snk_3_matrix": _with(f"SELECT idx, node, {', '.join(f'count(*) FILTER (WHERE j = {k}) AS to_{k}' for k in range(34))} FROM (SELECT DISTINCT idx, node FROM v) LEFT JOIN t ON idx = i GROUP BY ALL"),
    "snk_5_status_summary": _with(f"SELECT {_MODEL} AS model, count(*) AS n_records, {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in G.STATUSES)}, count(*) FILTER (WHERE error IS NOT NULL AND status IS NULL) AS n_error FROM dag_results GROUP BY 1 UNION ALL SELECT 'ground truth', count(DISTINCT result_id), NULL, NULL, NULL, NULL, NULL FROM t"),
    "snk_6_edge_summary": _with(f"SELECT i, j, {', '.join(f"count(*) FILTER (WHERE model = '{m}') AS n_" + ''.join(c if c.isalnum() else '_' for c in m) for m in MODELS)} FROM (SELECT i, j, 'ground truth' AS model FROM t UNION ALL SELECT i, j, {_MODEL} FROM p JOIN dag_results USING (result_id)) GROUP BY i, j ORDER BY i, j"),
    "snk_8_transposed": f"SELECT metric, {', '.join(f"max(value) FILTER (WHERE model = '{m}') AS {_safe(m)}" for m in MODELS[1:])} FROM (SELECT model, metric, value FROM ({_macro_sql(False)}) UNPIVOT (value FOR metric IN ({', '.join(f'{m}_mean' for m in METRIC_NAMES)}))) GROUP BY metric",
    "gra_11_label_points": _with(f"SELECT i, j, round((x0 + x1) / 2 - (y1 - y0) / s * 0.1, 6) + 0.0::DOUBLE AS x, round((y0 + y1) / 2 + (x1 - x0) / s * 0.1, 6) + 0.0::DOUBLE AS y FROM (SELECT *, greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 1e-9) AS s FROM (SELECT i, j, cos(i * {2 * 3.141592653589793 / 34}) AS x0, sin(i * {2 * 3.141592653589793 / 34}) AS y0, cos(j * {2 * 3.141592653589793 / 34}) AS x1, sin(j * {2 * 3.141592653589793 / 34}) AS y1 FROM (SELECT DISTINCT i, j FROM t)))"),
    "met_20_d_separation": _with(f"SELECT result_id, x, y, z FROM asked WHERE q NOT IN (SELECT q FROM seen JOIN asked USING (q) WHERE node = y)", more=f"{_LINKED}, asked AS MATERIALIZED (SELECT *, row_number() OVER () AS q, -1 AS cut FROM (SELECT a.result_id, a.node AS x, b.node AS y, c.node AS z FROM linked a JOIN linked b ON a.result_id = b.result_id AND a.node < b.node JOIN linked c ON c.result_id = a.result_id AND c.node NOT IN (a.node, b.node))), given AS MATERIALIZED (SELECT q, z FROM asked), {_SEPARATION}"),
    "met_22_intervention_distance": _distance_sql(False),
    "met_22_intervention_distance_compound": _distance_sql(True),
    "snk_12_console": "SELECT " + " || ' ' || ".join(
        f"rpad({c}, CAST(greatest(length({c}), {w}) AS INT), ' ')" if k is None else f"lpad(coalesce(printf('%.{k}f', CAST({c} AS DOUBLE)), '—'), greatest(length(coalesce(printf('%.{k}f', CAST({c} AS DOUBLE)), '—')), {w})::INT, ' ')" for c, w, k in CONSOLE
    ) + f" AS line FROM ({_macro_sql(False)}) JOIN ({_macro_distance_sql()}) USING (model)",
    "agg_9_macro_distance": _macro_distance_sql(),
}
