"""Queries on sources and sinks, and their SQL twins (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators import grading as G
from causeway.plans import graph_queries as Q
from causeway.plans.report_queries import strip
from causeway.sources import files, read_table, sinks
from causeway.sources.scratch import scratch

RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("excerpt_id", "model", "firm", "status", "raw_output")])


def _lines(s, d):
    rows = read_table(s, d, "run_records").where("record_json IS NOT NULL")
    return rows.select(F.col("file_name").alias("file"), F.col("line_no").alias("lineno"), F.col("record_json").alias("line"))


def _answers(s, d):
    """The answers as lines of one log a model: every line is decodable, as the strict readers demand."""
    rows = read_table(s, d, "pair_results")
    return rows.select(G.model_key().alias("file"), F.col("row_id").alias("lineno"), F.to_json(F.struct("excerpt_id", "model", "firm", "status", "raw_output")).alias("line"))


def _tiers(s, d):
    """Excerpts and graphs written as the lines of two tiers and read again."""
    base = scratch(s, "tiers")
    read_table(s, d, "excerpts").select(F.to_json(F.struct("excerpt_id", "lang")).alias("line")).write.text(f"{base}/bank")
    read_table(s, d, "dag_results").select(F.to_json(F.struct("excerpt_id", "model")).alias("line")).write.text(f"{base}/unused")
    lines = files.read_tiers(s, {"Bank": f"{base}/bank", "Unused": f"{base}/unused"})
    return lines.groupBy("tier", "line").agg(F.count(F.lit(1)).alias("n_rows"))


CONCEPT = T.StructType([T.StructField("concept_id", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("code", T.StringType())])


def _array(s, d):
    """The concept list written as one JSON array and read again."""
    path = scratch(s, "array")
    rows = read_table(s, d, "concepts").select("concept_id", "label", "code")
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return files.read_array(s, path, CONCEPT)


def _csv(s, df, name):
    path = scratch(s, name)
    sinks.write_csv(df, path)
    return path


def _edge_text(s, d):
    """The edge summary written as CSV and read again as text."""
    rows = Q._edge_summary(s, d).select(F.col("i").alias("Cause"), F.col("j").alias("Effect"), F.col("n_ground_truth").alias("Ground truth"))
    read = files.read_edge_summary(s, _csv(s, rows, "summary"))
    return read.select(F.col("Cause").alias("cause"), F.col("Effect").alias("effect"), F.col("Ground truth").alias("ground_truth"))


def _union_columns(s, d):
    """Records with differing fields as one CSV with all columns, read again."""
    rows = read_table(s, d, "excerpts").select("excerpt_id", "firm").unionByName(read_table(s, d, "dag_results").select("excerpt_id", "model"), allowMissingColumns=True)
    return s.read.option("header", True).csv(_csv(s, rows, "union"))


def _appended(s, d):
    """Records of two runs appended to one log; then the excerpts that a third run has still to do."""
    path = scratch(s, "log")
    for part in ("error IS NULL", "error IS NOT NULL"):
        sinks.append_log(read_table(s, d, "dag_results").where(part).select("excerpt_id", "model", "status"), path)
    done = files.completed_ids(files.read_lines(s, path))
    return G.not_completed(read_table(s, d, "excerpts").select("excerpt_id"), done, ["excerpt_id"])


def _names(s, d):
    rows = read_table(s, d, "concepts").select(F.lit("concepts").alias("file"), F.col("concept_id").alias("lineno"), F.concat(F.lit("  "), "label").alias("line"))
    return files.ordered_names(rows, 34)


def _ids(s, d):
    return files.id_list(read_table(s, d, "pair_results").where("status = 'malformed' AND excerpt_id IS NOT NULL").select(F.col("excerpt_id").alias("line")))


def _matrix(s, d):
    """The matrix of all true edges written as CSV and read again."""
    return files.read_matrix(s, _csv(s, Q._matrix(s, d).drop("idx"), "matrix"))


def _blocks(s, d):
    truth, _, n = Q._edges(s, d)
    return sinks.stacked_blocks(Q._graphs(s, d).select(Q.KEY, "excerpt_id", "firm", "status"), truth, Q.KEY, n)


def _confusion(s, d):
    return Q.metrics(s, d).select(Q.KEY, "tp", "fp", "fn", "tn").unpivot([Q.KEY], ["tp", "fp", "fn", "tn"], "cell", "n")


QUERIES = {
    "src_1_pages": lambda s, d: files.page_rows(read_table(s, d, "page_text")).select("page_row_id", "page", "text"),
    "src_2_ocr_route": lambda s, d: files.page_rows(read_table(s, d, "page_text")).select("page_row_id", "route"),
    "src_3_tolerant": lambda s, d: files.scan_tolerant(_lines(s, d), RESULT, "raw_output", 20).select("file", "lineno", "excerpt_id", "raw_output"),
    "src_4_tiers": _tiers,
    "src_5_keyed": lambda s, d: files.scan_keyed(_answers(s, d), RESULT, ["file", "excerpt_id"]).select("file", "lineno", "excerpt_id", "status"),
    "src_6_strict": lambda s, d: files.scan_strict(_answers(s, d), RESULT).select("file", "lineno", "excerpt_id", "model", "status"),
    "src_7_array": _array,
    "src_8_names": _names,
    "src_9_ids": _ids,
    "src_10_matrix": _matrix,
    "src_11_edge_summary": _edge_text,
    "src_12_completed": lambda s, d: files.completed_ids(_lines(s, d)),
    "snk_1_jsonl": lambda s, d: sinks.json_line(read_table(s, d, "concepts").select("concept_id", "label", "code")),
    "snk_2_union_columns": _union_columns,
    "snk_4_blocks": _blocks,
    "snk_7_metric_text": lambda s, d: sinks.metric_text(Q.metrics(s, d).select(Q.KEY, "tp", "adj_f1", "mcc", "fdr"), [Q.KEY]),
    "snk_9_confusion": _confusion,
    "snk_9_instances": lambda s, d: sinks.metric_text(G.instance_accuracy(read_table(s, d, "pair_results")), ["model"]),
    "snk_10_ranked_json": lambda s, d: sinks.json_line(G.edge_frequency(Q._edges(s, d)[1], ["i", "j"], Q.KEY).orderBy(F.desc("n_graphs"), "i", "j")),
    "snk_11_resume": _appended,
}

_OBJECT = "json_valid(record_json) AND json_type(CASE WHEN json_valid(record_json) THEN record_json ELSE '0' END) = 'OBJECT'"
_GOOD = f"SELECT file_name AS file, line_no AS lineno, CAST(record_json AS JSON) AS j FROM run_records WHERE {_OBJECT}"
_MODEL = f"coalesce(lower({strip('model')}), '')"


def _json(*columns: str) -> str:
    """The JSON text of columns, nulls left out."""
    members = ", ".join(f"""'"{c}":' || to_json({c})""" for c in columns)
    return f"'{{' || array_to_string(list_filter([{members}], lambda x: x IS NOT NULL), ',') || '}}'"


SQL = {
    "src_1_pages": "SELECT page_row_id, page, coalesce(text, '') AS text FROM page_text",
    "src_2_ocr_route": f"SELECT page_row_id, CASE WHEN length({strip("coalesce(text, '')")}) < 80 THEN 'ocr' ELSE 'text' END AS route FROM page_text",
    "src_3_tolerant": f"SELECT file, lineno, j->>'excerpt_id' AS excerpt_id, j->>'raw_output' AS raw_output FROM ({_GOOD}) WHERE length(j->>'raw_output') >= 20",
    "src_4_tiers": f"SELECT 'Bank' AS tier, {_json('excerpt_id', 'lang')} AS line, count(*) AS n_rows FROM excerpts GROUP BY ALL UNION ALL SELECT 'Unused', {_json('excerpt_id', 'model')}, count(*) FROM dag_results GROUP BY ALL",
    "src_5_keyed": f"SELECT file, lineno, excerpt_id, status FROM (SELECT {_MODEL} AS file, row_id AS lineno, excerpt_id, status, row_number() OVER (PARTITION BY {_MODEL}, excerpt_id ORDER BY row_id DESC) AS k FROM pair_results) WHERE k = 1",
    "src_6_strict": f"SELECT {_MODEL} AS file, row_id AS lineno, excerpt_id, model, status FROM pair_results",
    "src_7_array": "SELECT concept_id, label, code FROM concepts",
    "src_8_names": "SELECT CAST(row_number() OVER (ORDER BY concept_id) - 1 AS INT) AS idx, label FROM concepts",
    "src_9_ids": f"SELECT DISTINCT {strip('excerpt_id')} AS id FROM pair_results WHERE status = 'malformed' AND excerpt_id IS NOT NULL",
    "src_10_matrix": Q._with("SELECT a.node AS cause, 'to_' || j AS effect, count(*) AS n FROM t JOIN (SELECT DISTINCT idx, node FROM v) a ON a.idx = i GROUP BY ALL"),
    "src_11_edge_summary": f"SELECT CAST(i AS VARCHAR) AS cause, CAST(j AS VARCHAR) AS effect, CAST(n_ground_truth AS VARCHAR) AS ground_truth FROM ({Q.SQL['snk_6_edge_summary']})",
    "snk_4_blocks": Q._with("""SELECT result_id, 'excerpt_id: ' || coalesce(excerpt_id, '') || chr(10) || 'firm: ' || coalesce(firm, '') || chr(10) || 'status: ' || coalesce(status, '') || chr(10) ||
      array_to_string(list_transform(range(34), lambda a: array_to_string(list_transform(range(34), lambda b: CASE WHEN list_contains(es, a * 34 + b) THEN '1' ELSE '0' END), ',')), chr(10)) || chr(10) AS block
      FROM (SELECT d.result_id, excerpt_id, firm, status, coalesce(e.es, []) AS es FROM dag_results d LEFT JOIN (SELECT result_id, list(i * 34 + j) AS es FROM t GROUP BY result_id) e USING (result_id))"""),
    "snk_10_ranked_json": Q._with("""SELECT '{"i":' || i || ',"j":' || j || ',"n_graphs":' || count(DISTINCT result_id) || '}' AS record FROM p GROUP BY i, j"""),
    "src_12_completed": f"SELECT DISTINCT j->>'excerpt_id' AS excerpt_id FROM ({_GOOD}) WHERE j->>'excerpt_id' IS NOT NULL",
    "snk_1_jsonl": "SELECT '{\"concept_id\":' || concept_id || ',\"label\":\"' || label || '\",\"code\":\"' || code || '\"}' AS record FROM concepts",
    "snk_2_union_columns": "SELECT excerpt_id, firm, NULL::VARCHAR AS model FROM excerpts UNION ALL SELECT excerpt_id, NULL, model FROM dag_results",
    "snk_7_metric_text": Q._with("SELECT result_id, CAST(tp AS VARCHAR) AS tp, printf('%.4f', adj_f1) AS adj_f1, printf('%.4f', mcc) AS mcc, printf('%.4f', fdr) AS fdr FROM m", more=Q._metric_ctes(False)),
    "snk_9_confusion": Q._with("SELECT result_id, cell, n FROM (SELECT result_id, tp, fp, fn, tn FROM m) UNPIVOT (n FOR cell IN (tp, fp, fn, tn))", more=Q._metric_ctes(False)),
    "snk_9_instances": f"SELECT {_MODEL} AS model, CAST(count(*) FILTER (WHERE correct) AS VARCHAR) AS n_correct, CAST(count(*) AS VARCHAR) AS n_total, printf('%.4f', count(*) FILTER (WHERE correct) / count(*)) AS accuracy FROM pair_results GROUP BY 1",
    "snk_11_resume": "SELECT excerpt_id FROM excerpts WHERE excerpt_id NOT IN (SELECT excerpt_id FROM dag_results WHERE excerpt_id IS NOT NULL)",
}
