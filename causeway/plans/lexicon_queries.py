"""Queries of the lexicon scan and their SQL twins (stage B: LEX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import lexicon as L
from causeway.plans.report_queries import SPACE, q, strip
from causeway.sources import read_table

#: Concepts and markers in the words of the test tables.
CONCEPTS = {
    "CG": (r"governance charter", r"supervisory board", r"remuneration panel"),
    "ER": (r"\bCO2 register\b", r"materiality assessment", r"disclosure of climate"),
    "GHG": (r"scope 1", r"low-carbon", r"lower emissions"),
    "MBV": (r"value of the company", r"share price", r"better ratings"),
}
MARKERS = (r"\bled to\b", r"\bbecause\b", r"\bthereby\b", r"\bas a result\b", r"\bso that\b", r"\bcontributed to\b", r"\benabling\b", r"\bsupport(?:s|ed|ing)?\b")


def _rows(spark, sf):
    """All paragraphs; one without report is a file of its own."""
    line = (F.col("page") * 1000 + F.col("para_pos")).alias("lineno")
    file = F.coalesce("report_id", F.concat(F.lit("paragraph "), "para_id"))
    return read_table(spark, sf, "paragraph_text").select(file.alias("file"), line, "page", "section", "subsection", "text")


def _scan(spark, sf):
    return L.scan(_rows(spark, sf), CONCEPTS, MARKERS, head_of="MBV")


def _details(spark, sf):
    """Window details as texts, for comparison with other engines."""
    rows = L.window_details(_windows(spark, sf), L.scan(_rows(spark, sf), CONCEPTS, MARKERS, with_text=True), CONCEPTS)
    per_row = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, "|")), "; ").alias(c)
    return rows.select(
        "file", "start_line", "n_rows", _joined(F.col("subsection_set")).alias("subsection_set"), per_row("nodes_per_row"), per_row("markers_per_row"),
        F.array_join("texts", "; ").alias("texts"),
    )


def _candidates(spark, sf):
    return L.prefilter(_rows(spark, sf), CONCEPTS, MARKERS)


def _windows(spark, sf):
    return L.smallest_windows(_scan(spark, sf), CONCEPTS)


def _relaxed(spark, sf):
    return L.relaxed(_rows(spark, sf), CONCEPTS, MARKERS)


def _joined(items):
    """Arrays as one text, for comparison with other engines."""
    return F.array_join(items, "|")


WINDOW_COLUMNS = ("file", "start_line", "end_line", "n_rows", "first_page", "last_page", "rows_with_markers")

QUERIES = {
    "lex_1_concepts": lambda s, d: _rows(s, d).select("file", "lineno", _joined(L.concept_names(L.concept_mask(F.col("text"), CONCEPTS), CONCEPTS)).alias("nodes")),
    "lex_1_reference_lexicon": lambda s, d: read_table(s, d, "documents").select("doc_id", _joined(L.concept_names(L.concept_mask(F.coalesce("text", F.lit("")), L.CONCEPTS), L.CONCEPTS)).alias("nodes")),
    "lex_2_distinct_markers": lambda s, d: _rows(s, d).select("file", "lineno", _joined(L.distinct_markers(F.col("text"), MARKERS)).alias("markers")),
    "lex_3_markers": lambda s, d: _rows(s, d).select("file", "lineno", _joined(L.marker_hits(F.col("text"), MARKERS)).alias("markers")),
    "lex_3_reference_markers": lambda s, d: _rows(s, d).select("file", "lineno", _joined(L.marker_hits(F.col("text"), L.MARKERS)).alias("markers")),
    "lex_4_prefilter": lambda s, d: _candidates(s, d).select("file", "lineno", _joined(F.col("nodes")).alias("nodes"), "n_nodes", _joined(F.col("causal_markers")).alias("causal_markers")),
    "lex_5_score": lambda s, d: _candidates(s, d).select("file", "lineno", "score"),
    "lex_6_rank": lambda s, d: L.ranked(_candidates(s, d)).select("file", "lineno", "score"),
    "lex_7_combinations": lambda s, d: L.combinations(_candidates(s, d)).select(_joined(F.col("nodes")).alias("nodes"), "n"),
    "lex_8_smallest_window": lambda s, d: _windows(s, d).select(*WINDOW_COLUMNS),
    "lex_8_one_section": lambda s, d: L.smallest_windows(_scan(s, d), CONCEPTS, one_section=True).select(*WINDOW_COLUMNS),
    "lex_9_window_rank": lambda s, d: L.window_rank(_windows(s, d)).select(*WINDOW_COLUMNS),
    "lex_10_window_detail": _details,
    "lex_11_anchored": lambda s, d: L.anchored(_scan(s, d), CONCEPTS, "MBV").drop("rn").withColumn("nodes", _joined(F.col("nodes"))),
    "lex_12_per_file": lambda s, d: L.per_file(L.anchored(_scan(s, d), CONCEPTS, "MBV")),
    "lex_13_relaxed": lambda s, d: _relaxed(s, d).drop("rn"),
    "lex_14_collapsed": lambda s, d: L.collapse_anchors(_relaxed(s, d)).drop("rn"),
    "lex_15_word_count": lambda s, d: read_table(s, d, "excerpts").select("excerpt_id", L.word_count(F.coalesce("text", F.lit(""))).alias("n_words")),
}


def _alt(patterns) -> str:
    return q("(?i)" + L.alternation(patterns))


def _mask(x: str, lexicon=CONCEPTS) -> str:
    return "(" + " | ".join(f"CASE WHEN regexp_matches({x}, {_alt(p)}) THEN {1 << k} ELSE 0 END" for k, p in enumerate(lexicon.values())) + ")"


def _names(mask: str, lexicon=CONCEPTS) -> str:
    items = ", ".join(f"CASE WHEN {mask} & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(lexicon))
    return f"list_sort(list_filter([{items}], lambda z: z IS NOT NULL))"


def _markers(x: str, markers=MARKERS) -> str:
    return f"regexp_extract_all({x}, {_alt(markers)})"


_ROWS = "SELECT coalesce(report_id, 'paragraph ' || para_id) AS file, page * 1000 + para_pos AS lineno, page, section, subsection, text FROM paragraph_text"
_KEPT = f"SELECT * FROM ({_ROWS}) WHERE length({strip('text')}) >= 40"
_SCAN = f"SELECT *, {_mask('text')} AS mask, {_markers('text')} AS markers, row_number() OVER (PARTITION BY file ORDER BY lineno) AS rn FROM ({_KEPT})"
_CAND = f"""SELECT *, {_names('mask')} AS nodes, CAST(bit_count(mask) AS INT) AS n_nodes, 10 * CAST(bit_count(mask) AS INT) + CASE WHEN mask & 8 <> 0 THEN 5 ELSE 0 END AS score FROM (
    SELECT *, {_mask('text')} AS mask, list_sort(list_distinct({_markers('text')})) AS causal_markers FROM ({_KEPT})) WHERE bit_count(mask) >= 2 AND len(causal_markers) >= 1"""


def _windows_sql(section: bool, start: bool = False) -> str:
    same = "AND n_sections = 1" if section else ""
    return f"""WITH r AS MATERIALIZED ({_SCAN}), p AS (
      SELECT a.file, a.rn AS start, a.lineno AS start_line, b.rn, b.lineno AS end_line, b.mask AS last_mask,
        bit_or(b.mask) OVER w AS u, sum(CASE WHEN len(b.markers) > 0 THEN 1 ELSE 0 END) OVER w AS rows_with_markers,
        min(b.page) OVER w AS first_page, max(b.page) OVER w AS last_page,
        sum(CASE WHEN b.section IS NOT DISTINCT FROM a.section THEN 0 ELSE 1 END) OVER w + 1 AS n_sections
      FROM r a JOIN r b ON a.file = b.file AND b.rn BETWEEN a.rn AND a.rn + 19 WHERE a.mask <> 0
      WINDOW w AS (PARTITION BY a.file, a.rn ORDER BY b.rn)), g AS (
      SELECT *, rn - start + 1 AS n_rows, row_number() OVER (PARTITION BY file, start ORDER BY rn) AS k FROM p
      WHERE rn > start AND u = 15 AND last_mask <> 0 AND rows_with_markers >= 2 AND coalesce(last_page - first_page, 0) <= 6 {same})
    SELECT file, start_line, end_line, CAST(n_rows AS INT) AS n_rows, first_page, last_page, CAST(rows_with_markers AS INT) AS rows_with_markers{', start' if start else ''} FROM g WHERE k = 1"""


_ANCHORED = f"""SELECT file, lineno AS anchor_line, page AS anchor_page, substring(text, 1, 300) AS anchor_text, span_start, span_end, first_page, last_page,
      CAST(total_markers AS BIGINT) AS total_markers, array_to_string({_names('u')}, '|') AS nodes, section FROM (
    SELECT *, bit_or(mask) OVER w AS u, sum(len(markers)) OVER w AS total_markers, min(page) OVER w AS first_page, max(page) OVER w AS last_page,
      min(lineno) OVER w AS span_start, max(lineno) OVER w AS span_end FROM ({_SCAN})
    WINDOW w AS (PARTITION BY file ORDER BY rn ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))
    WHERE mask & 8 <> 0 AND u = 15 AND total_markers >= 2 AND coalesce(last_page - first_page, 0) <= 6"""
_RELAXED = f"""SELECT file, lineno AS anchor_line, rn, coalesce(page_span, 0) AS page_span, CAST(len({_markers('around')}) AS INT) AS marker_count FROM (
    SELECT file, lineno, rn, string_agg(text, ' ') OVER w AS around, max(page) OVER w - min(page) OVER w AS page_span FROM ({_SCAN})
    WINDOW w AS (PARTITION BY file ORDER BY rn ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
    WHERE coalesce(page_span, 0) <= 5 AND {_mask('around')} = 15 AND len({_markers('around')}) >= 4"""

SQL = {
    "lex_1_concepts": f"SELECT file, lineno, array_to_string({_names(_mask('text'))}, '|') AS nodes FROM ({_ROWS})",
    "lex_1_reference_lexicon": f"SELECT doc_id, array_to_string({_names(_mask('t', L.CONCEPTS), L.CONCEPTS)}, '|') AS nodes FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "lex_2_distinct_markers": f"SELECT file, lineno, array_to_string(list_sort(list_distinct({_markers('text')})), '|') AS markers FROM ({_ROWS})",
    "lex_3_markers": f"SELECT file, lineno, array_to_string({_markers('text')}, '|') AS markers FROM ({_ROWS})",
    "lex_3_reference_markers": f"SELECT file, lineno, array_to_string({_markers('text', L.MARKERS)}, '|') AS markers FROM ({_ROWS})",
    "lex_4_prefilter": f"SELECT file, lineno, array_to_string(nodes, '|') AS nodes, n_nodes, array_to_string(causal_markers, '|') AS causal_markers FROM ({_CAND})",
    "lex_5_score": f"SELECT file, lineno, score FROM ({_CAND})",
    "lex_6_rank": f"SELECT file, lineno, score FROM ({_CAND}) ORDER BY score DESC, file, lineno",
    "lex_7_combinations": f"SELECT array_to_string(nodes, '|') AS nodes, count(*) AS n FROM ({_CAND}) GROUP BY 1",
    "lex_8_smallest_window": _windows_sql(False),
    "lex_8_one_section": _windows_sql(True),
    "lex_9_window_rank": _windows_sql(False),
    "lex_10_window_detail": f"""WITH w AS MATERIALIZED ({_windows_sql(False, True)}), r AS MATERIALIZED ({_SCAN})
      SELECT w.file, start_line, n_rows, array_to_string(list_sort(list_filter(list_distinct(list(r.subsection)), lambda x: x IS NOT NULL)), '|') AS subsection_set,
        string_agg(array_to_string({_names('r.mask')}, '|'), '; ' ORDER BY r.rn) AS nodes_per_row, string_agg(array_to_string(r.markers, '|'), '; ' ORDER BY r.rn) AS markers_per_row,
        string_agg(r.text, '; ' ORDER BY r.rn) AS texts
      FROM w JOIN r ON r.file = w.file AND r.rn BETWEEN w.start AND w.start + w.n_rows - 1 GROUP BY w.file, w.start, start_line, n_rows""",
    "lex_11_anchored": _ANCHORED,
    "lex_12_per_file": f"SELECT file, count(*) AS n_hits FROM ({_ANCHORED}) GROUP BY file",
    "lex_13_relaxed": f"SELECT * EXCLUDE (rn) FROM ({_RELAXED})",
    "lex_14_collapsed": f"""SELECT file, arg_max(anchor_line, marker_count * 1000000 - rn) AS anchor_line, max(marker_count) AS marker_count FROM (
        SELECT *, sum(new) OVER (PARTITION BY file ORDER BY rn) AS island FROM (
          SELECT *, CASE WHEN rn - lag(rn) OVER (PARTITION BY file ORDER BY rn) <= 6 THEN 0 ELSE 1 END AS new FROM ({_RELAXED}))) GROUP BY file, island""",
    "lex_15_word_count": f"SELECT excerpt_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda w: w <> '')) AS INT) AS n_words FROM excerpts",
}
