"""Queries of the core: name -> callable(spark, directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.operators import nested_records, redelivery, schema_drift
from causeway.plans import answer_queries, graph_queries, io_queries, lexicon_queries, report_queries
from causeway.sources import read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.schema_changes(read_table(spark, sf, "run_records"))


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.consistent_table(read_table(spark, sf, "run_records"))


def p1_path_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.path_statistics(read_table(spark, sf, "run_records"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested_records.children(read_table(spark, sf, "chain_records"))


def _p2_table(kind: str):
    return lambda spark, sf: nested_records.node_table(read_table(spark, sf, "chain_records"), kind)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return redelivery.surplus(read_table(spark, sf, "pair_results"))


def p3_kept(spark: SparkSession, sf: str) -> DataFrame:
    return redelivery.deduplicate(read_table(spark, sf, "pair_results"))


def p3_copies(spark: SparkSession, sf: str) -> DataFrame:
    return redelivery.copies_per_identifier(read_table(spark, sf, "pair_results"))


def p3_kept_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The kept rows without their times, which engines render differently."""
    return p3_kept(spark, sf).drop("produced_at", "delivered_at")


QUERIES = {
    "p1_found": p1_found,
    "p1_table": p1_table,
    "p1_path_statistics": p1_path_statistics,
    "p2_found": p2_found,
    "p2_locations": _p2_table("location"),
    "p2_pages": _p2_table("page"),
    "p2_edges": _p2_table("edge"),
    "p2_evidence": _p2_table("evidence"),
    "p2_forms": _p2_table("form"),
    "p2_nodes": _p2_table("node"),
    "p2_mentions": _p2_table("mention"),
    "p2_markers": _p2_table("marker"),
    "p2_notes": _p2_table("note"),
    "p2_excerpts": _p2_table("excerpt"),
    "p2_fields": lambda spark, sf: nested_records.field_table(read_table(spark, sf, "chain_records")),
    "p2_leaves": lambda spark, sf: nested_records.leaves(read_table(spark, sf, "chain_records")),
    "p3_found": p3_found,
    "p3_kept": p3_kept,
    "p3_kept_answers": p3_kept_answers,
    "p3_copies": p3_copies,
}

_P3_RANKED = """
    SELECT *, CASE WHEN regexp_replace(excerpt_id, '^\\s+|\\s+$', '', 'g') <> '' THEN row_number() OVER (
        PARTITION BY lower(regexp_replace(excerpt_id, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(model, '^\\s+|\\s+$', '', 'g'))
        ORDER BY delivered_at ASC NULLS LAST, row_id) ELSE 1 END AS rn,
        lower(regexp_replace(excerpt_id, '^\\s+|\\s+$', '', 'g')) AS id_e, lower(regexp_replace(model, '^\\s+|\\s+$', '', 'g')) AS id_m
    FROM pair_results"""


def _p2_entries(x: str) -> str:
    """The entries of a part that may stand alone or in a list."""
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN from_json({x}, '[\"JSON\"]') WHEN {x} IS NULL THEN [] ELSE [{x}] END"


def _p2_unnested(source: str, keep: str, x: str) -> str:
    return f"SELECT {keep}, unnest({_p2_entries(x)}) AS x, generate_subscripts({_p2_entries(x)}, 1) AS pos FROM {source}"


def _p2_filled(*members: str) -> str:
    """Whether the entry, or the first of its members that is no null, is a text or number that is not blank."""
    scalar = lambda y: f"(json_type({y}) NOT IN ('ARRAY', 'OBJECT', 'NULL') AND regexp_matches({y} ->> '$', '\\S'))"
    member = "coalesce(" + ", ".join(f"CASE WHEN json_type(x -> '{m}') <> 'NULL' THEN x -> '{m}' END" for m in members) + ")"
    return f"CASE WHEN json_type(x) = 'OBJECT' THEN {scalar(member)} ELSE {scalar('x')} END"


_P2 = f"""WITH decoded AS (SELECT chain_id, CAST(record_json AS JSON) AS j FROM chain_records WHERE json_valid(record_json)),
    r AS (SELECT * FROM (SELECT chain_id, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j -> 0 ELSE j END AS j FROM decoded) WHERE json_type(j) = 'OBJECT'),
    location AS (SELECT * FROM ({_p2_unnested("r", "chain_id", "(j -> 'source_location')")}) WHERE json_type(x) = 'OBJECT'),
    page AS (SELECT * FROM ({_p2_unnested("location", "chain_id, pos AS up", "(x -> 'pages')")}) WHERE {_p2_filled("page")}),
    edge AS (SELECT * FROM ({_p2_unnested("r", "chain_id", "(j -> 'edges_claimed')")}) WHERE json_type(x) = 'OBJECT'),
    evidence AS (SELECT * FROM ({_p2_unnested("edge", "chain_id, pos AS up", "(x -> 'evidence')")}) WHERE {_p2_filled("quote", "text")}),
    forms AS (SELECT chain_id, j -> 'surface_forms' AS f FROM r),
    is_map AS (SELECT *, json_type(f) = 'OBJECT' AND NOT (json_exists(f, '$.node') AND json_exists(f, '$.forms')) AS keyed FROM forms),
    named AS (SELECT chain_id, k AS label, map_extract_value(CAST(f AS MAP(VARCHAR, JSON)), k) AS part FROM (SELECT *, unnest(json_keys(f)) AS k FROM is_map WHERE keyed)
      UNION ALL SELECT chain_id, x ->> 'node', x -> 'forms' FROM ({_p2_unnested("is_map", "chain_id, keyed", "f")}) WHERE NOT keyed AND json_type(x) = 'OBJECT' AND json_type(x -> 'node') = 'VARCHAR'),
    form AS (SELECT * FROM ({_p2_unnested("(SELECT * FROM named WHERE regexp_matches(label, '\\S'))", "chain_id, label", "part")}) WHERE {_p2_filled("form")})"""

def _p1_type(x: str, depth: int = 3) -> str:
    """Raw type of a JSON value; null for nulls and for arrays that tell nothing."""
    if not depth:
        return "NULL"
    inner = _p1_type(f"e{depth}", depth - 1)
    kinds = f"list_sort(list_distinct(list_filter(list_transform(from_json({x}, '[\"JSON\"]'), lambda e{depth}: {inner}), lambda k: k IS NOT NULL)))"
    return f"""CASE json_type({x}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL
        WHEN 'ARRAY' THEN CASE WHEN len({kinds}) > 0 THEN 'array<' || array_to_string({kinds}, '|') || '>' END ELSE 'number' END"""


_P1 = f"""WITH g AS MATERIALIZED (SELECT row_number() OVER () AS rid, series, run_no, j FROM (SELECT series, run_no, CAST(record_json AS JSON) AS j FROM run_records
      WHERE json_valid(record_json) AND series IS NOT NULL AND run_no IS NOT NULL) WHERE json_type(j) = 'OBJECT' AND NOT list_contains(json_keys(j), 'error')),
    tree AS (SELECT rid, id, value, replace(regexp_replace(regexp_replace(fullkey, '\\[\\d+\\]', '', 'g'), '^\\$\\.', ''), '"', '') AS path FROM g, json_tree(g.j)
      WHERE fullkey LIKE '$.%' AND fullkey NOT LIKE '%]' AND NOT contains(fullkey, '][')),
    l AS MATERIALIZED (SELECT rid, path, string_agg(DISTINCT k, '|' ORDER BY k) AS t, string_agg(CAST(value AS VARCHAR), chr(1) ORDER BY id) AS v FROM (SELECT *, {_p1_type('value')} AS k FROM tree) GROUP BY rid, path),
    f AS MATERIALIZED (SELECT series, run_no, path, regexp_replace(path, '\\.?[^.]*$', '') AS parent, count(*) AS n_lines, count(t) AS n_values, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS types
      FROM l JOIN g USING (rid) GROUP BY ALL)"""
_P1_CHANGES = f"""{_P1}, runs AS (SELECT series, run_no, lag(run_no) OVER (PARTITION BY series ORDER BY run_no) AS prev FROM (SELECT DISTINCT series, run_no FROM run_records WHERE series IS NOT NULL AND run_no IS NOT NULL)),
    old AS (SELECT r.series, r.run_no, r.prev, path, parent, types FROM runs r JOIN f ON f.series = r.series AND f.run_no = r.prev),
    new AS (SELECT r.series, r.run_no, path, parent, types FROM runs r JOIN f ON f.series = r.series AND f.run_no = r.run_no WHERE r.prev IS NOT NULL),
    gone AS MATERIALIZED (SELECT * FROM old ANTI JOIN new USING (series, run_no, path)), came AS MATERIALIZED (SELECT * FROM new ANTI JOIN old USING (series, run_no, path)),
    ev AS MATERIALIZED (SELECT series, run_no, path, j ->> 'excerpt_id' AS excerpt, list_sort(list(DISTINCT v)) AS vs FROM l JOIN g USING (rid)
      WHERE t IS NOT NULL AND json_type(j -> 'excerpt_id') = 'VARCHAR' GROUP BY ALL),
    agreed AS (SELECT o.series, o.run_no, o.path AS field_path, n.path AS new_path, count(*) AS same FROM gone o JOIN came n ON n.series = o.series AND n.run_no = o.run_no AND n.parent = o.parent AND n.types = o.types
      JOIN ev a ON a.series = o.series AND a.run_no = o.prev AND a.path = o.path JOIN ev b ON b.series = o.series AND b.run_no = o.run_no AND b.path = n.path AND b.excerpt = a.excerpt
      WHERE o.types <> '' GROUP BY ALL HAVING bool_and(a.vs = b.vs)),
    renamed AS MATERIALIZED (SELECT * FROM agreed QUALIFY row_number() OVER (PARTITION BY series, run_no, field_path ORDER BY same DESC, field_path, new_path) = 1
      AND row_number() OVER (PARTITION BY series, run_no, new_path ORDER BY same DESC, field_path, new_path) = 1),
    changes AS MATERIALIZED (SELECT series, run_no, field_path, 'renamed' AS change_kind, new_path FROM renamed
      UNION ALL SELECT series, run_no, path, 'removed', path FROM gone WHERE (series, run_no, path) NOT IN (SELECT series, run_no, field_path FROM renamed)
      UNION ALL SELECT series, run_no, path, 'added', path FROM came WHERE (series, run_no, path) NOT IN (SELECT series, run_no, new_path FROM renamed)
      UNION ALL SELECT o.series, o.run_no, o.path, 'retyped', o.path FROM old o JOIN new n USING (series, run_no, path) WHERE o.types <> '' AND n.types <> '' AND o.types <> n.types),
    reported AS (SELECT series, run_no, field_path AS p FROM changes UNION SELECT series, run_no, new_path FROM changes)
    SELECT * FROM changes c WHERE NOT EXISTS (SELECT 1 FROM reported r WHERE r.series = c.series AND r.run_no = c.run_no AND starts_with(c.field_path, r.p || '.'))"""


SQL = {
    "p1_found": _P1_CHANGES,
    "p1_path_statistics": f"{_P1} SELECT series, run_no, path, parent, n_lines, n_values, types FROM f",
    "p2_found": f"""{_P2} SELECT DISTINCT chain_id, child, parent, CAST(pos AS INT) AS pos FROM (
        SELECT chain_id, 'location' AS child, '' AS parent, pos FROM location UNION ALL SELECT chain_id, 'page', CAST(up AS VARCHAR), pos FROM page
        UNION ALL SELECT chain_id, 'edge', '', pos FROM edge UNION ALL SELECT chain_id, 'evidence', CAST(up AS VARCHAR), pos FROM evidence
        UNION ALL SELECT chain_id, 'form', label, pos FROM form)""",
    "p2_leaves": f"""{_P2} SELECT chain_id, replace(regexp_replace(regexp_replace(fullkey, '\\[\\d+\\]', '', 'g'), '^\\$\\.?', ''), '"', '') AS path,
        CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type, CASE WHEN type <> 'NULL' THEN value ->> '$' END AS value
        FROM r, json_tree(r.j) WHERE type NOT IN ('OBJECT', 'ARRAY')""",
    "p3_found": f"SELECT row_id FROM ({_P3_RANKED}) WHERE rn > 1",
    "p3_kept_answers": f"SELECT * EXCLUDE (rn, id_e, id_m, produced_at, delivered_at) FROM ({_P3_RANKED}) WHERE rn = 1",
    "p3_copies": f"SELECT deliveries, count(*) AS identifiers FROM (SELECT id_e, id_m, count(*) AS deliveries FROM ({_P3_RANKED}) WHERE id_e <> '' GROUP BY id_e, id_m) GROUP BY deliveries",
}

for _module in (report_queries, lexicon_queries, answer_queries, graph_queries, io_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
