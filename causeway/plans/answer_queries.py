"""Queries on model answers and runs, and their SQL twins (stage C and tables of D: PRS, RUN, GRD, MRG, AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import answers as A
from causeway.operators import grading as G
from causeway.plans.report_queries import SPACE, q, strip
from causeway.sources import read_table

#: The models of the test tables by the way they are asked.
SOFT = ["quill1.4:7b", "opal-r2:12b", "tarn2:e6b"]
INSTRUCT = ["quill1.4:7b-instruct"]
#: Two concepts read as one in the compound view.
MEMBERS, COMPOUND = ["Equity Valuation", "Share Quotation"], "Market Value"


def _pairs(s, d):
    return read_table(s, d, "pair_results")


def _answers(s, d, table="pair_results", key="row_id"):
    rows = read_table(s, d, table)
    raw = F.coalesce("raw_response", "raw_output") if "raw_output" in rows.columns else F.col("raw_response")
    text = A.strip_thinking(A.answer_text(raw, F.col("raw_thinking")))
    return rows.select(key, A.mode_of(F.col("model"), SOFT, INSTRUCT).alias("mode"), text.alias("cleaned"))


def _single(variant):
    return lambda s, d: _answers(s, d).select("row_id", A.parse_single(F.col("cleaned"), variant).alias("p")).select("row_id", "p.*")


def _multi(parse):
    def run(s, d):
        rows = _answers(s, d, "dag_results", "result_id").select("result_id", parse(F.col("cleaned")).alias("p"))
        return rows.select("result_id", F.array_join(F.transform("p.edges", lambda e: F.concat_ws("|", e["cause"], e["effect"])), "\n").alias("edges"), "p.status")

    return run


def _by_mode(s, d):
    """Every record read the way its model was asked, names resolved."""
    rows = _answers(s, d)
    text = F.col("cleaned")
    read = F.when(F.col("mode") == "soft", A.parse_single(text, "soft")).when(F.col("mode") == "instruct", A.parse_single(text, "instruct")).otherwise(A.parse_single(text, "hard"))
    return A.resolve_pair(rows.select("row_id", read.alias("p")).select("row_id", "p.*"), read_table(s, d, "concepts"))


def _multi_resolved(s, d):
    rows = _answers(s, d, "dag_results", "result_id")
    read = F.when(F.col("mode") == "soft", A.parse_multi_soft(F.col("cleaned"))).otherwise(A.parse_multi_hard(F.col("cleaned")))
    return A.resolve_edges(rows.select("result_id", read.alias("p")).select("result_id", "p.*"), read_table(s, d, "concepts"), "result_id")


def _record_status(s, d):
    rows = _answers(s, d, "dag_results", "result_id")
    read = F.when(F.col("mode") == "soft", A.parse_multi_soft(F.col("cleaned"))).otherwise(A.parse_multi_hard(F.col("cleaned")))
    return rows.select("result_id", read["status"].alias("status"), F.size(read["edges"]).alias("n_edges"))


def _grd_1(s, d):
    parsed = _by_mode(s, d)
    truth = _pairs(s, d).select("row_id", "ground_truth_cause", "ground_truth_effect")
    right = G.pair_correct(F.col("cause"), F.col("effect"), F.col("ground_truth_cause"), F.col("ground_truth_effect"), F.col("status"))
    return parsed.join(truth, "row_id").select("row_id", right.alias("is_correct"))


def _grd_2(s, d):
    truth = G.pairs_to_edges(F.col("ground_truth_edges"))
    return read_table(s, d, "dag_results").select("result_id", G.edges_match(F.col("predicted_edges"), truth, MEMBERS, COMPOUND).alias("is_match"))


def _rerun(s, d):
    """The later delivery of each answer plays the rerun."""
    rows = _pairs(s, d).where("excerpt_id IS NOT NULL").select("row_id", "excerpt_id", "model", "status", "correct")
    first, last = (rows.groupBy("excerpt_id", "model").agg(f(F.struct("row_id", "status", "correct"), "row_id").alias("r")).select("excerpt_id", "model", "r.*") for f in (F.min_by, F.max_by))
    return first, last


def _mrg_1(s, d):
    first, last = _rerun(s, d)
    return G.supersede(first, last, ["excerpt_id", "model"])


def _run_3(s, d):
    """What each model has still to do: error records count as done, as a log of records has them."""
    rows = _pairs(s, d).withColumn("model", G.model_key())
    models = rows.agg(F.collect_set("model")).scalar()
    wanted = read_table(s, d, "excerpts").select("excerpt_id", F.explode(models).alias("model"))
    return G.not_completed(wanted, rows.where("excerpt_id IS NOT NULL"), ["excerpt_id", "model"])


def _agg_1(s, d):
    rows = read_table(s, d, "dag_results")
    return G.status_counts_on_grid(rows, rows.select(G.model_key().alias("model")).distinct(), read_table(s, d, "excerpts"))


def _labels(s, d):
    return [r[0] for r in read_table(s, d, "concepts").select("label").collect()]


def _pair_edges(s, d):
    rows = _pairs(s, d).where("status = 'ok' AND predicted_cause IS NOT NULL AND predicted_effect IS NOT NULL")
    return rows.select("excerpt_id", G.model_key().alias("model"), F.col("predicted_cause").alias("cause"), F.col("predicted_effect").alias("effect"))


def _agg_8(s, d):
    """The edges of the truth and of all models, with the number of excerpts that have each."""
    truth = _pairs(s, d).where("ground_truth_cause IS NOT NULL AND ground_truth_effect IS NOT NULL").select(
        "excerpt_id", F.lit("ground truth").alias("model"), F.col("ground_truth_cause").alias("cause"), F.col("ground_truth_effect").alias("effect"))
    return truth.unionByName(_pair_edges(s, d)).groupBy("cause", "effect").agg(
        F.count_distinct(F.when(F.col("model") == "ground truth", F.col("excerpt_id"))).alias("n_truth"),
        F.count_distinct(F.when(F.col("model") != "ground truth", F.col("excerpt_id"))).alias("n_predicted"),
    )


def _prompts(mode):
    return lambda s, d: A.build_prompts(read_table(s, d, "excerpts").select("excerpt_id", "text"), read_table(s, d, "concepts"), mode).select("excerpt_id", "prompt")


QUERIES = {
    "prs_1_mode": lambda s, d: _pairs(s, d).select("row_id", A.mode_of(F.col("model"), SOFT, INSTRUCT).alias("mode")),
    "prs_2_prompt_hard": _prompts("hard"),
    "prs_2_prompt_soft": _prompts("soft"),
    "prs_2_prompt_instruct": _prompts("instruct"),
    "prs_3_strip_thinking": lambda s, d: _pairs(s, d).select("row_id", A.strip_thinking(F.coalesce("raw_response", F.lit(""))).alias("text")),
    "prs_4_fallback": lambda s, d: _pairs(s, d).select("row_id", A.answer_text(F.col("raw_response"), F.col("raw_thinking")).alias("text")),
    "prs_5_hard": _single("hard"),
    "prs_6_soft": _single("soft"),
    "prs_7_marked": _single("marked"),
    "prs_8_instruct": _single("instruct"),
    "prs_9_none": lambda s, d: _answers(s, d).select("row_id", F.coalesce(A.is_none(A.last_line(F.col("cleaned"))), F.lit(False)).alias("is_none")),
    "prs_10_edge": lambda s, d: _answers(s, d).select("row_id", A.split_edge(A.last_line(F.col("cleaned"))).alias("e")).select("row_id", "e.cause", "e.effect"),
    "prs_11_multi_hard": _multi(A.parse_multi_hard),
    "prs_12_multi_soft": _multi(A.parse_multi_soft),
    "prs_13_endpoint": lambda s, d: _pairs(s, d).select("row_id", A.clean_endpoint(F.col("predicted_cause")).alias("cause")),
    "prs_14_resolve": _by_mode,
    "prs_14_resolve_edges": _multi_resolved,
    "prs_15_record_status": _record_status,
    "grd_1_pair_correct": _grd_1,
    "grd_2_edge_sets": _grd_2,
    "run_1_limit": lambda s, d: G.first_excerpts(read_table(s, d, "excerpts"), 25).select("excerpt_id", "firm"),
    "run_2_rerun": lambda s, d: G.only_listed(read_table(s, d, "excerpts"), _pairs(s, d).where("status = 'malformed'")).select("excerpt_id", "lang"),
    "run_2_unmatched": lambda s, d: G.unmatched_ids(read_table(s, d, "excerpts"), _pairs(s, d).where("excerpt_id IS NOT NULL")).select("excerpt_id"),
    "run_3_resume": _run_3,
    "run_4_errors": lambda s, d: G.error_records(_pairs(s, d)).select("row_id", "error"),
    "mrg_1_supersede": _mrg_1,
    "mrg_2_count_check": lambda s, d: G.count_check(_pairs(s, d).withColumn("model", G.model_key()), "model", 1000),
    "agg_1_status_grid": _agg_1,
    "agg_2_status_any_error": lambda s, d: G.status_counts(_pairs(s, d), False),
    "agg_3_status_bare_error": lambda s, d: G.status_counts(_pairs(s, d), True),
    "agg_4_accuracy": lambda s, d: G.instance_accuracy(_pairs(s, d)),
    "agg_5_contributing": lambda s, d: G.contributing(_pairs(s, d), _labels(s, d)),
    "agg_6_unique_edges": lambda s, d: _pair_edges(s, d).groupBy("model").agg(F.count_distinct("cause", "effect").alias("n_edges")),
    "agg_7_edge_frequency": lambda s, d: G.edge_frequency(_pair_edges(s, d), ["model", "cause", "effect"], "excerpt_id"),
    "agg_8_edge_universe": _agg_8,
}

# ------------------------------------------------------------------------------------------ SQL


def _model(x="model") -> str:
    return f"coalesce(lower({strip(x)}), '')"


def _thinkless(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<think>.*?</think>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<[|]think[|]>.*?<[|]/think[|]>', '', 'g')"
    return strip(f"regexp_replace({x}, '(?s)<[|]channel[|]>thought.*?<[|]/channel[|]>', '', 'g')")


_FALL = "CASE WHEN {s} = '' THEN coalesce(raw_thinking, '') ELSE coalesce({r}, '') END"


def _fallback(r: str) -> str:
    return _FALL.format(s=strip(f"coalesce({r}, '')"), r=r)


def _answers_sql(table="pair_results", key="row_id", raw="coalesce(raw_response, raw_output)") -> str:
    rows = "list_filter(list_transform(string_split_regex(cleaned, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]'), lambda y: " + strip("y") + "), lambda y: y <> '')"
    return f"SELECT *, {rows} AS rws FROM (SELECT {key}, {_MODE} AS mode, {_thinkless('t')} AS cleaned FROM (SELECT *, {_fallback(raw)} AS t FROM {table}))"


_MODE = f"CASE WHEN lower({strip('model')}) IN ('quill1.4:7b-instruct') THEN 'instruct' WHEN lower({strip('model')}) IN ('quill1.4:7b', 'opal-r2:12b', 'tarn2:e6b') THEN 'soft' ELSE 'hard' END"
_EDGE = f"'^{SPACE}*([^\\n]+?){SPACE}*->{SPACE}*([^\\n]+?){SPACE}*$'"


def _part(x: str, k: int) -> str:
    return f"regexp_extract({x}, {_EDGE}, {k})"


def _punct(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, '[.,;:!?]+$', '')")


_FINALS = {
    "soft": "regexp_extract_all(cleaned, '(?im)FINAL:\\s*([^\\n]+?)$', 1)",
    "marked": "list_concat(list_concat(regexp_extract_all(cleaned, '(?im)FINAL\\s*(?:ANSWER)?\\s*:\\s*([^\\n]+?)$', 1), regexp_extract_all(cleaned, '(?im)CAUSE\\s*->\\s*EFFECT\\s*:\\s*([^\\n]+?)$', 1)), regexp_extract_all(cleaned, '(?im)^\\s*ANSWER\\s*:\\s*([^\\n]+?)$', 1))",
}


def _single_sql(variant: str) -> str:
    content = f"{strip(_FINALS[variant] + '[-1]')}" if variant in _FINALS else "rws[-1]"
    none = f"upper({_punct('c')}) = 'NONE'" if variant == "instruct" else "upper(c) = 'NONE'"
    tidy = _punct if variant == "instruct" else strip
    return f"""SELECT row_id, CASE WHEN status = 'ok' THEN {tidy(_part('c', 1))} END AS cause, CASE WHEN status = 'ok' THEN {tidy(_part('c', 2))} END AS effect, status FROM (
      SELECT row_id, c, CASE WHEN c IS NULL THEN 'malformed' WHEN {none} THEN 'none' WHEN NOT regexp_matches(c, {_EDGE}) THEN 'malformed' ELSE 'ok' END AS status
      FROM (SELECT row_id, mode, {content} AS c FROM ({_answers_sql()})))"""


def _endpoint(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace({x}, '^[*•0-9.)-]+{SPACE}*', ''), '[.,;:]+$', '')")


_DAG = _answers_sql("dag_results", "result_id", "raw_response")
_EDGE_ROWS = f"list_filter(list_transform(rws, lambda y, i: CASE WHEN i > after AND upper(y) <> 'NONE' THEN y END), lambda y: y IS NOT NULL)"
_HARD = f"""SELECT result_id, mode, CASE WHEN len(rws) = 0 THEN 'malformed' WHEN upper(rws[-1]) = 'NONE' AND len(list_filter(rws[1:len(rws) - 1], lambda y: regexp_matches(y, {_EDGE}))) = 0 THEN 'none'
      WHEN len(er) = 0 THEN 'malformed' ELSE 'ok' END AS status, er FROM (SELECT *, {_EDGE_ROWS} AS er FROM (
      SELECT *, coalesce(list_max(list_transform(rws, lambda y, i: CASE WHEN NOT regexp_matches(y, {_EDGE}) AND upper(y) <> 'NONE' THEN i END)), 0) AS after FROM ({_DAG})))"""
_FINAL_ROWS = f"list_transform(regexp_extract_all(cleaned, '(?im)^\\s*FINAL:\\s*([^\\n]+?)\\s*$', 1), lambda y: {strip('y')})"
_SOFT_SQL = f"""SELECT result_id, mode, CASE WHEN len(er) > 0 THEN 'ok' WHEN len(list_filter(f, lambda y: upper(y) = 'NONE')) > 0 THEN 'none' ELSE 'malformed' END AS status, er FROM (
      SELECT *, list_filter(f, lambda y: upper(y) <> 'NONE' AND regexp_matches(y, {_EDGE})) AS er FROM (SELECT *, {_FINAL_ROWS} AS f FROM ({_DAG})))"""


def _multi_sql(source: str) -> str:
    edge = f"{_endpoint(_part('y', 1))} || '|' || {_endpoint(_part('y', 2))}"
    return f"SELECT result_id, CASE WHEN status = 'ok' THEN array_to_string(list_transform(er, lambda y: {edge}), chr(10)) ELSE '' END AS edges, status FROM ({source})"


_BY_MODE_RAW = f"""SELECT row_id, CASE WHEN mode = 'soft' THEN s.cause WHEN mode = 'instruct' THEN i.cause ELSE h.cause END AS cause,
      CASE WHEN mode = 'soft' THEN s.effect WHEN mode = 'instruct' THEN i.effect ELSE h.effect END AS effect,
      CASE WHEN mode = 'soft' THEN s.status WHEN mode = 'instruct' THEN i.status ELSE h.status END AS status
      FROM (SELECT row_id, {_MODE} AS mode FROM pair_results) m JOIN ({_single_sql('soft')}) s USING (row_id) JOIN ({_single_sql('instruct')}) i USING (row_id) JOIN ({_single_sql('hard')}) h USING (row_id)"""


def _resolve(source: str, keys: str, status: str) -> str:
    both = "c.label IS NOT NULL AND e.label IS NOT NULL"
    return f"""SELECT {keys}, CASE WHEN {both} THEN c.label ELSE cause END AS cause, CASE WHEN {both} THEN e.label ELSE effect END AS effect,
      CASE WHEN {status} = 'ok' AND NOT ({both}) THEN 'not_in_ontology' ELSE {status} END AS {status}
      FROM ({source}) p LEFT JOIN concepts c ON lower(p.cause) = lower(c.label) LEFT JOIN concepts e ON lower(p.effect) = lower(e.label)"""


_BY_MODE = _resolve(_BY_MODE_RAW, "row_id", "status")
_MULTI_ALL = f"SELECT result_id, status, er FROM ({_SOFT_SQL}) WHERE mode = 'soft' UNION ALL SELECT result_id, status, er FROM ({_HARD}) WHERE mode <> 'soft'"
_MULTI_EDGES = f"""SELECT result_id, pos, {_endpoint(_part('y', 1))} AS cause, {_endpoint(_part('y', 2))} AS effect, 'ok' AS edge_status FROM (
      SELECT result_id, CAST(generate_subscripts(er, 1) - 1 AS INT) AS pos, unnest(er) AS y FROM ({_MULTI_ALL}) WHERE status = 'ok')"""
_PROMPT_HEAD = "'Which of these concepts does the passage say to cause which?' || chr(10) || chr(10) || (SELECT string_agg('- ' || label, chr(10) ORDER BY concept_id) FROM concepts) || chr(10) || chr(10)"


def _prompt_sql(mode: str) -> str:
    form = {
        "hard": "Give one line CAUSE -> EFFECT per relation and nothing else, or NONE if there is none.",
        "soft": "You may reason first. End with one line FINAL: CAUSE -> EFFECT per relation, or FINAL: NONE.",
    }["soft" if mode == "soft" else "hard"]
    tail = " || chr(10) || chr(10) || '/no_think'" if mode == "instruct" else ""
    return f"SELECT excerpt_id, {_PROMPT_HEAD} || {q(form)} || chr(10) || chr(10) || 'PASSAGE:' || chr(10) || coalesce(text, ''){tail} AS prompt FROM excerpts"


_STATUS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in G.STATUSES)
_PAIR_EDGES = f"SELECT excerpt_id, {_model()} AS model, predicted_cause AS cause, predicted_effect AS effect FROM pair_results WHERE status = 'ok' AND predicted_cause IS NOT NULL AND predicted_effect IS NOT NULL"
_SET = "list_sort(list_distinct(list_transform({e}, lambda x: {c} || chr(1) || {f})))"


def _merged(x: str) -> str:
    return f"coalesce(CASE WHEN lower({x}) IN ('equity valuation', 'share quotation') THEN 'Market Value' ELSE {x} END, '~')"


SQL = {
    "prs_1_mode": f"SELECT row_id, {_MODE} AS mode FROM pair_results",
    "prs_2_prompt_hard": _prompt_sql("hard"),
    "prs_2_prompt_soft": _prompt_sql("soft"),
    "prs_2_prompt_instruct": _prompt_sql("instruct"),
    "prs_3_strip_thinking": f"SELECT row_id, {_thinkless("coalesce(raw_response, '')")} AS text FROM pair_results",
    "prs_4_fallback": f"SELECT row_id, {_fallback('raw_response')} AS text FROM pair_results",
    "prs_5_hard": _single_sql("hard"),
    "prs_6_soft": _single_sql("soft"),
    "prs_7_marked": _single_sql("marked"),
    "prs_8_instruct": _single_sql("instruct"),
    "prs_9_none": f"SELECT row_id, coalesce(upper(rws[-1]) = 'NONE', false) AS is_none FROM ({_answers_sql()})",
    "prs_10_edge": f"SELECT row_id, CASE WHEN regexp_matches(rws[-1], {_EDGE}) THEN {_part('rws[-1]', 1)} END AS cause, CASE WHEN regexp_matches(rws[-1], {_EDGE}) THEN {_part('rws[-1]', 2)} END AS effect FROM ({_answers_sql()})",
    "prs_11_multi_hard": _multi_sql(_HARD),
    "prs_12_multi_soft": _multi_sql(_SOFT_SQL),
    "prs_13_endpoint": f"SELECT row_id, {_endpoint('predicted_cause')} AS cause FROM pair_results",
    "prs_14_resolve": _BY_MODE,
    "prs_14_resolve_edges": _resolve(_MULTI_EDGES, "result_id, pos", "edge_status"),
    "prs_15_record_status": f"SELECT result_id, status, CAST(CASE WHEN status = 'ok' THEN len(er) ELSE 0 END AS INT) AS n_edges FROM ({_MULTI_ALL})",
    "grd_1_pair_correct": f"SELECT row_id, coalesce(p.status = 'ok' AND cause = ground_truth_cause AND effect = ground_truth_effect, false) AS is_correct FROM ({_BY_MODE}) p JOIN (SELECT row_id, ground_truth_cause, ground_truth_effect FROM pair_results) t USING (row_id)",
    "grd_2_edge_sets": f"SELECT result_id, {_SET.format(e='coalesce(predicted_edges, [])', c=_merged('x.cause'), f=_merged('x.effect'))} = {_SET.format(e='coalesce(ground_truth_edges, [])', c=_merged('x[1]'), f=_merged('x[2]'))} AS is_match FROM dag_results",
    "run_1_limit": "SELECT excerpt_id, firm FROM excerpts ORDER BY excerpt_id LIMIT 25",
    "run_2_rerun": "SELECT excerpt_id, lang FROM excerpts WHERE excerpt_id IN (SELECT excerpt_id FROM pair_results WHERE status = 'malformed')",
    "run_2_unmatched": "SELECT DISTINCT excerpt_id FROM pair_results WHERE excerpt_id IS NOT NULL AND excerpt_id NOT IN (SELECT excerpt_id FROM excerpts)",
    "run_3_resume": f"""SELECT excerpt_id, model FROM (SELECT DISTINCT {_model()} AS model FROM pair_results) CROSS JOIN excerpts
      WHERE (excerpt_id, model) NOT IN (SELECT excerpt_id, {_model()} FROM pair_results WHERE excerpt_id IS NOT NULL)""",
    "run_4_errors": "SELECT row_id, error FROM pair_results WHERE error IS NOT NULL AND status IS NULL",
    "mrg_1_supersede": """WITH g AS (SELECT excerpt_id, model, max(row_id) AS hi FROM pair_results WHERE excerpt_id IS NOT NULL GROUP BY ALL),
      k AS (SELECT excerpt_id, model, hi AS row_id FROM g)
      SELECT k.excerpt_id, k.model, row_id, status, correct FROM k JOIN pair_results p USING (row_id)""",
    "mrg_2_count_check": f"SELECT {_model()} AS model, count(*) AS n FROM pair_results GROUP BY 1 HAVING count(*) <> 1000",
    "agg_1_status_grid": f"""WITH r AS (SELECT {_model()} AS m, excerpt_id, coalesce(status, CASE WHEN error IS NOT NULL THEN 'error' ELSE 'unknown' END) AS s, excerpt_id IN (SELECT excerpt_id FROM excerpts) AS known FROM dag_results)
      SELECT m AS model, {', '.join(f"count(*) FILTER (WHERE known AND s = '{s}') AS n_{s}" for s in (*G.STATUSES, 'error', 'unknown'))},
      (SELECT count(DISTINCT excerpt_id) FROM excerpts) - count(DISTINCT excerpt_id) FILTER (WHERE known) AS n_missing FROM r GROUP BY m""",
    "agg_2_status_any_error": f"SELECT {_model()} AS model, count(*) AS n_records, {_STATUS}, count(*) FILTER (WHERE error IS NOT NULL) AS n_error FROM pair_results GROUP BY 1",
    "agg_3_status_bare_error": f"SELECT {_model()} AS model, count(*) AS n_records, {_STATUS}, count(*) FILTER (WHERE error IS NOT NULL AND status IS NULL) AS n_error FROM pair_results GROUP BY 1",
    "agg_4_accuracy": f"SELECT {_model()} AS model, count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n_total, count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM pair_results GROUP BY 1",
    "agg_5_contributing": f"SELECT {_model()} AS model, count(*) FILTER (WHERE status = 'ok' AND predicted_cause IN (SELECT label FROM concepts) AND predicted_effect IN (SELECT label FROM concepts)) AS n_contributing FROM pair_results GROUP BY 1",
    "agg_6_unique_edges": f"SELECT model, count(DISTINCT (cause, effect)) AS n_edges FROM ({_PAIR_EDGES}) GROUP BY model",
    "agg_7_edge_frequency": f"SELECT model, cause, effect, count(DISTINCT excerpt_id) AS n_graphs FROM ({_PAIR_EDGES}) GROUP BY ALL",
    "agg_8_edge_universe": f"""SELECT cause, effect, count(DISTINCT excerpt_id) FILTER (WHERE model = 'ground truth') AS n_truth, count(DISTINCT excerpt_id) FILTER (WHERE model <> 'ground truth') AS n_predicted FROM (
      SELECT excerpt_id, 'ground truth' AS model, ground_truth_cause AS cause, ground_truth_effect AS effect FROM pair_results WHERE ground_truth_cause IS NOT NULL AND ground_truth_effect IS NOT NULL UNION ALL {_PAIR_EDGES}) GROUP BY ALL""",
}
