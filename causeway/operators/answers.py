"""Prompts for, and cause-effect edges out of, free-text model answers.

All parsers are column expressions over the answer text; concept names are resolved by joins (broadcast where Spark measures them small) with
the canonical list (a fixed dimension). Null answers are empty text. A line separator is any of the usual ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.patterns import lines, strip

# Markers of reasoning passages, edges and final answers.
THINKING = (
    r"(?is)<think>.*?</think>", r"(?s)<\|think\|>.*?<\|/think\|>", r"(?s)<\|channel\|>thought.*?<\|/channel\|>",
)
EDGE = r"(?Ud)^\s*(.+?)\s*->\s*(.+?)\s*$"
FINAL = r"(?imUd)FINAL:\s*(.+?)$"
FINAL_LINE = r"(?imUd)^\s*FINAL:\s*(.+?)\s*$"
FINAL_VARIANTS = (
    r"(?imUd)FINAL\s*(?:ANSWER)?\s*:\s*(.+?)$", r"(?imUd)CAUSE\s*->\s*EFFECT\s*:\s*(.+?)$", r"(?imUd)^\s*ANSWER\s*:\s*(.+?)$",
)


def mode_of(model: Column, soft: list[str], instruct: list[str]) -> Column:
    """PRS-1: how a model is asked and read."""
    own = F.lower(strip(model))
    return F.when(own.isin(instruct), "instruct").when(own.isin(soft), "soft").otherwise("hard")


def build_prompts(passages: DataFrame, concepts: DataFrame, mode: str = "hard", text: str = "text") -> DataFrame:
    """PRS-2: passages with ``prompt``: task, the concept list, the answer form of the mode, and the passage."""
    listed = concepts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept_id", "label"))), lambda c: F.concat(F.lit("- "), c["label"])), "\n").alias("__list")).scalar()
    form = {
        "hard": "Give one line CAUSE -> EFFECT per relation and nothing else, or NONE if there is none.",
        "soft": "You may reason first. End with one line FINAL: CAUSE -> EFFECT per relation, or FINAL: NONE.",
    }["soft" if mode == "soft" else "hard"]
    tail = "\n\n/no_think" if mode == "instruct" else ""
    prompt = F.concat(
        F.lit("Which of these concepts does the passage say to cause which?\n\n"), listed, F.lit(f"\n\n{form}\n\nPASSAGE:\n"),
        F.coalesce(F.col(text), F.lit("")), F.lit(tail),
    )
    return passages.withColumn("prompt", prompt)


def strip_thinking(text: Column) -> Column:
    """PRS-3: without closed reasoning passages; open ones stay."""
    for pattern in THINKING:
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def answer_text(response: Column, thinking: Column) -> Column:
    """PRS-4: the response, or the reasoning if the response is blank."""
    own = F.coalesce(response, F.lit(""))
    return F.when(strip(own) == "", F.coalesce(thinking, F.lit(""))).otherwise(own)


def answer_lines(text: Column) -> Column:
    """Stripped non-blank lines."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def last_line(text: Column) -> Column:
    """PRS-5: the last non-blank line; null if there is none."""
    return _last(answer_lines(text))


def last_final(text: Column) -> Column:
    """PRS-6: what the last FINAL marker says; null without one."""
    return strip(_last(F.regexp_extract_all(text, F.lit(FINAL), F.lit(1))))


def last_marked(text: Column) -> Column:
    """PRS-7: the last match of the last marker pattern that matches at all."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FINAL_VARIANTS])
    return strip(_last(found))


def strip_punctuation(text: Column) -> Column:
    """PRS-8: without punctuation at the end."""
    return strip(F.regexp_replace(strip(text), r"[.,;:!?]+$", ""))


def is_none(text: Column) -> Column:
    """PRS-9."""
    return F.upper(text) == "NONE"


def split_edge(text: Column) -> Column:
    """PRS-10: struct(cause, effect), split at the first arrow that leaves a cause; null if there is no edge."""
    edge = F.struct(F.regexp_extract(text, EDGE, 1).alias("cause"), F.regexp_extract(text, EDGE, 2).alias("effect"))
    return F.when(text.rlike(EDGE), edge)


def clean_endpoint(text: Column) -> Column:
    """PRS-13: without list marks before and punctuation after."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?Ud)^[*\-•\d.)]+\s*", ""), r"[.,;:]+$", ""))


def parse_single(cleaned: Column, variant: str) -> Column:
    """One edge of a cleaned answer: struct(cause, effect, status).

    ``variant``: ``hard`` (last line), ``soft`` (last FINAL), ``marked`` (last of several markers), ``instruct`` (last line
    without punctuation). The status is ok, none or malformed; names are not resolved yet.
    """
    content = {"hard": last_line, "instruct": last_line, "soft": last_final, "marked": last_marked}[variant](cleaned)
    tidy = strip_punctuation if variant == "instruct" else strip
    edge = split_edge(content)
    none = is_none(strip_punctuation(content) if variant == "instruct" else content)
    status = F.when(content.isNull(), "malformed").when(none, "none").when(edge.isNull(), "malformed").otherwise("ok")
    ok = status == "ok"
    return F.struct(
        F.when(ok, tidy(edge["cause"])).alias("cause"), F.when(ok, tidy(edge["effect"])).alias("effect"), status.alias("status")
    )


def _clean_edges(items: Column) -> Column:
    return F.transform(
        items,
        lambda x: F.struct(
            clean_endpoint(F.regexp_extract(x, EDGE, 1)).alias("cause"), clean_endpoint(F.regexp_extract(x, EDGE, 2)).alias("effect")
        ),
    )


def parse_multi_hard(cleaned: Column) -> Column:
    """PRS-11: struct(edges, status) of the run of edge lines at the end, NONE lines passed over."""
    rows = answer_lines(cleaned)
    other = F.transform(rows, lambda x, i: F.when(~x.rlike(EDGE) & ~is_none(x), i))
    after = F.coalesce(F.array_max(other), F.lit(-1))
    # the last line may be NONE with edges only further up: they count if nothing else lies between
    edges = F.filter(F.transform(rows, lambda x, i: F.when((i > after) & ~is_none(x), x)), lambda x: x.isNotNull())
    any_edge = F.size(F.filter(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: x.rlike(EDGE))) > 0
    none = is_none(_last(rows)) & ~any_edge
    status = F.when(F.size(rows) == 0, "malformed").when(none, "none").when(F.size(edges) == 0, "malformed").otherwise("ok")
    return F.struct(F.when(status == "ok", _clean_edges(edges)).otherwise(F.filter(_clean_edges(edges), lambda _: F.lit(False))).alias("edges"), status.alias("status"))


def parse_multi_soft(cleaned: Column) -> Column:
    """PRS-12: struct(edges, status) of all FINAL lines."""
    finals = F.transform(F.regexp_extract_all(cleaned, F.lit(FINAL_LINE), F.lit(1)), strip)
    edges = F.filter(finals, lambda x: ~is_none(x) & x.rlike(EDGE))
    none = F.size(F.filter(finals, is_none)) > 0
    status = F.when(F.size(edges) > 0, "ok").when(none, "none").otherwise("malformed")
    return F.struct(_clean_edges(edges).alias("edges"), status.alias("status"))


def resolve_pair(parsed: DataFrame, concepts: DataFrame, cause: str = "cause", effect: str = "effect", status: str = "status") -> DataFrame:
    """PRS-14, 15 of a single edge: canonical names if both sides are listed, else as typed and ``not_in_ontology``."""
    named = concepts.where("label IS NOT NULL").groupBy(F.lower("label").alias("__low")).agg(F.max_by("label", "concept_id").alias("__label"))
    side = lambda n: named.select(F.col("__low").alias(f"__low_{n}"), F.col("__label").alias(f"__label_{n}"))
    joined = parsed.join(side("c"), F.lower(cause) == F.col("__low_c"), "left").join(side("e"), F.lower(effect) == F.col("__low_e"), "left")
    both = F.col("__label_c").isNotNull() & F.col("__label_e").isNotNull()
    return (
        joined.withColumn(cause, F.when(both, F.col("__label_c")).otherwise(F.col(cause)))
        .withColumn(effect, F.when(both, F.col("__label_e")).otherwise(F.col(effect)))
        .withColumn(status, F.when((F.col(status) == "ok") & ~both, "not_in_ontology").otherwise(F.col(status)))
        .drop("__low_c", "__label_c", "__low_e", "__label_e")
    )


def resolve_edges(parsed: DataFrame, concepts: DataFrame, key: str) -> DataFrame:
    """PRS-14, 15 of many edges: ``key, pos, cause, effect, edge_status``; the record stays ok however its edges resolve."""
    rows = parsed.select(key, F.posexplode("edges").alias("pos", "e")).select(
        key, "pos", F.col("e.cause").alias("cause"), F.col("e.effect").alias("effect"), F.lit("ok").alias("edge_status")
    )
    return resolve_pair(rows, concepts, status="edge_status")
