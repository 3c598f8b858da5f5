"""Text values that were cut off, and how often each source cuts.

(1) Per source, the lengths of the values are counted in characters and in bytes; a field limit shows as a spike: far
more values of exactly one length than at the lengths around it, and more than at all greater lengths together. A
value at a spike length was cut by the limit unless it ends in terminal punctuation or with a block that is whole: an
edge or list entry that names a listed value, or a manner of closing.

(2) Values cut in transfer end at any length, and no histogram can show them. They are judged by a model of terminal
contexts, fitted on the endings of the values away from spikes: forms without terminal punctuation that make up a
set share of all such endings are manners of closing (a closing line, a closed fence, the key of the last list
entry, an ellipsis after the same words). What ends otherwise was cut, but for an edge whose right side
is not on the list: away from spikes that is a value typed freely.

The spikes thus decide twice: over the values at a limit, and over which endings the model may learn from, for texts of one
pattern that a limit cuts all end alike and would look like a manner of closing.

Scale: everything is column expressions, in two scans. The first counts endings by source, length and
form (hashed, combined map-side) and is written once; spikes, of which a source can have only about log2 of its rows (each
outweighs all greater lengths), and closings, at most 1 / share of them, come from that table and are
broadcast. The values themselves are never shuffled.

Defined results: null and blank values are no cases; sources are compared without letter case and
surrounding white space, the null source is one of its own; trailing white space is ignored; repeated rows are
each judged; very long values are read whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.patterns import SPACES, strip
from causeway.sources.checkpoints import cut_lineage

#: Lengths on either side that a spike is compared with.
NEIGHBOURS = 40
#: A spike has at least so many values, and so many times those of a usual length around it.
SPIKE_LEAST, SPIKE_TIMES = 5, 8
#: Share of all endings on an ellipsis, and of all others without punctuation, from which a form is a manner of closing.
CLOSING_SHARES = {"ellipsis": 0.05, "line": 0.01}
#: A manner of closing is seen at least so often.
CLOSING_LEAST = 3

#: Abbreviations that are always continued.
CONTINUED = (
    "fig", "figs", "i.e", "e.g", "p", "pp", "approx", "vs", "incl", "excl", "cf", "ca", "resp", "viz", "esp", "para", "vol", "sec",
    "z.b", "d.h", "bzw", "inkl", "vgl", "abb", "nr", "s.o", "u.a", "p.ex", "env", "p.ej", "aprox", "núm",
)

TERMINAL = r"""[.!?。！？…]["”’')\]»*_`]*\s*[\p{So}️‍]*$"""
MARKUP = " *_`<>[](){}\"'“”.,;!?"


def trimmed(value: Column) -> Column:
    return F.rtrim(value, F.lit(SPACES))


def source_key(source: str) -> Column:
    return F.coalesce(F.lower(strip(F.col(source))), F.lit(""))


def beginnings(entries: Sequence[str]) -> list[str]:
    """What is left of an entry that lacks two letters or more, in lower case; entries themselves are none."""
    whole = {e.lower() for e in entries}
    return sorted({e[:k].strip().lower() for e in entries for k in range(1, len(e) - 1)} - whole - {""})


def with_ending(df: DataFrame, text: str, entries: Sequence[str]) -> DataFrame:
    """``df`` with ``__sort`` and ``__form`` of the end of the right-trimmed column ``text``.

    Sorts: ``whole`` (terminal punctuation, or an edge with an entry behind its arrow), ``edge`` (something else behind it), ``broken`` (an open
    fence, a right side that is empty or a begun entry, a list entry without its value, an abbreviation that is always
    continued), ``ellipsis`` (the form is the two words before it), ``line`` (any other last line, which is the form; of a list entry with
    its value, the key).
    """
    listed = [e.lower() for e in entries]
    last = F.trim(F.substring_index(F.col(text), "\n", -1))
    df = df.withColumn("__last", F.replace(F.lower(last), F.lit("→"), F.lit("->")))
    line = F.col("__last")
    fences = (F.length(text) - F.length(F.replace(F.col(text), F.lit("```"), F.lit("")))) / 3
    right = F.trim(F.substring_index(line, "->", -1))
    bare = F.btrim(right, F.lit(MARKUP))
    begun = right.isin(beginnings(entries)) if entries else F.lit(False)
    edge = F.when((bare == "") | begun, "broken").when(bare.isin(listed) if entries else bare != "", "whole").otherwise("edge")
    value = F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
    full = value.isin(listed) if entries else value != ""
    last_word = F.ltrim(F.substring_index(line, " ", -1), F.lit("(["))
    item, ellipsis = line.rlike(r"^[-*•]\s*\w+\s*:"), line.endswith("...") | line.endswith("…")
    sort = (
        F.when(fences % 2 != 0, "broken")
        .when(line.contains("->"), edge)
        .when(item, F.when(full, "line").otherwise("broken"))
        .when(ellipsis, "ellipsis")
        .when(line.rlike(TERMINAL), F.when(last_word.isin([f"{a}." for a in CONTINUED]), "broken").otherwise("whole"))
        .otherwise("line")
    )
    df = df.withColumn("__sort", sort)
    form = F.when(F.col("__sort") == "ellipsis", F.regexp_extract(line, r"(\S*\s*\S*?)(?:\.{3,}|…)$", 1)).when(
        F.col("__sort") == "line", F.when(item, F.substring_index(line, ":", 1)).otherwise(line)
    )
    return df.withColumn("__form", F.when(form.isNotNull(), F.xxhash64(form))).drop("__last")


def count_endings(rows: DataFrame) -> DataFrame:
    """Values by source, length in both units and form of their ending."""
    return rows.groupBy("source_key", "__characters", "__bytes", "__sort", "__form").agg(F.count(F.lit(1)).alias("n"))


def spikes_of(counted: DataFrame) -> DataFrame:
    """``source_key, unit, length, n, n_longer, usual`` of each spike of the length histograms."""
    units = F.array(
        F.struct(F.lit("characters").alias("unit"), F.col("__characters").alias("length")),
        F.struct(F.lit("bytes").alias("unit"), F.col("__bytes").alias("length")),
    )
    lengths = counted.select("source_key", F.inline(units), "n").groupBy("source_key", "unit", "length").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("source_key", "unit").orderBy("length")
    near = F.sum("n").over(by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)) - F.col("n")
    longer = F.coalesce(F.sum("n").over(by.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    return (
        lengths.withColumn("usual", near / (2 * NEIGHBOURS)).withColumn("n_longer", longer)
        .where((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * F.col("usual")) & (F.col("n") > F.col("n_longer")))
    )


def at_limit(rows: DataFrame, spikes: DataFrame) -> DataFrame:
    """``rows`` with ``__limit``: whether the length of a value is at a spike of its source, in either unit."""
    for unit in ("characters", "bytes"):
        own = spikes.where(F.col("unit") == unit).select("source_key", F.col("length").alias(f"__{unit}"), F.lit(True).alias(f"__at_{unit}"))
        rows = rows.join(F.broadcast(own), ["source_key", f"__{unit}"], "left")
    either = F.col("__at_characters").isNotNull() | F.col("__at_bytes").isNotNull()
    return rows.withColumn("__limit", either).drop("__at_characters", "__at_bytes")


def closings_of(counted: DataFrame, spikes: DataFrame) -> DataFrame:
    """``__sort, __form`` of each manner of closing, learned away from spikes."""
    away = at_limit(counted, spikes).where(~F.col("__limit") & F.col("__form").isNotNull())
    forms = away.groupBy("__sort", "__form").agg(F.sum("n").alias("n"))
    totals = forms.groupBy("__sort").agg(F.sum("n").alias("all"))
    least = F.create_map(*[F.lit(x) for item in CLOSING_SHARES.items() for x in item])
    often = (F.col("n") >= CLOSING_LEAST) & (F.col("n") >= least[F.col("__sort")] * F.col("all"))
    return forms.join(F.broadcast(totals), "__sort").where(often).select("__sort", "__form")


def _rows(df: DataFrame, key: str, source: str, value: str, entries: Sequence[str]) -> DataFrame:
    rows = df.select(
        F.col(key), source_key(source).alias("source_key"), trimmed(F.col(value)).alias("__text"),
        F.length(value).alias("__characters"), F.octet_length(value).alias("__bytes"),
    ).where("__text <> ''")
    return with_ending(rows, "__text", entries).drop("__text")


def length_spikes(df: DataFrame, source: str, value: str) -> DataFrame:
    """``source_key, unit, length, n, n_longer, usual`` of each spike of the length histograms of ``value``."""
    return spikes_of(count_endings(_rows(df.select(source, value), value, source, value, ())))


def _judged(rows: DataFrame, counted: DataFrame) -> DataFrame:
    spikes = spikes_of(counted)
    known = F.broadcast(closings_of(counted, spikes).withColumn("__closing", F.lit(True)))
    rows = at_limit(rows, spikes).join(known, ["__sort", "__form"], "left")
    whole = (F.col("__sort") == "whole") | F.col("__closing").isNotNull()
    evidence = F.when(whole, F.lit(None)).when(F.col("__limit"), "limit").when(F.col("__sort") != "edge", "context")
    return rows.withColumn("evidence", evidence.cast("string"))


def cut_values(df: DataFrame, entries: Sequence[str] = (), key: str = "row_id", source: str = "model", value: str = "raw_thinking") -> DataFrame:
    """``key, source_key, evidence`` of each non-blank value; evidence is ``limit``, ``context`` or null if it is whole.

    ``entries`` are the possible values of list entries and edges.
    """
    rows = _rows(df, key, source, value, entries)
    return _judged(rows, cut_lineage(count_endings(rows))).select(key, "source_key", "evidence")


def cut_report(df: DataFrame, entries: Sequence[str] = (), source: str = "model", value: str = "raw_thinking", key: str = "row_id") -> DataFrame:
    """Per source: values, cut values by evidence and their share, and the length limits seen.

    Everything follows from the counted endings, so the values are scanned once.
    """
    counted = cut_lineage(count_endings(_rows(df, key, source, value, entries)))
    limits = spikes_of(counted).groupBy("source_key").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "length", "unit"))).alias("limits"))
    summed = lambda evidence: F.coalesce(F.sum(F.when(F.col("evidence") == evidence, F.col("n"))), F.lit(0))
    return (
        _judged(counted, counted)
        .groupBy("source_key")
        .agg(F.sum("n").alias("n_values"), summed("limit").alias("n_cut_by_limit"), summed("context").alias("n_cut_elsewhere"))
        .withColumn("cut_share", (F.col("n_cut_by_limit") + F.col("n_cut_elsewhere")) / F.col("n_values"))
        .join(limits, "source_key", "left")
    )
