"""Cleaning of page text into paragraphs and sentences: Column -> Column.

Built-in expressions throughout, except for NFKC, which Spark lacks: a pandas UDF that passes
ASCII text through. A null text stays null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.patterns import replace, strip, unicode
from causeway.functions.text_predicates import is_allcaps_block, is_navigation_line, is_page_number_line

# Patterns of the report cleaner.
CROSS_REFERENCES = (
    r"►\s*SEE\s+[A-Z][A-Z\s\-–&,/'.]+|►\s*[A-Z][A-Z\-]+\.[A-Z]+[A-Z/\-\.]*|►\s*SEE\s+(?:NOTE|ESRS)\s+\S+|►\s+[A-Z][A-Z\s]+"
)
SUBSECTION = r"((?:GOV|SBM|IRO|BP|MDR|E[1-5]|S[1-4]|G1)-\d+)\s*[-–—]\s*([^.]+)"


def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t).replace("\u00a0", " "), na_action="ignore")


def nfkc(text: Column) -> Column:
    """STR-1: Unicode compatibility composition, no-break spaces as spaces."""
    return F.pandas_udf(_compose, T.StringType())(text)


def control_characters(text: Column) -> Column:
    """STR-2: carriage returns become line feeds; other control characters but tabs go."""
    return F.regexp_replace(F.translate(text, "\r", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def dehyphenate(text: Column) -> Column:
    """STR-3: words broken across lines are joined."""
    return replace(text, r"(?<=\w)-\n(?=\w)")


def drop_cross_references(text: Column) -> Column:
    """STR-4."""
    return replace(text, CROSS_REFERENCES, ignore_case=True)


def drop_dangling(text: Column) -> Column:
    """STR-5: what dropped references leave behind, in this order."""
    text = replace(text, r":\s*[:,;.]\s*", ". ")
    text = replace(text, r"(?:can be\s+)?found (?:here|under this link)[.:]*\s*", ignore_case=True)
    text = replace(text, r"More detailed information (?:on .{0,60})?(?:can be found|is outlined).*?[.:]\s*", ignore_case=True)
    text = replace(text, r"please refer to\s*[.:]*\s*$", ignore_case=True, multiline=True)
    return replace(text, r"\s+'s\s+", " ")


def drop_footnote_marks(text: Column) -> Column:
    """STR-6: one or two digits between a sentence end and the next sentence."""
    return replace(text, r"(?<=[.!?])(\d{1,2})(?=\s+[A-Z])")


def drop_sources(text: Column) -> Column:
    """STR-7: footnote source lines and addresses."""
    text = replace(text, r"^\d{1,2}\s+Source\s*:.*$", ignore_case=True, multiline=True)
    return replace(text, r"https?://\S+")


def drop_lines(text: Column) -> Column:
    """STR-8: page numbers, navigation, capitals, report titles and column numbers."""
    title = unicode(r"^\s*ANNUAL\s+REPORT\s+\d{4}\s*$", ignore_case=True)
    columns = unicode(r"^\s*(?:\d\s+){2,}\d?\s*$")
    digits = unicode(r"^[\s\d]+$")
    kept = F.filter(
        F.split(text, "\n", -1),
        lambda x: ~is_page_number_line(x) & ~is_navigation_line(x) & ~is_allcaps_block(x) & ~x.rlike(title) & ~x.rlike(columns)
        & (~strip(x).rlike(digits) | (F.length(strip(x)) < 2)),
    )
    return F.array_join(kept, "\n")


def collapse_space(text: Column) -> Column:
    """STR-9."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(text, " *\n *", "\n")


def reassemble(text: Column) -> Column:
    """STR-10: wrapped lines joined; paragraphs apart at blank lines and at sentence ends before a new start."""
    starts = r"[A-Z\"(]|[─−–—\-]\s|(?i:(?:GOV|SBM|IRO|BP|MDR|E[1-5]|S[1-4]|G1)-\d+)\s*[-–—]\s*[^.]"
    text = F.regexp_replace(text, "\n[ \t\n]*\n", "\u0001")
    text = replace(text, rf"(?<=[.!?:;])\n(?={starts})", "\u0001")
    text = F.regexp_replace(text, "\n", " ")
    text = F.regexp_replace(text, "[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, " *\u0001+ *", "\u0001"), "\u0001+", "\n\n"))


def clean(text: Column) -> Column:
    """The whole chain, in order."""
    for step in (
        nfkc, control_characters, dehyphenate, drop_cross_references, drop_dangling, drop_footnote_marks, drop_sources,
        drop_lines, collapse_space, reassemble,
    ):
        text = step(text)
    return text


def clean_ascii(text: Column) -> Column:
    """The chain without NFKC, for text that is known to be composed: stays in the JVM."""
    for step in (
        control_characters, dehyphenate, drop_cross_references, drop_dangling, drop_footnote_marks, drop_sources, drop_lines,
        collapse_space, reassemble,
    ):
        text = step(text)
    return text


def paragraphs(text: Column) -> Column:
    """STR-11: array of paragraphs."""
    return F.filter(F.transform(F.split(text, "\n\n+", -1), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """STR-12: array of sentences.

    A sentence ends at ``.``, ``!`` or ``?`` (with closing quotes or brackets) before white space and an upper-case
    letter, digit, quote or bracket. This is a rule in place of a statistical segmenter.
    """
    marked = F.regexp_replace(text, unicode(r"([.!?][\"”’')\]]*+)\s+(?=[\p{Lu}\d\"“(\[])"), "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001", -1), strip), lambda s: s != "")


def truncate_title(title: Column, most: int = 80) -> Column:
    """STR-13: at most ``most`` characters, back to the last space."""
    own = strip(title)
    return F.when(F.length(own) > most, F.regexp_replace(F.substring(own, 1, most), " [^ ]*$", "")).otherwise(own)


def file_safe(label: Column) -> Column:
    """STR-14: spaces as underscores, no dots or parentheses; colons and slashes as underscores."""
    return F.translate(F.translate(label, " :/", "___"), ".()", "")
