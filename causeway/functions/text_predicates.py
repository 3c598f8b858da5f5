"""Tests of page lines, pages, paragraphs and sentences of reports: Column -> boolean Column.

All are built-in expressions. Thresholds and word lists are those of the report cleaner whose
results they reproduce. A null text is treated as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.patterns import SPACE, all_matches, bind, holds_any, letters, lines, matches, occurrences, strip, words

# Patterns of the report cleaner.
NAVIGATION_TITLES = (
    r"(?:TO\s+OUR\s+SHAREHOLDERS|GROUP\s+MANAGEMENT\s+REPORT|FINANCIAL\s+REVIEW|SUSTAINABILITY\s+STATEMENT"
    r"|CONSOLIDATED\s+FINANCIAL\s+STATEMENTS|ADDITIONAL\s+INFORMATION)"
)
PAGE_NUMBER_LINE = r"^\s*\d{1,4}\s*$"
TOPIC_NAMES = (
    r"(?:General Disclosures|Climate [Cc]hange|Own [Ww]orkforce|Business [Cc]onduct|Pollution|Water and [Mm]arine|Biodiversity"
    r"|Resource [Uu]se|Affected [Cc]ommunities|Consumers and [Ee]nd|Workers in the [Vv]alue)"
)
POLICY_TABLE_MARKERS = (
    r"\bSenior\s+level\b|\bThird-party\s+standards\b|\bStakeholder\b.*\bPolicies\b|\bContent\s+Scope\b"
    r"|\bAvailabil(?:ity|e)\b.*\bAccessible\b|\bExecutive\s+(?:Board|Company)\b.*\bAgreement\b"
)
CONTENTS_ENTRY, NUMBERED_ENTRY, INDEX_TITLE = r"^.{5,}\s+\d{1,4}\s*$", r"ESRS\s+[A-Z]\d.*\d{2,3}", r"ESRS\s+Index"
CONTENTS_MARKS, LONG_SENTENCE = r"(?:►|ESRS\s+[A-Z]\d|[ESGB][1-5][\-,])", r"[A-Za-z]{10}[^.]*+\.\s"
COMMITTEE, PERCENTAGE, NUMBER = r"Committee[:\s]", r"~?\d+\.?\d*%", r"\b\d+\.?\d*\b"
STREAM_COLUMNS, ROLE_COLUMNS = r"Up-\s+\w|Down-\s+\w|Long-\s+Up|Short-\s+Up", r"\bSVP\b.*\bSOP\b|\bSOP\b.*\bSVP\b"
STREAM_WORDS, HEAD_FRAGMENTS = r"Up(?:fresh|stream|term)|Down(?:stream|term)", r"(?:Classifi-|cation|horizon)\s+(?:level|chain)"
DEPENDENCY_FRAGMENTS = r"dependen-\s*(?:Negative|cies)"
BULLET_LINE = r"^[►\-–•]\s*.*$"
TITLED_WORDS = r"(?<!\. )[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?=\s+[A-Z])"
POLICY_TABLE_HEADS, POLICY_TABLE_CELLS = r"(?:Own\s+Operations|Executive\s+Company|Accessible\s+via)", r"(?:Agreement|understanding|applies\s+to\s+all)"
IMPACTS_HEAD = r"^Impacts,?\s+risks\s+and\s+opportunities\s+Impacts"
NAME_ENTRY = r"[−–—\-]\s+[A-Z][a-zà-ö]+(?:\s+[A-Z][a-zà-ö]+)+\s*(?:[–—\-]\s|$|\()"
AUXILIARY_VERBS = r"\b(?:is|are|was|were|has|have|had|will|shall|can|do|does|did)\b"
COMMON_VERBS = (
    r"\b(?:is|are|was|were|has|have|had|will|shall|can|do|does|did|make|take|set|use|include|apply|ensure|manage|lead|work"
    r"|provide|report|cover|focus|address)\b"
)
TABLE_CELL_MARKERS = (
    r"\bn\.a\.\b|\bActual\b(?=\s+n\.a\.)|(?:Negative|Positive)\s+(?:Up|Down)|\bImpact\s+stream\b"
    r"|(?:Short|Medium|Long)-\s*(?:term\s+)?(?:Up|Down)?stream|\bRisk\s+n\.a\.|\bOpportunit(?:y|ies)\s+n\.a\."
)


def _own(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def is_allcaps_block(text: Column) -> Column:
    """TXT-1: at least 20 characters, more than 80 % of the letters upper case."""
    def test(own: Column) -> Column:
        upper = F.regexp_count(own, F.lit(r"\p{Lu}"))
        return (F.length(own) >= 20) & (letters(own) > 0) & (_ratio(upper, letters(own)) > 0.80)

    return bind(strip(_own(text)), test)


def is_contents_page(text: Column) -> Column:
    """TXT-2: tables of contents, indexes, and diagram pages without sentences."""
    own = _own(text)

    def listed(rows: Column) -> Column:
        entries = F.size(F.filter(rows, lambda x: matches(x, CONTENTS_ENTRY)))
        return (entries > 5) & (_ratio(entries, F.size(rows)) > 0.3)

    rows = F.transform(lines(strip(own)), strip)
    numbered = F.size(F.filter(rows, lambda x: matches(x, NUMBERED_ENTRY)))
    return (
        (strip(own) == "")
        | bind(rows, listed)
        | (occurrences(own, CONTENTS_MARKS) > 10)
        | matches(own, INDEX_TITLE)
        | ((F.length(own) > 500) & (occurrences(own, LONG_SENTENCE) < 3))  # ten letters or more, possessive: the same matches, without backtracking
        | (numbered >= 5)
    )


def is_navigation_line(text: Column) -> Column:
    """TXT-3: at least two navigation titles."""
    return occurrences(_own(text), NAVIGATION_TITLES, ignore_case=True) >= 2


def is_scrambled_table(text: Column) -> Column:
    """TXT-4: text merged from table columns, diagrams or policy tables."""
    def test(own: Column) -> Column:
        parts = words(own)
        n_words = F.size(parts)
        short = F.size(F.filter(parts, lambda w: F.length(w) <= 2))
        pieces = F.split(own, f"[{SPACE}]{{3,}}", -1)
        thin = F.size(F.filter(pieces, lambda p: F.size(words(p)) <= 3))
        sentences = F.split(own, f"[.!?][{SPACE}]+", -1)
        # the lengths of the sentences add up to that of the text without the separators
        total = F.aggregate(sentences, F.lit(0), lambda n, s: n + F.length(s))
        titled = occurrences(own, TITLED_WORDS)
        return (
            (own == "")
            | ((n_words > 10) & (_ratio(short, n_words) > 0.4))
            | ((occurrences(own, "[–—─]") > 5) & (F.length(own) < 500))
            | ((F.size(pieces) > 6) & (thin > F.size(pieces) * 0.5))
            | (
                holds_any(own, "Disclosures", "Climate ", "Own ", "Business ", "Pollution", "Water and", "Biodiversity", "Resource ", "Affected ", "Consumers", "Workers in")
                & (occurrences(own, TOPIC_NAMES) >= 3)
            )
            | ((F.length(own) > 200) & (F.size(sentences) > 5) & (total / F.size(sentences) < 30))
            | ((F.length(own) > 150) & (titled > 8))
            | (
                bind(F.lower(own), lambda x: holds_any(x, "senior", "third-party", "policies", "content", "accessible", "agreement"))
                & (occurrences(own, POLICY_TABLE_MARKERS, ignore_case=True) >= 2)
            )
            | (F.lower(F.substring(own, 1, 7)) == "impacts") & matches(own, IMPACTS_HEAD, ignore_case=True)
            | (
                holds_any(own, "Operations", "Executive", "Accessible")
                & matches(own, POLICY_TABLE_HEADS)
                & matches(own, POLICY_TABLE_CELLS)
            )
        )

    return bind(strip(_own(text)), test)


def is_name_list(text: Column) -> Column:
    """TXT-5: lists of names and roles, or of committees."""
    def test(own: Column) -> Column:
        entries = all_matches(own, NAME_ENTRY)
        covered = F.aggregate(entries, F.lit(0), lambda n, e: n + F.length(e))
        return ((F.size(entries) >= 3) & (covered > 0.5 * F.length(own))) | (occurrences(own, COMMITTEE, ignore_case=True) >= 3)

    return bind(strip(_own(text)), test)


def is_non_narrative(text: Column) -> Column:
    """TXT-6: bullets, figures, percentages and verbless scraps."""
    def test(own: Column) -> Column:
        size = F.length(own)
        return (
            (own == "")
            | (matches(own, BULLET_LINE) & (size < 60))
            | ((letters(own) < 0.4 * size) & (size > 20))
            | (occurrences(own, PERCENTAGE) >= 4)
            | ((occurrences(own, NUMBER) >= 8) & (size < 300))
            | ((size < 40) & ~matches(own, AUXILIARY_VERBS, ignore_case=True) & ~own.rlike("^[A-Z]"))
        )

    return bind(strip(_own(text)), test)


def is_garbled(text: Column) -> Column:
    """TXT-7: fragments of broken tables."""
    def test(own: Column) -> Column:
        n_words = F.size(words(own))
        return (
            (own == "")
            | ((n_words <= 5) & ~own.rlike(r"[.!?]$") & ~matches(own, COMMON_VERBS, ignore_case=True))
            | (own.rlike(r"^\p{Ll}") & (n_words <= 8))
            | (bind(F.lower(own), lambda x: holds_any(x, "n.a.", "negative", "positive", "stream")) & matches(own, TABLE_CELL_MARKERS, ignore_case=True))
            | (holds_any(own, "Up-", "Down-", "Long-", "Short-") & (F.length(own) < 300) & matches(own, STREAM_COLUMNS))
            | (own.contains("SVP") & own.contains("SOP") & matches(own, ROLE_COLUMNS))
            | (own.contains("n.a.") & matches(own, STREAM_WORDS))
            | (
                bind(F.lower(own), lambda x: holds_any(x, " level", "\tlevel", "\nlevel", "chain", "dependen-"))
                & (
                    matches(own, HEAD_FRAGMENTS, ignore_case=True)
                    | matches(own, DEPENDENCY_FRAGMENTS, ignore_case=True)
                )
            )
        )

    return bind(strip(_own(text)), test)


def is_good_sentence(text: Column, least: int = 20, most: int = 2000) -> Column:
    """TXT-8: a sentence worth keeping."""
    def test(own: Column) -> Column:
        size = F.length(own)
        return size.between(least, most) & (letters(own) >= 0.5 * size) & ~own.rlike("^[►•]") & ~is_garbled(own)

    return bind(strip(_own(text)), test)


def is_page_number_line(text: Column) -> Column:
    """TXT-9: a line of one to four digits."""
    return matches(_own(text), PAGE_NUMBER_LINE)


def is_long_enough(text: Column, least: int) -> Column:
    """TXT-10, 11, 12: at least ``least`` characters (50 for pages, 30 for paragraphs, 40 for corpus rows)."""
    return F.length(strip(_own(text))) >= least


def keeps_paragraph(text: Column) -> Column:
    """The conjunction that a paragraph must pass, cheap tests first."""
    return (
        is_long_enough(text, 30) & ~is_non_narrative(text) & ~is_name_list(text) & ~is_garbled(text) & ~is_scrambled_table(text)
    )
