"""Regular expressions that read Unicode text as the operators define it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as Unicode knows it, as ranges of a character class and as characters.
SPACE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_OUTSIDE = {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "d": r"\p{Nd}"}
_INSIDE = {"s": SPACE, "d": r"\p{Nd}"}


def unicode(pattern: str, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """``pattern`` with Unicode classes and only ``\\n`` as line end.

    Java's defaults are ASCII classes and several line ends; letter case is folded beyond ASCII. Space and digit classes are
    spelled out, which is much faster than Java's Unicode mode; that is kept for word classes and borders.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i + 1]
            out.append((_INSIDE if inside else _OUTSIDE).get(two, c + two))
            i += 2
            continue
        inside = (c == "[") if not inside else c != "]"
        out.append(c)
        i += 1
    words = "\\b" in pattern or "\\w" in pattern or "\\W" in pattern
    flags = ("U" if words else "") + "d" + ("iu" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    return f"(?{flags}){''.join(out)}"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def matches(text: Column, pattern: str, ignore_case: bool = False, **flags: bool) -> Column:
    """Whether the pattern occurs anywhere."""
    return text.rlike(unicode(pattern, ignore_case, **flags))


def occurrences(text: Column, pattern: str, ignore_case: bool = False, **flags: bool) -> Column:
    """How often the pattern occurs."""
    return F.regexp_count(text, F.lit(unicode(pattern, ignore_case, **flags)))


def replace(text: Column, pattern: str, by: str = "", ignore_case: bool = False, **flags: bool) -> Column:
    return F.regexp_replace(text, F.lit(unicode(pattern, ignore_case, **flags)), F.lit(by))


def all_matches(text: Column, pattern: str, group: int = 0, ignore_case: bool = False, **flags: bool) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode(pattern, ignore_case, **flags)), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The white-space separated words of a text; none of a blank one."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines between any of the usual line separators."""
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)


def letters(text: Column) -> Column:
    """Number of letters; taking runs of them out is cheaper than listing them."""
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))


def holds_any(text: Column, *parts: str) -> Column:
    """Whether one of the parts occurs: a cheap test before a pattern that needs one of them."""
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))
