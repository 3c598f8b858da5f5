"""Queries of the report cleaner and their SQL twins (stage A: TXT, STR, SEC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import text_predicates as P
from causeway.functions import text_transforms as T
from causeway.operators import sections as S
from causeway.sources import read_table, spread

PARA, PAGE = ("paragraph_text", "para_id"), ("page_text", "page_row_id")


def _flag(table: tuple[str, str], test: Callable[[Column], Column]):
    return lambda spark, sf: read_table(spark, sf, table[0]).select(table[1], test(F.col("text")).alias("flag"))


def _text(table: tuple[str, str], change: Callable[[Column], Column]):
    return lambda spark, sf: read_table(spark, sf, table[0]).select(table[1], change(F.col("text")).alias("text"))


def _lines(spark, sf) -> DataFrame:
    pages = read_table(spark, sf, "page_text")
    return pages.select("page_row_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _line_flag(test):
    return lambda spark, sf: _lines(spark, sf).select("page_row_id", "line_no", test(F.col("line")).alias("flag"))


def _pages(spark, sf) -> DataFrame:
    """The pages; one without report is a document of its own, as nothing says that it belongs to another."""
    own = F.coalesce("report_id", F.concat(F.lit("page "), "page_row_id")).alias("report_id")
    return read_table(spark, sf, "page_text").select("page_row_id", own, "page", "text")


def _surviving(spark, sf) -> DataFrame:
    """Lines of the pages in the place of paragraphs: there the headings stand alone."""
    lines = _pages(spark, sf).select("page_row_id", "report_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return lines.where(P.keeps_paragraph(F.col("text")))


ORDER = ["page", "page_row_id", "line_no"]


def _tagged(spark, sf) -> DataFrame:
    return S.tag_paragraphs(_surviving(spark, sf), "report_id", ORDER)


def str_11_paragraphs(spark, sf):
    pages = read_table(spark, sf, "page_text").select("page_row_id", T.clean_ascii(F.col("text")).alias("text"))
    return pages.select("page_row_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


def str_12_sentences(spark, sf):
    return read_table(spark, sf, "paragraph_text").select("para_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def sec_1_section(spark, sf):
    rows = _lines(spark, sf).select("page_row_id", "line_no", S.detect_section(F.col("line")).alias("s"))
    return rows.where("s IS NOT NULL").select("page_row_id", "line_no", "s.section", "s.category", "s.section_name")


def _page_lines_as_paragraphs(spark, sf):
    return _lines(spark, sf).select("page_row_id", "line_no", S.detect_subsection(F.col("line")).alias("s")).where("s IS NOT NULL")


def sec_2_subsection(spark, sf):
    return _page_lines_as_paragraphs(spark, sf).select("page_row_id", "line_no", F.col("s.code").alias("code"), F.col("s.title").alias("title"))


def sec_3_parents(spark, sf):
    rows = _page_lines_as_paragraphs(spark, sf).select(F.col("s.code").alias("code"), S.parent_section(F.col("s.code")).alias("p"))
    return rows.groupBy("code", "p.section", "p.category").agg(F.count(F.lit(1)).alias("n"))


def sec_4_forward_fill(spark, sf):
    return _tagged(spark, sf).select("page_row_id", "line_no", "tag_section", "tag_category", "tag_section_name", "tag_subsection", "tag_subsection_title")


def _records(spark, sf):
    return S.records(_tagged(spark, sf), "report_id", ORDER)


def sec_5_records(spark, sf):
    return _records(spark, sf).select("report_id", "para_no", "sent_no", "text")


def _parsed(rows: DataFrame, like: str) -> DataFrame:
    """JSON records as columns again, for comparison with other engines."""
    return rows.select(F.from_json("record", like).alias("r")).select("r.*")


def sec_6_compact(spark, sf):
    return _parsed(S.compact(_records(spark, sf)), "text STRING, section STRING, category STRING, subsection STRING, page INT")


def sec_6_verbose(spark, sf):
    return S.verbose(_records(spark, sf))


def _paragraphs(spark, sf):
    """The surviving paragraphs of the cleaned pages with their tags."""
    return S.tag_paragraphs(S.page_paragraphs(spread(_pages(spark, sf)), "page_row_id"), "report_id", ["page", "page_row_id", "pos"])


def sec_4_paragraphs(spark, sf):
    return _paragraphs(spark, sf).select("page_row_id", "pos", "text", "tag_section", "tag_category", "tag_subsection")


def report_records(spark, sf):
    """The whole of stage A, from pages to tagged paragraphs and sentences."""
    return S.records(_paragraphs(spark, sf), "report_id", ["page", "page_row_id", "pos"])


QUERIES = {
    "txt_1_allcaps": _line_flag(P.is_allcaps_block),
    "txt_2_contents_page": _flag(PAGE, P.is_contents_page),
    "txt_3_navigation": _line_flag(P.is_navigation_line),
    "txt_4_scrambled": _flag(PARA, P.is_scrambled_table),
    "txt_5_name_list": _flag(PARA, P.is_name_list),
    "txt_6_non_narrative": _flag(PARA, P.is_non_narrative),
    "txt_7_garbled": _line_flag(P.is_garbled),
    "txt_8_good_sentence": _line_flag(P.is_good_sentence),
    "txt_9_page_number": _line_flag(P.is_page_number_line),
    "txt_10_page_length": _flag(PAGE, lambda c: P.is_long_enough(c, 50)),
    "txt_11_paragraph_length": _flag(PARA, lambda c: P.is_long_enough(c, 30)),
    "txt_12_row_length": _flag(PARA, lambda c: P.is_long_enough(c, 40)),
    "str_1_nfkc": _text(PARA, T.nfkc),
    "str_2_control": _text(PAGE, T.control_characters),
    "str_3_dehyphenate": _text(PAGE, T.dehyphenate),
    "str_4_cross_references": _text(PAGE, T.drop_cross_references),
    "str_5_dangling": _text(PAGE, T.drop_dangling),
    "str_6_footnotes": _text(PAGE, T.drop_footnote_marks),
    "str_7_sources": _text(PAGE, T.drop_sources),
    "str_8_lines": _text(PAGE, T.drop_lines),
    "str_9_space": _text(PAGE, T.collapse_space),
    "str_10_reassemble": _text(PAGE, T.reassemble),
    "str_11_paragraphs": str_11_paragraphs,
    "str_12_sentences": str_12_sentences,
    "str_13_titles": _text(PARA, T.truncate_title),
    "str_14_file_safe": lambda spark, sf: read_table(spark, sf, "concepts").select("concept_id", T.file_safe(F.col("label")).alias("name")),
    "sec_1_section": sec_1_section,
    "sec_2_subsection": sec_2_subsection,
    "sec_3_parents": sec_3_parents,
    "sec_4_forward_fill": sec_4_forward_fill,
    "sec_4_paragraphs": sec_4_paragraphs,
    "sec_5_records": sec_5_records,
    "sec_6_compact": sec_6_compact,
    "sec_6_verbose": sec_6_verbose,
    "report_records": report_records,
}

# ------------------------------------------------------------------------------------------ SQL

SPACE = r"[\s\x{a0}\x0b\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}\p{M}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A pattern for RE2: Unicode word and space classes spelled out."""
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return q(f"(?{flags}){pattern}" if flags else pattern)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def count(x: str, pattern: str, ignore_case: bool = False) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern, ignore_case)}))"


def has(x: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({x}, {rx(pattern, ignore_case)})"


def sub(x: str, pattern: str, by: str = "", ignore_case: bool = False, multiline: bool = False) -> str:
    return f"regexp_replace({x}, {rx(pattern, ignore_case, multiline)}, {q(by)}, 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def own(x: str) -> str:
    return f"coalesce({x}, '')"


def allcaps(x: str) -> str:
    s = strip(own(x))
    upper, letters = count(s, r"\p{Lu}"), count(s, r"\p{L}")
    return f"(length({s}) >= 20 AND {letters} > 0 AND {upper} / greatest({letters}, 1) > 0.80)"


def navigation(x: str) -> str:
    return f"({count(own(x), P.NAVIGATION_TITLES, True)} >= 2)"


def page_number(x: str) -> str:
    return has(own(x), P.PAGE_NUMBER_LINE)


def non_narrative(x: str) -> str:
    s = strip(own(x))
    return f"""({s} = '' OR ({has(s, f'^[►–•-]{SPACE}*[^\\n]*$')} AND length({s}) < 60)
      OR ({count(s, r'\p{L}')} < 0.4 * length({s}) AND length({s}) > 20) OR {count(s, P.PERCENTAGE)} >= 4
      OR ({count(s, P.NUMBER)} >= 8 AND length({s}) < 300)
      OR (length({s}) < 40 AND NOT {has(s, P.AUXILIARY_VERBS, True)} AND NOT {has(s, '^[A-Z]')}))"""


def scrambled(x: str) -> str:
    """RE2 has no look-around: capitalised words before a capital are marked word by word, then counted in runs of two."""
    s = strip(own(x))
    n, parts = f"len({words(s)})", words(s)
    pieces = f"regexp_split_to_array({s}, '{SPACE}{{3,}}')"
    sents = f"regexp_split_to_array({s}, '[.!?]{SPACE}+')"
    short = f"len(list_filter({parts}, lambda w: length(w) <= 2))"
    thin = f"len(list_filter({pieces}, lambda p: len({words('p')}) <= 3))"
    # a word right after a full stop and one blank begins no title
    begun = words(sub(s, r"\. ([A-Z])", ". \x02"))
    marks = (
        f"array_to_string(list_transform(generate_series(1, len({begun}) - 1), lambda i: CASE WHEN NOT regexp_matches({begun}[i], '[A-Z][a-z]+$')"
        f" OR NOT regexp_matches({begun}[i + 1], '^[A-Z]') THEN '-' WHEN regexp_matches({begun}[i], '^[A-Z][a-z]+$') THEN 'S' ELSE 's' END), '')"
    )
    titled = f"coalesce(list_sum(list_transform(regexp_extract_all({marks}, '[Ss]S*'), lambda r: (length(r) + 1) // 2)), 0)"
    return f"""({s} = '' OR ({n} > 10 AND {short} / {n} > 0.4) OR ({count(s, '[–—─]')} > 5 AND length({s}) < 500)
      OR (len({pieces}) > 6 AND {thin} > len({pieces}) * 0.5) OR {count(s, P.TOPIC_NAMES)} >= 3
      OR (length({s}) > 200 AND len({sents}) > 5 AND list_sum(list_transform({sents}, lambda y: length(y))) / len({sents}) < 30)
      OR (length({s}) > 150 AND {titled} > 8) OR {count(s, P.POLICY_TABLE_MARKERS, True)} >= 2
      OR {has(s, P.IMPACTS_HEAD, True)} OR ({has(s, P.POLICY_TABLE_HEADS)} AND {has(s, P.POLICY_TABLE_CELLS)}))"""


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility characters of the Latin, punctuation, letter-like, number, ligature and full-width blocks, by rule: one-to-one and others."""
    ranges = ((0xA0, 0x250), (0x2B0, 0x300), (0x1E00, 0x1F00), (0x2000, 0x2250), (0x2460, 0x2500), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF00, 0xFF5F))
    found = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for a, b in ranges for c in range(a, b) if unicodedata.decomposition(chr(c)).startswith("<")]
    single = [(a, b) for a, b in found if len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single), [(a, b) for a, b in found if len(b) > 1]


def nfkc(x: str) -> str:
    one, by, more = _compatible()
    for a, b in more:
        x = f"replace({x}, {q(a)}, {q(b)})" if a in _EXPANDED else x
    return f"replace(nfc_normalize(translate({x}, {q(one)}, {q(by)})), chr(160), ' ')"


#: The characters with more than one letter that reports use; the twin names them one by one, as each costs a pass.
_EXPANDED = "…½¼¾⅓⅔⅛™℠№㎡" + "".join(map(chr, range(0xFB00, 0xFB07))) + "Ĳĳŀŉǆǉǌ"


def name_list(x: str) -> str:
    s = strip(own(x))
    entries = f"regexp_extract_all({s}, {rx(P.NAME_ENTRY)})"
    return f"((len({entries}) >= 3 AND list_sum(list_transform({entries}, lambda e: length(e))) > 0.5 * length({s})) OR {count(s, P.COMMITTEE, True)} >= 3)"


def garbled(x: str) -> str:
    s = strip(own(x))
    cells = P.TABLE_CELL_MARKERS.replace(r"\bActual\b(?=\s+n\.a\.)", r"\bActual\s+n\.a\.")
    n = f"len({words(s)})"
    return f"""({s} = '' OR ({n} <= 5 AND NOT {has(s, r'[.!?]$')} AND NOT {has(s, P.COMMON_VERBS, True)})
      OR ({has(s, r'^\p{Ll}')} AND {n} <= 8) OR {has(s, cells, True)} OR {has(s, r'^Impact\s+stream\b', True)}
      OR ({has(s, P.STREAM_COLUMNS)} AND length({s}) < 300)
      OR {has(s, P.ROLE_COLUMNS)} OR ({has(s, P.STREAM_WORDS)} AND contains({s}, 'n.a.'))
      OR {has(s, P.HEAD_FRAGMENTS, True)} OR {has(s, P.DEPENDENCY_FRAGMENTS, True)})"""


def good_sentence(x: str) -> str:
    s = strip(own(x))
    return f"(length({s}) BETWEEN 20 AND 2000 AND {count(s, r'\p{L}')} >= 0.5 * length({s}) AND NOT {has(s, '^[►•]')} AND NOT {garbled(s)})"


def contents_page(x: str) -> str:
    s, o = strip(own(x)), own(x)
    rows = f"list_transform(string_split(replace(replace({s}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda y: {strip('y')})"
    entries = f"len(list_filter({rows}, lambda y: regexp_matches(y, {rx(P.CONTENTS_ENTRY)})))"
    numbered = f"len(list_filter({rows}, lambda y: regexp_matches(y, {rx(P.NUMBERED_ENTRY)})))"
    n = f"CASE WHEN {s} = '' THEN 0 ELSE len({rows}) END"
    return f"""({s} = '' OR ({entries} > 5 AND {entries} / greatest({n}, 1) > 0.3)
      OR {count(o, P.CONTENTS_MARKS)} > 10 OR {has(o, P.INDEX_TITLE)}
      OR (length({o}) > 500 AND {count(o, r'[A-Za-z]{10,}[^.]*\.\s')} < 3) OR {numbered} >= 5)"""


def control(x: str) -> str:
    return sub(f"replace({x}, chr(13), chr(10))", r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def dehyphenate(x: str) -> str:
    return sub(x, rf"({WORD})-\n({WORD})", r"\1\2")


def cross_references(x: str) -> str:
    return sub(x, P_CROSS, ignore_case=True)


P_CROSS = T.CROSS_REFERENCES


def dangling(x: str) -> str:
    x = sub(x, r":\s*[:,;.]\s*", ". ")
    x = sub(x, r"(?:can be\s+)?found (?:here|under this link)[.:]*\s*", "", True)
    x = sub(x, r"More detailed information (?:on .{0,60})?(?:can be found|is outlined).*?[.:]\s*", "", True)
    x = sub(x, r"please refer to\s*[.:]*\s*$", "", True, True)
    return sub(x, r"\s+'s\s+", " ")


def footnotes(x: str) -> str:
    return sub(x, r"([.!?])\d{1,2}(\s+[A-Z])", r"\1\2")


def source_lines(x: str) -> str:
    return sub(sub(x, r"^\d{1,2}\s+Source\s*:.*$", "", True, True), r"https?://\S+")


def drop_lines(x: str) -> str:
    y = "y"
    return f"""array_to_string(list_filter(string_split({x}, chr(10)), lambda y: NOT {page_number(y)} AND NOT {navigation(y)} AND NOT {allcaps(y)}
      AND NOT {has(y, r'^\s*ANNUAL\s+REPORT\s+\d{4}\s*$', True)} AND NOT {has(y, r'^\s*(?:\d\s+){2,}\d?\s*$')}
      AND (NOT {has(strip(y), r'^[\s\d]+$')} OR length({strip(y)}) < 2)), chr(10))"""


def space(x: str) -> str:
    return sub(sub(sub(x, "[ \\t]+", " "), "\\n{3,}", "\n\n"), " *\\n *", "\n")


def reassemble(x: str) -> str:
    x = sub(x, r"\n[ \t\n]*\n", "\x01")
    starts = r"[A-Z\"(]|[─−–—-]\s|(?i:(?:GOV|SBM|IRO|BP|MDR|E[1-5]|S[1-4]|G1)-\d+)\s*[-–—]\s*[^.]"
    x = sub(x, rf"([.!?:;])\n({starts})", "\\1\x01\\2")
    x = sub(sub(x, r"\n", " "), "[ \\t]+", " ")
    return strip(sub(sub(x, " *\x01+ *", "\x01"), "\x01+", "\n\n"))


def clean(x: str) -> str:
    for step in (control, dehyphenate, cross_references, dangling, footnotes, source_lines, drop_lines, space, reassemble):
        x = step(x)
    return x


def staged_clean(table: str, key: str) -> str:
    """The cleaning chain with one subquery per step, so that expressions do not multiply."""
    sql = f"SELECT {key}, text FROM {table}"
    for step in (control, dehyphenate, cross_references, dangling, footnotes, source_lines, drop_lines, space, reassemble):
        sql = f"SELECT {key}, {step('text')} AS text FROM ({sql})"
    return sql


def keeps(x: str) -> str:
    return f"length({strip(own(x))}) >= 30 AND NOT {non_narrative(x)} AND NOT {name_list(x)} AND NOT {garbled(x)} AND NOT {scrambled(x)}"


_LINES = "SELECT page_row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM page_text"


def _line_sql(test: str) -> str:
    return f"SELECT page_row_id, CAST(line_no AS INT) AS line_no, {test} AS flag FROM ({_LINES})"


def _flag_sql(table: tuple[str, str], test: str) -> str:
    return f"SELECT {table[1]}, {test} AS flag FROM {table[0]}"


def _text_sql(table: tuple[str, str], change: str) -> str:
    return f"SELECT {table[1]}, {change} AS text FROM {table[0]}"


def _sentences(x: str) -> str:
    marked = sub(x, r"([.!?][\"”’')\]]*)\s+([\p{Lu}\d\"“(\[])", "\\1\x01\\2")
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def _case_section(head: str, field: int) -> str:
    whens = " ".join(f"WHEN {has(head, row[0], True)} THEN {q(row[field])}" for row in S.SECTIONS)
    return f"CASE {whens} END"


def _case_parent(code: str, field: int) -> str:
    prefix = f"regexp_extract({code}, '^([A-Z]+[0-9]?)', 1)"
    whens = " ".join(f"WHEN {q(row[1])} THEN {q(row[field])}" for row in S.SECTIONS[1:-1])
    general = " ".join(f"WHEN {q(p)} THEN {q(S.SECTIONS[0][field])}" for p in S.GENERAL_PREFIXES)
    return f"CASE {prefix} {general} {whens} END"


def _title(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN length({s}) > 80 THEN regexp_replace(substring({s}, 1, 80), ' [^ ]*$', '') ELSE {s} END"


_SUB = rf"(?i){T.SUBSECTION}"


def _sub_sql(source: str, text: str, keys: str) -> str:
    head = f"substring({strip(text)}, 1, 200)"
    return f"SELECT {keys}, upper(regexp_extract({head}, {q(_SUB)}, 1)) AS code, {_title(f'regexp_extract({head}, {q(_SUB)}, 2)')} AS title FROM ({source}) WHERE regexp_matches({head}, {q(_SUB)})"


_SEC2 = _sub_sql(_LINES, "line", "page_row_id, CAST(line_no AS INT) AS line_no")

_HEAD2 = f"substring({strip('text')}, 1, 200)"
_MARKED = f"""SELECT *, CASE WHEN regexp_matches({_HEAD2}, {q(_SUB)}) THEN upper(regexp_extract({_HEAD2}, {q(_SUB)}, 1)) END AS code,
    CASE WHEN regexp_matches({_HEAD2}, {q(_SUB)}) THEN {_title(f'regexp_extract({_HEAD2}, {q(_SUB)}, 2)')} END AS title,
    substring({strip('text')}, 1, 100) AS h FROM (
    SELECT page_row_id, coalesce(report_id, 'page ' || page_row_id) AS report_id, page, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM page_text)
    WHERE {keeps('text')}"""
_CLEANED = f"SELECT page_row_id, {nfkc('text')} AS text FROM page_text WHERE length({strip(own('text'))}) >= 50 AND NOT {contents_page('text')}"
_PARAGRAPHS = f"""SELECT *, CASE WHEN regexp_matches({_HEAD2}, {q(_SUB)}) THEN upper(regexp_extract({_HEAD2}, {q(_SUB)}, 1)) END AS code,
    CASE WHEN regexp_matches({_HEAD2}, {q(_SUB)}) THEN {_title(f'regexp_extract({_HEAD2}, {q(_SUB)}, 2)')} END AS title,
    substring({strip('text')}, 1, 100) AS h FROM (
    SELECT page_row_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS line_no, unnest(p) AS text FROM (
      SELECT page_row_id, list_filter(list_transform(regexp_split_to_array(text, chr(10) || chr(10) || '+'), lambda s: {strip('s')}), lambda s: s <> '') AS p
      FROM ({staged_clean(f'({_CLEANED})', 'page_row_id')}))) JOIN (SELECT page_row_id, coalesce(report_id, 'page ' || page_row_id) AS report_id, page FROM page_text) USING (page_row_id)
    WHERE {keeps('text')}"""
_FILLED = ", ".join(
    f"coalesce(last_value(coalesce({_case_section('h', k)}, {_case_parent('code', k)}) IGNORE NULLS) OVER w, {q(S.SECTIONS[0][k])}) AS {n}"
    for k, n in ((1, "tag_section"), (2, "tag_category"), (3, "tag_section_name"))
)


def _tagged_sql(marked: str) -> str:
    return f"""SELECT page_row_id, report_id, page, line_no, text, {_FILLED}, last_value(code IGNORE NULLS) OVER w AS tag_subsection,
    last_value(title IGNORE NULLS) OVER w AS tag_subsection_title FROM ({marked})
    WINDOW w AS (PARTITION BY report_id ORDER BY page, page_row_id, line_no ROWS UNBOUNDED PRECEDING)"""


_TAGGED = _tagged_sql(_MARKED)


def _records_sql(tagged: str, columns: str) -> str:
    """Paragraphs and their good sentences; ``columns`` may use the tags."""
    tags = "report_id, page, page_row_id, line_no, tag_section, tag_category, tag_section_name, tag_subsection, tag_subsection_title"
    return f"""WITH p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page, page_row_id, line_no) AS para_no FROM ({tagged})),
        s AS (SELECT {tags}, para_no, unnest({_sentences('text')}) AS text, generate_subscripts({_sentences('text')}, 1) AS k FROM p),
        b AS (SELECT {tags}, CAST(para_no AS INT) AS para_no, CAST(NULL AS INT) AS sent_no, text FROM p UNION ALL
          SELECT {tags}, CAST(para_no AS INT), CAST(row_number() OVER (PARTITION BY report_id ORDER BY para_no, k) AS INT), text FROM s WHERE {good_sentence('text')})
        SELECT {columns} FROM b"""


SQL = {
    "txt_1_allcaps": _line_sql(allcaps("line")),
    "txt_2_contents_page": _flag_sql(PAGE, contents_page("text")),
    "txt_3_navigation": _line_sql(navigation("line")),
    "txt_5_name_list": _flag_sql(PARA, name_list("text")),
    "txt_6_non_narrative": _flag_sql(PARA, non_narrative("text")),
    "txt_7_garbled": _line_sql(garbled("line")),
    "txt_8_good_sentence": _line_sql(good_sentence("line")),
    "txt_9_page_number": _line_sql(page_number("line")),
    "txt_10_page_length": _flag_sql(PAGE, f"length({strip(own('text'))}) >= 50"),
    "txt_11_paragraph_length": _flag_sql(PARA, f"length({strip(own('text'))}) >= 30"),
    "txt_12_row_length": _flag_sql(PARA, f"length({strip(own('text'))}) >= 40"),
    "str_2_control": _text_sql(PAGE, control("text")),
    "str_3_dehyphenate": _text_sql(PAGE, dehyphenate("text")),
    "str_4_cross_references": _text_sql(PAGE, cross_references("text")),
    "str_5_dangling": _text_sql(PAGE, dangling("text")),
    "str_6_footnotes": _text_sql(PAGE, footnotes("text")),
    "str_7_sources": _text_sql(PAGE, source_lines("text")),
    "str_8_lines": _text_sql(PAGE, drop_lines("text")),
    "str_9_space": _text_sql(PAGE, space("text")),
    "str_10_reassemble": _text_sql(PAGE, reassemble("text")),
    "str_11_paragraphs": f"""SELECT page_row_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS paragraph FROM (
        SELECT page_row_id, list_filter(list_transform(regexp_split_to_array(text, chr(10) || chr(10) || '+'), lambda s: {strip('s')}), lambda s: s <> '') AS p
        FROM ({staged_clean('page_text', 'page_row_id')}))""",
    "str_12_sentences": f"SELECT para_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM (SELECT para_id, {_sentences('text')} AS s FROM paragraph_text)",
    "str_13_titles": _text_sql(PARA, _title("text")),
    "str_14_file_safe": "SELECT concept_id, translate(translate(label, ' :/', '___'), '.()', '') AS name FROM concepts",
    "sec_1_section": f"""SELECT * FROM (SELECT page_row_id, CAST(line_no AS INT) AS line_no, {_case_section('h', 1)} AS section, {_case_section('h', 2)} AS category, {_case_section('h', 3)} AS section_name
        FROM (SELECT page_row_id, line_no, substring({strip('line')}, 1, 100) AS h FROM ({_LINES}))) WHERE section IS NOT NULL""",
    "sec_2_subsection": _SEC2,
    "sec_4_forward_fill": f"SELECT page_row_id, line_no, tag_section, tag_category, tag_section_name, tag_subsection, tag_subsection_title FROM ({_TAGGED})",
    "sec_4_paragraphs": f"SELECT page_row_id, line_no AS pos, text, tag_section, tag_category, tag_subsection FROM ({_tagged_sql(_PARAGRAPHS)})",
    "sec_5_records": _records_sql(_TAGGED, "report_id, para_no, sent_no, text"),
    "sec_6_compact": _records_sql(_TAGGED, "text, tag_section AS section, tag_category AS category, tag_subsection AS subsection, page"),
    "sec_6_verbose": _records_sql(_TAGGED, "text, page, para_no AS para_id, sent_no AS sent_id, tag_section AS esrs_section, tag_category AS esrs_category, tag_section_name AS esrs_section_name, tag_subsection AS esrs_subsection, tag_subsection_title AS esrs_subsection_title"),
    "report_records": _records_sql(_tagged_sql(_PARAGRAPHS), "report_id, page, page_row_id, line_no AS pos, text, tag_section, tag_category, tag_section_name, tag_subsection, tag_subsection_title, para_no, sent_no"),
    "txt_4_scrambled": _flag_sql(PARA, scrambled("text")),
    "str_1_nfkc": _text_sql(PARA, nfkc("text")),
    "sec_3_parents": f"SELECT code, {_case_parent('code', 1)} AS section, {_case_parent('code', 2)} AS category, count(*) AS n FROM ({_SEC2}) GROUP BY ALL",
}
