"""The registered lexicon queries cover all reports at the widths of the scans they reproduce; brute force in plain Python."""

import importlib
import re

import pytest

from causeway.plans.lexicon_queries import CONCEPTS, MARKERS

entry_module = importlib.import_module("__spark_entry__")
NAMES = list(CONCEPTS)
MARKER = re.compile("|".join(f"(?:{p})" for p in MARKERS), re.I)
CONCEPT = [re.compile("|".join(f"(?:{p})" for p in ps), re.I) for ps in CONCEPTS.values()]


def found(text):
    return {n for n, p in zip(NAMES, CONCEPT, strict=True) if p.search(text)}


def span(rows):
    pages = [r["page"] for r in rows if r["page"] is not None]
    return max(pages) - min(pages) if pages else 0


@pytest.fixture(scope="module")
def reports(small):
    """Surviving rows of each report in order."""
    parquet = pytest.importorskip("pyarrow.parquet")
    by = {}
    for r in parquet.read_table(f"{small}/paragraph_text.parquet").to_pylist():
        if r["text"] is not None and len(r["text"].strip()) >= 40:
            line = r["page"] * 1000 + r["para_pos"] if r["page"] is not None and r["para_pos"] is not None else None
            by.setdefault(r["report_id"] or f"paragraph {r['para_id']}", []).append(r | {"line": line, "nodes": found(r["text"]), "marks": MARKER.findall(r["text"])})
    return {f: sorted(rs, key=lambda r: (r["line"] is not None, r["line"])) for f, rs in by.items()}


def brute_relaxed(reports):
    """Rows whose 15-row neighbourhood has all concepts, 4 markers and 5 pages at most, with their number in the report."""
    out = []
    for file, rs in reports.items():
        for i, r in enumerate(rs):
            near = rs[max(0, i - 7) : i + 8]
            around = " ".join(x["text"] for x in near)
            n = len(MARKER.findall(around))
            if span(near) <= 5 and n >= 4 and found(around) == set(NAMES):
                out.append((file, r["line"], i + 1, span(near), n))
    return out


def test_relaxed_covers_all_reports(spark, small, reports):
    want = brute_relaxed(reports)
    got = [tuple(r) for r in entry_module.queries()["lex_13_relaxed"](spark, small).select("file", "anchor_line", "page_span", "marker_count").collect()]
    assert sorted(got) == sorted((f, line, pages, n) for f, line, _, pages, n in want)


def test_collapsed_at_six_rows(spark, small, reports):
    islands, last = [], None
    for file, line, rn, _, n in brute_relaxed(reports):
        if last is None or last[0] != file or rn - last[1] > 6:
            islands.append([])
        islands[-1].append((-n, rn, file, line))
        last = (file, rn)
    got = [tuple(r) for r in entry_module.queries()["lex_14_collapsed"](spark, small).select("file", "anchor_line", "marker_count").collect()]
    assert sorted(got) == sorted((file, line, -n) for n, _, file, line in map(min, islands))


def brute_windows(reports, one_section):
    """The smallest window of up to 20 rows and 6 pages from each start row with a concept."""
    out = []
    for file, rs in reports.items():
        for i, r in enumerate(rs):
            for size in range(2, min(20, len(rs) - i) + 1) if r["nodes"] else ():
                w = rs[i : i + size]
                if one_section and any(x["section"] != r["section"] for x in w):
                    break
                marked = sum(bool(x["marks"]) for x in w)
                if span(w) <= 6 and w[-1]["nodes"] and marked >= 2 and set().union(*(x["nodes"] for x in w)) == set(NAMES):
                    out.append((file, r["line"], w[-1]["line"], size, marked))
                    break
    return sorted(out)


@pytest.mark.parametrize(("name", "one_section"), [("lex_8_smallest_window", False), ("lex_8_one_section", True), ("lex_9_window_rank", False)])
def test_windows_of_twenty_rows(spark, small, reports, name, one_section):
    got = entry_module.queries()[name](spark, small).select("file", "start_line", "end_line", "n_rows", "rows_with_markers").collect()
    assert sorted(map(tuple, got)) == brute_windows(reports, one_section)


def test_window_detail_of_twenty_rows(spark, small, reports):
    got = {(r.file, r.start_line): r for r in entry_module.queries()["lex_10_window_detail"](spark, small).collect()}
    want = brute_windows(reports, False)
    assert sorted((*k, r.n_rows) for k, r in got.items()) == [(file, line, n) for file, line, _, n, _ in want]
    for file, line, _, n, _ in want:
        at = next(i for i, r in enumerate(reports[file]) if r["line"] == line)
        assert got[file, line].texts == "; ".join(r["text"] for r in reports[file][at : at + n])


def test_anchored_reaches_fifteen_rows(spark, small, reports):
    want = []
    for file, rs in reports.items():
        for i, r in enumerate(rs):
            near = rs[max(0, i - 15) : i + 16]
            total = sum(len(x["marks"]) for x in near)
            if "MBV" in r["nodes"] and span(near) <= 6 and total >= 2 and set().union(*(x["nodes"] for x in near)) == set(NAMES):
                want.append((file, r["line"], near[0]["line"], near[-1]["line"], total))
    got = entry_module.queries()["lex_11_anchored"](spark, small).select("file", "anchor_line", "span_start", "span_end", "total_markers").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    counts = {file: sum(w[0] == file for w in want) for file, *_ in want}
    assert {r.file: r.n_hits for r in entry_module.queries()["lex_12_per_file"](spark, small).collect()} == counts
