import pytest

from causeway.llm import scans as S
from tests.conftest import rows

TEXT = (
    "The supervisory board approved the governance charter in eleven countries. The audit function tracked the long-term plan, "
    "which led to better ratings from lenders. Our data office reported on mid- and long-term pathways at 12 locations near Volken."
)


@pytest.fixture(scope="module")
def reader():
    words, pairs = {}, {}
    tokens = [t.strip(S._STRIP) for t in TEXT.lower().split()]
    for w in tokens:
        if not S._PLAIN_NUMBER.fullmatch(w):
            words[w] = words.get(w, 0) + 50
    for a, b in zip(tokens, tokens[1:]):
        if a in words and b in words:
            pairs[a, b] = pairs.get((a, b), 0) + 50
    return S.Reader(words, pairs, sum(words.values()), {"fhe": ("the", 9), "eleveri": ("eleven", 9), "b0ard": ("board", 9)})


@pytest.mark.parametrize(
    ("token", "word"),
    [("b0ard", "board"), ("rafings", "ratings"), ("tracl<ed".replace("l<", "k"), None), ("fhe", "the"), ("supervisory", None), ("approvecl", "approved"), ("charfer", "charter"), ("Volken", None),
     ("courifries", "countries"), ("1ed", "led"), ("eleveri", "eleven"), ("12", None), ("Zanfer", None)],
)
def test_channel(reader, token, word):
    got = reader.misread(["which", token, "to"])
    assert got == ({1: word} if word else {})


def test_numbers_and_signs(reader):
    assert reader.misread(["at", "l2", "locations"]) == {1: "12"} and reader.misread(["at", "12", "locations"]) == {}
    assert list(reader.misread(["plathe@rd"])) == [0] and reader.misread(["CO2"]) == {}


def test_the_channel_is_estimated():
    assert S.confusions("cornrnunity", "community") == [("m", "rn"), ("m", "rn")] and S.confusions("wbicb", "which") == [("h", "b"), ("h", "b")]
    assert S.confusions("veröfferitlicht", "veröffentlicht") == [("n", "ri")] and S.confusions("same", "same") == []
    channel = S.Channel({"the": 1000, "cost": 1000}, {"fhe": ("the", 90), "cosf": ("cost", 90), "c0st": ("cost", 10)})
    assert channel.cost("t", "f") > channel.cost("o", "0") > channel.cost("s", "5")
    assert abs(channel.cost("t", "f") - S.math.log(180.5 / 2230)) < 1e-9


def test_roman_page_numbers():
    assert [S.roman(x) for x in ("iv", "xix", "xlii", "c", "iiv", "vx")] == [4, 19, 42, 100, None, None]
    assert S.number_style("xiv") == ("roman", 14)
    page = "xiv\nBody text goes on here and\nends."
    assert S.edge_noise(page.split("\n"), 14, set(), {("roman", 0): 9}) == {0: "page_number"} and S.edge_noise(page.split("\n"), 15, set(), {("roman", 0): 9}) == {}


def test_short_headers_within_paragraphs(reader):
    """They need two words around them that follow each other elsewhere."""
    key = S.header_key("ESG")
    assert S.read_paragraph(reader, "The supervisory ESG board approved the plan", 1, {key}, {})[0] == ["running_header"]
    assert S.read_paragraph(reader, "The board approved ESG ratings", 1, {key}, {})[0] == []


def test_many_edge_lines():
    lines = [f"Line {c} of the Header" for c in "abcdef"] + ["and the body goes on."]
    assert S.edge_noise(lines, 1, {S.header_key(x) for x in lines[:6]}, {}) == dict.fromkeys(range(6), "running_header")


def test_local_decoding_is_the_same_as_of_the_whole_line(reader):
    line = "The supervis0ry b0ard approvecl fhe governance charfer in eleveri countries".split()
    whole = {i: w for i, w in enumerate(reader.decode(line)) if w is not None}
    assert reader.misread(line) == whole and whole[3] == "approved"


@pytest.mark.parametrize(
    ("left", "mark", "right", "want"),
    [("gover", "-", "nance", True), ("long", "-", "term", False), ("mid", "-", "and", False), ("appro", "¬", "ved", True), ("gover", "‐", "narice", True), ("Vol", "-", "ken.", True), ("long", "-", "ferm", False)],
)
def test_broken_words(reader, left, mark, right, want):
    assert reader.broken(left, mark, right)[0] is want


def test_number_lines():
    assert S.number_style("Page 3l of 95") == ("page", 31) and S.number_style("- 12 -") == ("dash", 12) and S.number_style("[7]") == ("box", 7)
    assert S.number_style("12") == ("bare", 12) and S.number_style("Base year 2021") is None and S.number_style("lol") is None
    assert S.header_key("8   Caldrith Bank · Review 2024") == S.header_key("Ca1drith  Bonk · Rcview 2024   9")


def test_page(reader):
    headers = {S.header_key("Caldrith Bank Review 2024")}
    text = "Caldrith Bank Review 2024\r\n\r\nThe supervisory board appro-\r\nved the governance charfer in eleven\r\ncountries.\r\n\r\nThe audit function tracked the long-\r\nterm plan.\r\n12"
    noise, clean = S.read_page(reader, text, 2, headers, {("bare", 10): 5})
    assert noise == [(1, "running_header"), (3, "hyphen_break"), (4, "misread"), (9, "page_number")]
    assert clean == "The supervisory board approved the governance charter in eleven countries.\n\nThe audit function tracked the long-term plan."


def test_paragraph(reader):
    headers = {S.header_key("Caldrith Bank Review 2024")}
    text = "The supervisory board appro- ved the Caldrith Bank Review 2024 governance charfer [12] in eleven countries on mid- and long-term pathways."
    kinds, clean = S.read_paragraph(reader, text, 2, headers, {("box", 10): 5})
    assert kinds == ["hyphen_break", "misread", "page_number", "running_header"]
    assert clean == "The supervisory board approved the governance charter in eleven countries on mid- and long-term pathways."


def tables(spark, n=12):
    body = TEXT.replace(". ", ".\n")
    pages = [(i, "r", i, f"Caldrith Bank Review 2024\n\n{body}\n\n{i + 10}", "ocr", 0) for i in range(1, n + 1)]
    pages += [(90, "r", 13, None, None, 0), (91, None, 1, "", "ocr", 0), (92, "q", None, "x" * 200_000, None, 0)]
    paras = [(i, "r", i, TEXT if i % 2 else None, 0) for i in range(1, n + 1)] + [(50, None, None, TEXT.replace("board", "b0ard"), 0)]
    return (
        spark.createDataFrame(pages, "page_row_id BIGINT, report_id STRING, page INT, text STRING, method STRING, headers INT"),
        spark.createDataFrame(paras, "para_id BIGINT, report_id STRING, page INT, text STRING, numbers INT"),
    )


def test_tables(spark):
    pages, paras = tables(spark)
    got = rows(S.locate_noise(pages, paras))
    assert got == sorted(
        [("page_text", i, 1, "running_header") for i in range(1, 13)] + [("page_text", i, 7, "page_number") for i in range(1, 13)] + [("paragraph_text", 50, 0, "misread")],
        key=repr,
    )
    repaired = {(r.source_table, r.record_id): r.text for r in S.repaired_texts(pages, paras).collect()}
    assert repaired["paragraph_text", 50] == TEXT and repaired["page_text", 92] == "x" * 200_000 and ("page_text", 90) not in repaired
    assert S.locate_noise(pages.limit(0), paras.limit(0)).count() == 0
