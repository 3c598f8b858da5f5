import unicodedata

import pytest
from pyspark.sql import functions as F

from causeway.functions import text_predicates as P
from causeway.functions import text_transforms as T
from causeway.operators import sections as S


def values(spark, texts, *functions):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    return [tuple(r)[1:] for r in df.select("i", *[f(F.col("text")).alias(f"c{k}") for k, f in enumerate(functions)]).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("test", "yes", "no"),
    [
        (P.is_allcaps_block, ["GROUP OVERVIEW AND STRATEGY", "ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖ"], ["GROUP OVERVIEW", "12345678901234567890", "Group overview and strategy", "", None]),
        (P.is_contents_page, ["", None, "ESRS Index of things", "\n".join(f"Chapter number {i}   {i}" for i in range(1, 8)), "x" * 501], ["A short page.", "word " * 20]),
        (P.is_navigation_line, ["Financial review | Additional   information"], ["Financial review", "", None]),
        (P.is_scrambled_table, ["", None, "a b c d e f g h i j k l", "– – – – – – x", "A one   b   c   d   e   f   g", "Pollution Biodiversity Own workforce"], ["The board reviewed the governance charter in two rounds."]),
        (P.is_name_list, ["- Anna Berg (chair) - Carl Dahl - Eva Frost - Gus Holm - Ida Jung - ", "committee: a committee b committee c"], ["", None, "The committee met."]),
        (P.is_non_narrative, ["", None, "• a point", "•\na point", "- \n  x y z",  "12 34 56 78 90 12 34 56 78", "10% 20% 30% 40%", "of the said matter"], ["The board was there and it reviewed the charter."]),
        (P.is_garbled, ["", None, "Impact stream", "of the said matter", "Risk n.a. Positive Up", "Policy SVP and SOP", "see dependen- cies there now ok yes we do"], ["The board is here.", "Emissions fell by a tenth in the last year of the plan."]),
        (P.is_good_sentence, ["Emissions fell by a tenth in the last year."], ["Too short.", "• Emissions fell by a tenth in the last year.", "1 2 3 4 5 6 7 8 9 10 11 12 is", "", None, "The " + "very " * 500 + "long sentence."]),
        (P.is_page_number_line, ["12", "  1234 "], ["12345", "a", "", None]),
    ],
)
def test_predicates(spark, test, yes, no):
    assert values(spark, yes + no, test) == [(True,)] * len(yes) + [(False,)] * len(no)


def test_lengths(spark):
    assert values(spark, ["x" * 30, " " + "x" * 29 + " ", None], lambda c: P.is_long_enough(c, 30)) == [(True,), (False,), (False,)]


def test_transforms(spark):
    got = values(spark, ["ﬁnance x", "plain", None], T.nfkc)
    assert got == [("finance x",), ("plain",), (None,)]
    assert values(spark, ["a\r\nb\x07\tc"], T.control_characters) == [("a\n\nb\tc",)]
    assert values(spark, ["sustain-\nability über-\nall a -\nb"], T.dehyphenate) == [("sustainability überall a -\nb",)]
    # the first alternative takes the words only
    assert values(spark, ["Text ► SEE NOTE 12"], T.drop_cross_references) == [("Text 12",)]
    assert values(spark, ["More: , it can be found here. Next 's plan"], T.drop_dangling) == [("More. it Next plan",)]
    assert values(spark, ["activities.8 Additionally in 2024 more"], T.drop_footnote_marks) == [("activities. Additionally in 2024 more",)]
    assert values(spark, ["a\n15 Source: UN\nb https://x.y/z c"], T.drop_sources) == [("a\n\nb  c",)]
    assert values(spark, ["12\nGROUP OVERVIEW AND STRATEGY\nText\nAnnual  Report 2024\n1 2 3 4"], T.drop_lines) == [("Text",)]
    assert values(spark, ["a  \t b \n\n\n\n c"], T.collapse_space) == [("a b\n\nc",)]
    assert values(spark, ["One line\nwraps here.\nNext starts.\n\nlast one;\n– dash\nE1-2 – Title"], T.reassemble) == [
        ("One line wraps here.\n\nNext starts.\n\nlast one;\n\n– dash E1-2 – Title",)
    ]
    assert values(spark, ["a b. c (d)", None], T.file_safe) == [("a_b_c_d",), (None,)]
    assert values(spark, ["word " * 30, "short"], T.truncate_title) == [(("word " * 16).strip(),), ("short",)]


def test_sentences_and_paragraphs(spark):
    assert values(spark, ['It fell. "It rose." Then e.g. this! Yes? no', "", None], T.sentences) == [
        (["It fell.", '"It rose."', "Then e.g. this!", "Yes? no"],), ([],), (None,),
    ]
    assert values(spark, ["a\n\n\nb\n\n \n\nc"], T.paragraphs) == [(["a", "b", "c"],)]


def test_long_text_is_read_whole(spark):
    text = "The board reviewed the charter. " * 20_000 + "Last one"
    assert values(spark, [text], lambda c: F.size(T.sentences(c)))[0][0] == 20_001


def test_nfkc_matches_unicodedata(spark):
    texts = ["Ⅻ ²", "①", "é", "Å"]
    assert [r[0] for r in values(spark, texts, T.nfkc)] == [unicodedata.normalize("NFKC", t) for t in texts]


def test_section_tags(spark):
    data = [
        ("d", 1, 1, "Before any heading there is this."), ("d", 1, 2, "E1-2 – Policies on climate. More"), ("d", 2, 1, "carried over the page"),
        ("d", 2, 2, "G1 – Business conduct"), ("d", 3, 1, "gov-1 - The role of the board"), (None, 1, 1, "S4-9 – Users"), (None, 1, 2, None),
    ]
    df = spark.createDataFrame(data, "doc STRING, page INT, pos INT, text STRING")
    got = S.tag_paragraphs(df, "doc", ["page", "pos"]).orderBy("doc", "page", "pos").collect()
    assert [(r.tag_section, r.tag_subsection) for r in got] == [
        ("S4", "S4-9"), ("S4", "S4-9"), ("ESRS2", None), ("E1", "E1-2"), ("E1", "E1-2"), ("G1", "E1-2"), ("ESRS2", "GOV-1"),
    ]
    assert got[3].tag_subsection_title == "Policies on climate"
    assert S.tag_paragraphs(df.limit(0), "doc", ["page", "pos"]).count() == 0


def test_records_number_paragraphs_and_sentences(spark):
    data = [("d", 1, 1, "Emissions fell by a tenth in the year. They are to fall further in the next year."), ("d", 1, 2, "Short.")]
    df = S.tag_paragraphs(spark.createDataFrame(data, "doc STRING, page INT, pos INT, text STRING"), "doc", ["page", "pos"])
    got = sorted((r.para_no, r.sent_no or 0) for r in S.records(df, "doc", ["page", "pos"]).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert '"subsection"' not in S.compact(df).first()[0]
