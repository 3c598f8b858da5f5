import random

import pytest

from causeway.llm import canonical as C
from tests.conftest import rows

ENTRIES = [
    (1, "Board Oversight", "BOV", ["Directors' Supervision"]), (2, "Carbon Output", "CAO", ["Greenhouse Discharge", "Emissions Level"]),
    (3, "Profit Reliability", "PRR", ["Dependability of Results"]), (4, "Staff Training", "STT", []), (5, "Green Lending", None, ["Eco Loans"]),
]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("board oversight", 1), ("the group's Board Oversight", 1), ("boardoversight", 1), ("boardOversight", 1), ("Board_Oversight", 1), ("Oversight, Board", 1), ("B.O.V.", 1), ("bov", 1),
        ("Board Overs.", 1), ("Bord Oversigth", 1), ("Bоard Oversight", 1), ("Board​ Oversight", 1), ("1. Board Oversight", 1), ("(a) Board Oversight", 1),
        ("Carbon uOtupt", 2), ("higher carbon output", 2), ("GREENHOUSE DISCHARGE", 2), ("Carb. Output", 2), ("Carbon ÃutputÂ".replace("Ã", "Ã³"), 2),
        ("Dependaiblity of Results", 3), ("Reliability of Profit", 3), ("quality of staff training", 4), ("**Staff Training**", 4), ("Ero Loans", 5), ("Lending Green", 5),
        ("Board Games", -1), ("Staff Canteen", -1), ("Green Paint", -1), ("Carbon", -1), ("both", -1), ("???", -1), ("bo", -1), ("the board trained staff on green output", -1),
        ("x" * 200_000, -1), ("Board Oversight " + "and more " * 10_000, 1),
    ],
)
def test_resolve(value, want):
    assert C.Resolver(ENTRIES).resolve(value) == want


def test_longest_mention_wins():
    r = C.Resolver([(1, "Output", None, []), (2, "Carbon Output", None, []), (3, "Risk", None, [])])
    assert r.resolve("risk of the carbon output") == 2 and r.resolve("risk output") == 1


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "MAX_CACHED", 10)
    r = C.Resolver(ENTRIES)
    assert [r.resolve(f"board oversight {'x' * (i % 3)}") for i in range(50)] == [1] * 50 and len(r.known) <= 10


def test_edits_against_definition():
    def plain(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    d[i][j] = i + j
                    continue
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    words = ["board", "baord", "bard", "boards", "oversight", "overisght", "", "b", "drab"]
    for a in words:
        for b in words:
            for most in (0, 1, 2, 3):
                assert C.edits(a, b, most) == min(plain(a, b), most + 1)


def test_deletions_find_every_word_within_the_edits():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    r = C.Resolver([(i, w, None, []) for i, w in enumerate(sorted(set(words)))])
    for w in words[:60]:
        assert r.near_words(w) == {v: n for v in r.vocabulary if (n := C.edits(w, v, C.allowed_edits(v))) <= C.allowed_edits(v)}


def test_too_long_a_list(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ENTRIES", 2)
    with pytest.raises(ValueError):
        C.read_entries(spark.createDataFrame([(i, f"n{i}", None, None) for i in range(3)], "concept_id INT, label STRING, code STRING, alt_names ARRAY<STRING>"))


def test_tables(spark):
    concepts = spark.createDataFrame([(1, "Board Oversight", "BOV", None), (2, "Carbon Output", None, ["x y", None]), (3, None, "Q", [])], "concept_id INT, label STRING, code STRING, alt_names ARRAY<STRING>")
    results = spark.createDataFrame(
        [(1, "Board Oversight", "bov", 5), (2, None, " ", 5), (3, "X Y", "nothing", 5), (4, "bov", None, 5), (4, "bov", None, 5)],
        "row_id BIGINT, predicted_cause STRING, predicted_effect STRING, concept_id INT",
    )
    assert rows(C.resolve_unlisted(results, concepts)) == [
        (1, "effect", 1), (3, "cause", 2), (3, "effect", -1), (4, "cause", 1), (4, "cause", 1),
    ]
    assert {(r.value, r.n, r.concept_id) for r in C.value_report(results, concepts).collect()} >= {("bov", 3, 1), ("nothing", 1, -1)}
    assert C.resolve_unlisted(results.limit(0), concepts).count() == 0
    assert {r[2] for r in rows(C.resolve_unlisted(results, concepts.limit(0)))} == {-1}
