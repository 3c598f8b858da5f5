import pytest

from causeway.llm import pairs as P
from tests.conftest import rows

PASSAGE = (
    "The supervisory board approved the governance charter in eleven countries. Energy use per tonne fell from 12 to 9 hours. "
    "The audit function tracked community grants, which led to better ratings from lenders. The group financed the roadmap."
)
JUDGE = P.Judge(["Board Oversight", "Carbon Output", "Green Lending"])


@pytest.mark.parametrize(
    ("answer", "thinking", "want"),
    [
        (None, None, "empty"), ("", "I think so.", "empty"), ("```\n```", None, "empty"), ("​", None, "empty"), ("<think>words here</think>\n ", "- effect: x", "empty"),
        ("", "x\nFINAL: Board Oversight -> Carbon Output", None), ("{}", "NONE", None), ("", "FINAL: A ->", "empty"),
        ("I'm sorry, but I can't help with that.", None, "refusal"), ("Das darf ich leider nicht beantworten.", None, "refusal"), ("Je ne peux pas répondre.", None, "refusal"),
        ("No puedo responder.", None, "refusal"), ("I cannot find a causal statement in these lines.\nNONE", None, None), ("I cannot find a causal statement here.", None, None),
        (PASSAGE, None, "copied"), (PASSAGE.upper(), None, "copied"), ("> " + PASSAGE.replace(". ", ".\n> "), None, "copied"), ("Passage: " + PASSAGE[:150], None, "copied"),
        (f'The key words are "{PASSAGE[:60]}".\nFINAL: Board Oversight -> Carbon Output', None, None),
        ("FINAL: Board Oversight ->", None, "truncated"), ("FINAL: Board Oversight -> Carb", None, "truncated"), ("FINAL: Board Oversight -", None, "truncated"), ("It says so.\nFIN", None, "truncated"),
        ("The author credits carbon out", None, "truncated"), ("<think>The text says so.", None, "truncated"), ("As shown in fig.", None, "truncated"),
        ("FINAL: Board Oversight -> Carb. Output", None, None), ("Board Oversight -> Carbon Output", None, None), ("**NONE**", None, None), ("It is stated clearly.", None, None),
        ("Der Text nennt nur Maßnahmen und keine Wirkung.\nFINAL: NONE", None, "other_language"), ("Le texte énumère seulement des mesures.\nFINAL: NONE", None, "other_language"),
        ("La segunda frase atribuye board oversight a carbon output en el texto.", None, "other_language"), ("<think>Der Text ist auf Deutsch und das ist gut.</think>\nThe text says it.", None, None),
    ],
)
def test_defects(answer, thinking, want):
    assert JUDGE.defect(answer, (thinking or "").split("\n")[-1], P.Passage(PASSAGE), "en") == want


def test_without_passage_or_language():
    assert JUDGE.defect(PASSAGE, None, None, None) is None
    assert JUDGE.defect("Der Text nennt nur Maßnahmen und keine Wirkung.", None, None, None) is None
    assert JUDGE.defect("x " * 500_000 + "end.", None, P.Passage(PASSAGE), "en") is None


def test_table(spark):
    results = spark.createDataFrame(
        [(1, " E1", "m", None, PASSAGE, None, None, 0), (2, "e1", "m", "bad", None, None, None, 0), (3, None, None, None, "", None, None, 0), (4, "e1", "m", None, None, "t", "raw", 0),
         (5, "gone", "m", None, PASSAGE, None, None, 0), (6, "E1 ", "m", None, "A -> B", None, None, 0)],
        "row_id BIGINT, excerpt_id STRING, model STRING, error STRING, raw_response STRING, raw_thinking STRING, raw_output STRING, passage INT",
    )
    excerpts = spark.createDataFrame([("e1", PASSAGE, "en", 1), ("e2", None, None, 1)], "excerpt_id STRING, text STRING, lang STRING, raw_response INT")
    assert rows(P.defects(results, excerpts, ["A"])) == [(1, "copied"), (3, "empty")]
    assert P.defects(results.limit(0), excerpts, []).count() == 0 and P.defects(results, excerpts.limit(0), []).count() == 1
    rates = {r.model: r for r in P.defect_rates(results, excerpts, ["A"]).collect()}
    assert rates["m"].n_pairs == 3 and rates["m"].n_copied == 1 and rates[""].n_empty == 1


def test_closings_are_learned(spark):
    """Frequent last lines close an answer; the beginning of a more frequent line does not."""
    texts = ["It says so.\nover and out"] * 5 + ["It says so.\nFIN"] * 5 + ["It says so.\nFINAL: Board Oversight -> Carbon Output"] * 20 + [f"It says number {i} and" for i in range(30)] + [None, ""]
    schema = "row_id BIGINT, excerpt_id STRING, raw_response STRING, raw_thinking STRING, error STRING, raw_output STRING"
    results = spark.createDataFrame([(i, None, t, None, None, None) for i, t in enumerate(texts)], schema)
    got = dict(rows(P.defects(results, spark.createDataFrame([], "excerpt_id STRING, text STRING, lang STRING"), ["Board Oversight", "Carbon Output"])))
    assert set(got) == {*range(5, 10), *range(30, 62)} and got[7] == "truncated" and got[60] == "empty"


def test_profiles_bear_out_the_function_words(spark):
    texts = {"en": "The board which was there had been in this house and thought about other ways to reach the goal. ", "es": "La segunda frase atribuye una medida distinta al consejo de vigilancia con ventaja. "}
    excerpts = spark.createDataFrame([(f"{k}{i}", t, k) for k, t in texts.items() for i in range(9)] + [("n", None, "en"), ("m", "x", None)], "excerpt_id STRING, text STRING, lang STRING")
    profiles = P.language_profiles(excerpts)
    assert set(profiles) == {"en", "es"}
    judge = P.Judge(["Board Oversight"], profiles)
    assert judge.language_of("The key words are. Segunda frase atribuye medida distinta vigilancia ventaja consejo.", "es") is None
    assert judge.language_of("The board thought about other ways to reach this goal.", "es") == "en"


def test_passages_with_one_folded_id(spark):
    schema = "row_id BIGINT, excerpt_id STRING, raw_response STRING, raw_thinking STRING, error STRING, raw_output STRING"
    results = spark.createDataFrame([(1, "e1", PASSAGE, None, None, None)], schema)
    for ids in (("E1", "e1"), ("e1 ", " e1")):
        excerpts = spark.createDataFrame([(ids[0], PASSAGE, "en"), (ids[1], "Another text.", "en")], "excerpt_id STRING, text STRING, lang STRING")
        first = min(zip(ids, (PASSAGE, "Another text.")))[1]
        assert rows(P.defects(results, excerpts, [])) == ([(1, "copied")] if first == PASSAGE else [])
