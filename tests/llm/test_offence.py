import ast
import inspect
import os

import numpy as np
import pytest

from causeway.llm import offence as O
from tests.conftest import rows

PLAIN = ["The board reviewed the plan.", "Costs rose because prices rose.", "You can find the tables in the annex.", "Women hold a third of the seats.", "The policy bans nude images at work.", "Rats were found in the depot."]


def offending(kind, rnd):
    """A sentence of the kind out of random words of the general lexicons."""
    of = lambda words, n=1: " ".join(rnd.choice(words[: len(words) // 2], n))
    frames = {
        "abusive": [f"You are a {of(O.INSULTS)}.", f"Your {of(O.INSULTS)} friends, {of(O.INSULTS)} all of you.", f"I will {of(O.VIOLENCE)} you, {of(O.INSULTS)}.", f"Du {of(O.INSULTS)}!"],
        "hateful": [f"{of(O.GROUPS)} are {of(O.DEGRADING)} and {of(O.DEGRADING)}.", f"All {of(O.GROUPS)}, {of(O.DEGRADING, 2)}, {of(O.EXCLUDING)} with them.", f"{of(O.DEGRADING)}, that is {of(O.GROUPS)}."],
        "sexual": [f"{of(O.SEXUAL, 3)} for you.", f"She was {of(O.SEXUAL, 2)}.", f"Free {of(O.SEXUAL, 4)}."],
    }
    return rnd.choice(frames[kind])


def labelled(spark, times=60):
    """Documents and reviews: each offending sentence between plain ones, and plain ones alone."""
    rnd = np.random.default_rng(5)
    documents, reviews = [], []

    def add(text, verdict):
        documents.append((len(documents), text, "s", 0.5))
        reviews.append((len(documents) - 1, verdict))

    plain = lambda: str(rnd.choice(PLAIN))
    for _ in range(times):
        for kind in O.KINDS:
            add(f"{plain()} {offending(kind, rnd)} {plain()}", kind)
        for _ in range(6):
            add(f"{plain()} {plain()}", "clean")
    return spark.createDataFrame(documents, "doc_id BIGINT, text STRING, source STRING, abusive DOUBLE"), spark.createDataFrame(reviews, "doc_id BIGINT, verdict STRING")


@pytest.fixture(scope="module")
def fitted(spark):
    return O.fit(*labelled(spark))


def kinds_of(fitted, text):
    learned, models = fitted
    x = np.array([O.Features(learned).of(text)])
    return {k for k, m in models.items() if m.probability(x)[0] >= O.THRESHOLD}


HELD_OUT = [
    ("Wretched people like you are idiots, you scumbag.", {"abusive"}), ("WHAT A B4STARD YOU ARE.", {"abusive"}), ("You p a t h e t i c  i d i o t.", {"abusive"}), ("You b*****d, you moron.", {"abusive"}),
    ("Ausländer sind Ungeziefer und gehören raus.", {"hateful"}), ("Refugees are vermin and thieves.", {"hateful"}), ("Uncensored h​ardcore p0rn, horny and nude.", {"sexual"}),
    ("An idiot-proof form helps.", set()), ("Refugees take part in courses.", set()), ("", set()), (None, set()), ("   ", set()), ("The board reviewed the plan. " * 5_000, set()),
]


@pytest.mark.parametrize(("text", "want"), HELD_OUT)
def test_held_out(fitted, text, want):
    assert kinds_of(fitted, text) == want


def test_one_sentence_in_a_long_report_counts(fitted):
    assert kinds_of(fitted, "The board reviewed the plan. " * 2_000 + "You filthy bastard, you idiot. " + "The plan was approved. " * 2_000) == {"abusive"}


def test_no_sentence_of_the_tables_in_the_code(small):
    """Neither a pattern nor a word list holds four words or more that follow each other in a test table."""
    duckdb = pytest.importorskip("duckdb")
    larger = small.replace("sf0.001", "sf0.1")
    folder = larger if os.path.isdir(larger) else small
    every = "\n".join(t.lower() for (t,) in duckdb.sql(f"SELECT DISTINCT text FROM '{folder}/documents.parquet' WHERE text IS NOT NULL").fetchall())
    tree = ast.parse(inspect.getsource(O))
    docs = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef)) and n.body and isinstance(n.body[0], ast.Expr)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and id(node) not in docs:
            words = node.value.lower().split()
            runs = {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}
            assert not [r for r in runs if r in every]


def test_held_out_reviews(spark):
    """Half of the reviews teach, the other half tests; the labels of the tables are noisy."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    documents, reviews = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/abuse_reviews.parquet")
    found = O.found(documents, reviews.where("doc_id % 2 = 0"))
    judged = reviews.where("doc_id % 2 = 1 AND verdict IN ('abusive', 'sexual', 'clean')").dropDuplicates(["doc_id"])
    hit = {(r.doc_id, r.kind) for r in found.collect()}
    right = [((r.doc_id, r.verdict) in hit) if r.verdict != "clean" else not any(d == r.doc_id for d, _ in hit) for r in judged.collect()]
    assert np.mean(right) > 0.85


def test_boosting_learns_and_calibration_is_monotone():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 5, (600, 3)).astype(float)
    y = ((x[:, 0] >= 3) ^ (rnd.random(600) < 0.1)).astype(float)
    model = O.Boosted().fit(x, y, np.ones(600))
    score = model.score(x)
    assert ((score > 0) == (x[:, 0] >= 3)).mean() > 0.97
    knots, values = O.isotonic(score, y, np.ones(600))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= -1e-12).all() and 0 <= values.min() <= values.max() <= 1


def test_isotonic_against_definition():
    score, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    knots, values = O.isotonic(score, y, np.ones(5))
    assert np.allclose(np.interp(score, knots, values), [0, 0.5, 0.5, 1, 1])


def test_learned_words_and_windows():
    learned = O.learn_words({"vile": {"abusive": 30, "clean": 1}, "plan": {"abusive": 20, "clean": 200}, "rare": {"abusive": 2}}, {"abusive": 40, "clean": 400})
    assert set(learned) == {"vile"} and learned["vile"][0] > 2 and learned["vile"][1:] == (0, 0)
    assert O._near([5, 90], [94], 4) and not O._near([5, 90], [95], 4) and not O._near([1], [], 9)
    assert O._densest([1, 2, 3, 50, 60, 70, 80], 20) == 3
    both = O.Features({"vile": (2.0, 0, 0), "worse": (3.0, 0, 0)})
    at = lambda text: dict(zip(O.FEATURES, both.of(text)))["learned_abusive_sum"]
    assert at("vile vile worse") == 5 and at("vile " + "x " * 40 + "worse") == 3


def test_reviews_of_a_document_share_a_fold():
    assert {O.fold_of(d) for d in range(1_000)} == set(range(O.FOLDS)) and O.fold_of(7) == O.fold_of(7)


def test_tables(spark):
    documents, reviews = labelled(spark)
    more = spark.createDataFrame([(9001, None, None, 0.5), (9002, "", "t", 0.5), (9003, "You filthy bastard.", "t", 0.5), (9003, "You filthy bastard.", "t", 0.5)], documents.schema)
    odd = spark.createDataFrame([(1, "unsure"), (99_999, "hateful"), (9001, None), (9001, "clean"), (0, "clean")], reviews.schema)
    documents, reviews = documents.unionByName(more), reviews.unionByName(odd)
    got = rows(O.found(documents, reviews))
    assert (9003, "abusive") in got and len(set(got)) == len(got) and not {d for d, _ in got} & {9001, 9002}
    rates = {r.source: r for r in O.source_rates(documents, reviews).collect()}
    assert rates["t"].n_documents == 3 and abs(rates["t"].abusive_rate - 2 / 3) < 1e-9 and rates[None].any_rate == 0.0
    assert O.found(documents.limit(0), reviews).count() == 0 and O.found(documents, reviews.limit(0)).count() == 0
    assert O.found(documents, reviews.where("verdict = 'clean'")).count() == 0
