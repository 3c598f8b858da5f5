import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import bpe
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZER_DIR, bpe.VOCABULARY)), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bpe.read_ranks(bpe.read_vocabulary())
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_same_ids_and_round_trip(text):
    tiktoken = pytest.importorskip("tiktoken")
    codec = bpe.Codec(bpe.read_vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    global _reference
    try:
        own = _reference
    except NameError:
        own = _reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    (ids,) = codec.encode_batch([text])
    assert ids == own.encode_ordinary(text) and codec.decode(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|> x", " " * 3000, "a" * 30_000, "日本語" * 500, "\u0000\r\n\t ", "don't WE'LL", "é́‍🏽", "x y"])
def test_hard_texts(reference, text):
    codec = bpe.Codec(bpe.read_vocabulary())
    assert codec.encode_batch([text])[0] == reference.encode_ordinary(text)


def test_cache_overflow_changes_nothing(monkeypatch):
    codec = bpe.Codec(bpe.read_vocabulary())
    texts = [f"word{i} other {i % 7}" for i in range(200)]
    want = codec.encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "CACHE_LENGTH", 4)
    small = bpe.Codec(bpe.read_vocabulary())
    assert [small.encode_batch([t])[0] for t in texts] == want and small.encode_batch(texts) == want


def test_table(spark):
    df = spark.createDataFrame([(1, None, [9]), (2, "", [9]), (3, " ", [9]), (3, " ", [9]), (4, "hi there", [9])], "doc_id BIGINT, text STRING, ids ARRAY<INT>")
    got = bpe.encode(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[1] == [] and by[2] == [] and len(by[3]) == 1 and got.count() == 5
    assert dict(rows(bpe.decode(got)))[4] == "hi there"
    assert bpe.encode(df.limit(0)).count() == 0
    counts = bpe.token_counts(df.drop("ids"))
    assert rows(counts) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 2)]


def test_executors_need_no_vocabulary_file(spark, tmp_path):
    """The folder is gone when the tasks run."""
    (tmp_path / bpe.VOCABULARY).write_bytes(bpe.read_vocabulary())
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id BIGINT, text STRING")
    encoded = bpe.encode(df, directory=str(tmp_path))
    (tmp_path / bpe.VOCABULARY).unlink()
    assert {r.doc_id: len(r.ids) for r in encoded.collect()} == {1: 2, 2: 0}
