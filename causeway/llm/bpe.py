"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The vocabulary is serialised directly as a sentencepiece BPE model: one piece per token, its
bytes mapped to printable characters, scored by its negative rank, with identity normalisation
and nothing added or removed. sentencepiece then merges, within a pre-token, always the
adjacent pair whose concatenation has the lowest rank, which is byte-level BPE. Texts are cut
into pre-tokens by the vocabulary's published pattern; each distinct pre-token of a batch is
encoded once and remembered per worker in a bounded cache, so natural text costs little more
than the cut. Decoding inverts the byte mapping.

Scale: one Arrow pass over ``(key, text)``, no shuffle, no state beyond the cache. The vocabulary file is read by
the driver and broadcast (about 1 MB, more than ``MOST_BYTES`` is an error), so executors need no copy; each worker builds its model once.

Defined results: empty and null texts have the empty list; white space is text like any other;
strings that look like special tokens are ordinary text; lone surrogates cannot occur in Spark
strings; rows repeated keep their own row; very long texts and pre-tokens are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame

#: Folder of the public tokenizer files.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens remembered per worker; longer ones are never remembered.
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 64
#: Size of a vocabulary file at most.
MOST_BYTES = 64 << 20
#: Rows encoded and returned at a time.
BATCH_ROWS = 1000


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of the content of a rank file, by rank."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary; piece ids are the ranks, the unknown piece comes last."""
    import struct

    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    unknown = _field(1, b"<unknown>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2)
    out += _field(1, unknown)
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(40, len(tokens))
    # BPE, size, and the ids of <unk>, <s>, </s>, <pad>: only the first exists
    trainer += b"".join(_varint(n << 3) + b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01" for n in (41, 42, 43))
    trainer += _flag(24, 0)  # treat_whitespace_as_suffix
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encoder and decoder over the content of one vocabulary file."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.tokens = read_ranks(data)
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.is_token = {t: i for i, t in enumerate(self.tokens)}

    def _letters_of(self, pre_token: str) -> str:
        return pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cuts = [self.cut.findall(t) if t else [] for t in texts]
        known = self.known
        fresh = list({w for words in cuts for w in words if w not in known})
        if fresh:
            got = dict(zip(fresh, self.model.encode([self._letters_of(w) for w in fresh], out_type=int, num_threads=1)))
            if len(known) + len(got) > CACHE_ENTRIES:
                known = {}
                fresh_again = list({w for words in cuts for w in words if w not in got})
                if fresh_again:
                    got |= zip(fresh_again, self.model.encode([self._letters_of(w) for w in fresh_again], out_type=int, num_threads=1))
                self.known = {w: ids for w, ids in got.items() if len(w) <= CACHE_LENGTH}
                look = got
            else:
                known.update((w, ids) for w, ids in got.items() if len(w) <= CACHE_LENGTH)
                look = known if len(got) == sum(len(w) <= CACHE_LENGTH for w in got) else {**got, **known}
        else:
            look = known
        return [[i for w in words for i in look[w]] for words in cuts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def read_vocabulary(directory: str | None = None, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(directory or TOKENIZER_DIR, name), "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"vocabulary of more than {MOST_BYTES} bytes")
    return data


def codec_for(df: DataFrame, directory: str | None) -> Callable[[], Codec]:
    """What gives a task its codec: one per worker process and vocabulary, made of the broadcast file."""
    data = read_vocabulary(directory)
    name, held = xxhash.xxh3_128_hexdigest(data), df.sparkSession.sparkContext.broadcast(data)

    def own() -> Codec:
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = Codec(held.value)
        return _CODECS[name]

    return own


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row."""
    codec = codec_for(documents, directory)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for frame in frames:
            for at in range(0, len(frame), BATCH_ROWS):
                part = frame.iloc[at : at + BATCH_ROWS]
                yield pd.DataFrame({key: part[key], "ids": own.encode_batch(part[text].tolist())})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(batches, f"`{key}` {kind}, ids ARRAY<INT>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", directory: str | None = None) -> DataFrame:
    """``key`` and ``text`` of every row of ids; the inverse of ``encode`` but for null texts."""
    codec = codec_for(encoded, directory)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "text": [own.decode(list(x)) for x in frame[ids]]})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInPandas(batches, f"`{key}` {kind}, text STRING")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens BIGINT`` of every row, without shipping the ids."""
    codec = codec_for(documents, directory)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for frame in frames:
            for at in range(0, len(frame), BATCH_ROWS):
                part = frame.iloc[at : at + BATCH_ROWS]
                sizes = [len(x) for x in own.encode_batch(part[text].tolist())]
                yield part.drop(columns=[text]).assign(n_tokens=sizes)

    rest = [f for f in documents.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", n_tokens BIGINT"
    return documents.mapInPandas(batches, schema)
