"""Freely typed values mapped to the entries of a canonical list.

First a multi-pattern automaton over the canonical names and their aliases (also written as one word) finds mentions
embedded in the folded value, at word boundaries; of overlapping mentions the longest wins, and of
the mentions that remain the longest decides (then the first). Values without a mention go to
token-set similarity: words are compared as a set, each word matching a word of a name if it is
equal, within a few edits (insertion, deletion, replacement, swap of neighbours), or its
abbreviation written with a full stop; a name is meant if every word of it is matched and no content word of the value is left
over. Which words may be meant is looked up among what is left of them after as many deletions as edits are tolerated,
so a word is compared with few words of the list, however long that is. Codes count only as the whole value. Values that match nothing get -1.

Folding undoes what typing and transport do: compatibility forms, look-alike letters of other
scripts, mis-decoded UTF-8, accents, invisible characters, joined and punctuated words.

Scale: one Arrow pass, no shuffle. The canonical list is a dimension and travels with the task: more than ``MAX_ENTRIES``
entries are an error. Values and words are remembered per worker in bounded caches,
so a value typed in a third of all rows is resolved once per worker.

Defined results: null and blank values are no cases; values that are a canonical name character
for character are no cases in ``resolve_unlisted``; entries without aliases or code have none;
two concepts that match equally well give the lower id; very long values are read whole; an
empty canonical list gives -1 throughout.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНαορτυικνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHaoptuikvABEZHIKMNOPTYX")

#: Function words, which do not change the concept that is meant.
FUNCTION_WORDS = frozenset("a an and as at by for from in into its of on or our s that the their these this those to with".split())

#: Most entries of a canonical list.
MAX_ENTRIES = 200_000
MAX_CACHED = 100_000
_MISDECODED = re.compile("[Â-Å][\u0080-¿]")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+\.?")


def fold(value: str) -> str:
    """The value in lower-case Latin letters; punctuation stays."""
    value = _MISDECODED.sub(lambda m: m[0].encode("latin-1").decode("utf-8", "replace") if ord(m[0][0]) < 256 else m[0], value)
    value = unicodedata.normalize("NFKC", _INVISIBLE.sub("", value)).translate(LOOKALIKES)
    if not re.search(r"[\s_/-]", value.strip()):
        value = _CAMEL.sub(" ", value)
    value = unicodedata.normalize("NFD", value.lower())
    return "".join(c for c in value if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, swaps of neighbours counting one; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletions(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` of its letters.

    Two words within n edits, a swap of neighbours counting one, have a form with n deletions each in common.
    """
    found, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


#: Edits tolerated in any word of a name.
MOST_EDITS = 2


def allowed_edits(word: str) -> int:
    """Edits tolerated in a word of a name."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else MOST_EDITS


class Resolver:
    """Resolves values against ``entries`` of (id, name, code, aliases)."""

    def __init__(self, entries: list[tuple[int, str, str | None, list[str]]]):
        self.codes: dict[str, int] = {}
        self.names: dict[str, int] = {}
        for key, name, code, aliases in sorted(entries):
            if code:
                self.codes.setdefault(re.sub("[^a-z0-9]", "", fold(code)), key)
            for text in (name, *aliases):
                words = " ".join(w.rstrip(".") for w in _WORD.findall(fold(text)))
                if words:
                    self.names.setdefault(words, key)
        self.automaton = ahocorasick.Automaton()
        for words, key in self.names.items():
            self.automaton.add_word(f" {words} ", (len(words), key))
        for words, key in self.names.items():
            glued = words.replace(" ", "")
            if f" {glued} " not in self.automaton:
                self.automaton.add_word(f" {glued} ", (len(words), key))
        if self.names:
            self.automaton.make_automaton()
        self.content = [([w for w in n.split() if w not in FUNCTION_WORDS] or n.split(), key) for n, key in self.names.items()]
        self.vocabulary = sorted({w for words, _ in self.content for w in words})
        self.longest = max(map(len, self.vocabulary), default=0)
        self.by_deletion: dict[str, list[str]] = {}
        for w in self.vocabulary:
            for left in deletions(w, allowed_edits(w)):
                self.by_deletion.setdefault(left, []).append(w)
        self.holders: dict[str, list[int]] = {}
        for i, (words, _) in enumerate(self.content):
            for w in words:
                self.holders.setdefault(w, []).append(i)
        self.near: dict[str, dict[str, int]] = {}
        self.known: dict[str, int] = {}

    def mention(self, text: str) -> int | None:
        """The concept of the longest of the longest non-overlapping mentions."""
        if not self.names:
            return None
        found = [(length, -end, key) for end, (length, key) in self.automaton.iter(f" {text} ")]
        return max(found)[2] if found else None

    def near_words(self, word: str) -> dict[str, int]:
        """Vocabulary words that ``word`` may mean, with the edits between; a final full stop marks an abbreviation."""
        got = self.near.get(word)
        if got is None:
            bare, got = word.rstrip("."), {}
            if len(bare) <= self.longest + MOST_EDITS:
                for w in {w for left in deletions(bare, MOST_EDITS) for w in self.by_deletion.get(left, ())}:
                    n = edits(bare, w, allowed_edits(w))
                    if n <= allowed_edits(w):
                        got[w] = n
            if word[-1] == "." and len(bare) >= 3:
                for w in self.vocabulary[bisect_left(self.vocabulary, bare) :]:
                    if not w.startswith(bare):
                        break
                    got.setdefault(w, 1)
            if len(self.near) < MAX_CACHED:
                self.near[word] = got
        return got

    def similar(self, words: list[str]) -> int | None:
        """The concept whose name has the same set of words, give or take a few edits."""
        options = [self.near_words(w) for w in words]
        must = [o for w, o in zip(words, options) if w.rstrip(".") not in FUNCTION_WORDS and not w.rstrip(".").isdigit()]
        if not must or not all(must):
            return None
        best: tuple[int, int] | None = None
        for i in {i for o in must for w in o for i in self.holders[w]}:
            name, key = self.content[i]
            if len(name) != len(must):
                continue
            cost, left = 0, list(must)
            for w in name:
                fit = min((o for o in left if w in o), key=lambda o: o[w], default=None)
                if fit is None:
                    break
                cost += fit[w]
                left.remove(fit)
            else:
                if best is None or (cost, key) < best:
                    best = (cost, key)
        return None if best is None else best[1]

    def resolve(self, value: str) -> int:
        got = self.known.get(value)
        if got is None:
            words = _WORD.findall(fold(value))
            bare = [w.rstrip(".") for w in words]
            while len(bare) > 1 and (bare[0].isdigit() or len(bare[0]) == 1 and words[0] == bare[0] and len(bare[1]) > 1):
                words, bare = words[1:], bare[1:]  # list marks
            got = self.mention(" ".join(bare))
            if got is None:
                got = self.codes.get("".join(bare))
            if got is None:
                got = self.similar(words)
            got = -1 if got is None else got
            if len(self.known) >= MAX_CACHED:
                self.known.clear()
            self.known[value] = got
        return got


def read_entries(concepts: DataFrame) -> list[tuple[int, str, str | None, list[str]]]:
    """The canonical list, a dimension of at most ``MAX_ENTRIES`` entries."""
    entries = concepts.select("concept_id", "label", "code", "alt_names").where("concept_id IS NOT NULL AND label IS NOT NULL")
    rows = entries.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries in the canonical list")
    return [(r[0], r[1], r[2], [a for a in (r[3] or []) if a]) for r in rows]


def resolve_column(df: DataFrame, concepts: DataFrame, value: str = "value", out: str = "concept_id") -> DataFrame:
    """``df`` with the id of the concept that ``value`` means, -1 if none of the list."""
    resolver = Resolver(read_entries(concepts))
    fields = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` INT"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: [resolver.resolve(v) if isinstance(v, str) else -1 for v in frame[value]]})

    return df.select(*[f.name for f in fields]).mapInPandas(batches, schema)


def typed_values(results: DataFrame) -> DataFrame:
    """``row_id, side, value`` of every value that was typed."""
    sides = F.array(
        F.struct(F.lit("cause").alias("side"), F.col("predicted_cause").alias("value")),
        F.struct(F.lit("effect").alias("side"), F.col("predicted_effect").alias("value")),
    )
    return results.select("row_id", F.inline(sides)).where(F.col("value").rlike(r"(?U)\S"))


def resolve_unlisted(results: DataFrame, concepts: DataFrame) -> DataFrame:
    """``row_id, side, concept_id`` of the typed values that are no canonical name as they stand."""
    labels = [r[1] for r in read_entries(concepts)]
    values = typed_values(results)
    if labels:
        values = values.where(~F.col("value").isin(labels))
    return resolve_column(values, concepts).select("row_id", "side", "concept_id")


def value_report(results: DataFrame, concepts: DataFrame) -> DataFrame:
    """Every distinct typed value with its concept (-1: unmatched) and how often it was typed."""
    counted = typed_values(results).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return resolve_column(counted, concepts)
