"""Defective answers among passage-answer pairs.

Each answer gets at most one defect, tested in this order:

- ``empty``: no words once markup and closed think tags are set aside, and the reasoning does not end in an answer
  either;
- ``refusal``: it declines the task, by a dictionary of declining phrases per language;
- ``copied``: it only gives back its passage. The folded answer is compressed with the folded passage as a raw
  zstandard dictionary: text that the passage holds shrinks to references. An exact check follows: the
  words that the compressed form can take from the passage, in runs of five;
- ``truncated``: its terminal context is incomplete: an open think tag or fence, an edge without its right side or with the
  beginning of a concept name there, or a last line that is neither an edge, NONE, a finished
  sentence nor one of the manners of closing that the model of terminal contexts has learned from all answers (last lines without terminal punctuation
  that make up a set share of all such lines, as for cut-off values);
- ``other_language``: its prose (without edges, quotations, concept names and closed think tags) is in another language than the passage, by function-word
  dictionaries; the character trigrams of the prose must bear it out, by profiles fitted on the passages.

Scale: the last lines of the answers are counted once (hashed, combined map-side); the learned closings, at most 1 / share of them,
are broadcast. Answers meet their passage in one equi-join on the folded excerpt id, split by AQE's skew
join where one excerpt holds very many answers; only the last line of the reasoning
travels. The rest is one Arrow pass. Passages are folded once per batch, their dictionaries built only for answers long enough to be a
copy.

Defined results: rows with an error or a raw output are no pairs; a null answer is empty text; without a passage (null or
unknown excerpt id, null text) nothing is a copy, without a language nothing is in another
one; of passages with one folded id the first by id and text counts; repeated rows are each judged; very long answers are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.cutoff import CLOSING_LEAST, CLOSING_SHARES, CONTINUED, TERMINAL, trimmed
from causeway.sources.checkpoints import cut_lineage

#: Articles, pronouns, prepositions, conjunctions, auxiliaries and common adverbs, which tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is in that for with as by it was are this which from an be or not at there any no but has have had were been they their its"
    " these those what who when where than then into about between only also does did can could would should will such each other one",
    "de": "der die das und ist zu den von mit dem des ein eine einen einer eines im für als auf nicht sich wird auch zwischen wurde wurden kein keine keinen"
    " nur am an bei nach zum zur aus durch über unter vor weil wodurch sodass was wie dass es er sie wir sind war hat haben werden kann aber oder wenn noch",
    "fr": "le la les et est des du une un dans que pour qui par sur au aux ne pas ce cette ces avec se sont il elle ils nous vous leur"
    " aucun aucune entre deux selon puis comme à ensuite car a été être mais ou où donc plus sans sous dont lui même tout seulement",
    "es": "el la los las y es de que en un una por con para se del al no como su sus lo más entre sólo solo ninguna ninguno según"
    " primero después ha han porque pero o este esta estos estas ese esa son fue ser está muy sin sobre también cuando donde",
}
#: Phrases that decline a task.
REFUSALS = (
    r"\bi(?:'m| am)? (?:can't|cannot|can not|won't|will not|(?:am |'m )?unable to|(?:am |'m )?not (?:able|allowed|permitted) to|won't be able to|must decline|have to decline|decline to|refuse to|would rather not|do not feel comfortable|don't feel comfortable)\b(?! (?:find|see|identify|detect|treat|spot))",
    r"\bi'd rather not\b", r"\bi(?:'m| am) (?:very )?sorry, but i\b", r"\b(?:isn't|is not|not) possible for me to\b",
    r"\bguidelines (?:prevent|forbid|do not allow|don't allow)\b", r"\boutside of what i am allowed\b",
    r"\b(?:conflicts with|against|violates?) my (?:usage )?(?:polic|guideline|rule|instruction)", r"\bas an ai\b.{0,40}\b(?:not able|unable|cannot|can't)\b",
    r"\bno answer is (?:possible|given|available|provided)\b", r"\bwithout violating\b", r"\bnot comfortable\b",
    r"\b(?:darf|kann|möchte|werde) (?:ich|diese\w*|dies|das)\b.{0,60}\bnicht\b", r"\bnicht (?:beantworten|helfen|erlaubt|gestattet|bearbeiten|in der lage)\b",
    r"\bich (?:darf|kann|möchte|muss)\b.{0,60}\b(?:nicht|ablehnen)\b", r"\b(?:lehne|verweigere)\b.{0,30}\bab\b", r"\btut mir leid\b",
    r"\bje ne (?:peux|suis|dois|souhaite|veux)\b", r"\bje (?:refuse|décline|regrette)\b", r"\bdésolée?\b", r"\bne (?:me permettent|m'est) pas\b", r"\bm'(?:est impossible|interdi\w+)\b",
    r"\bne puis\b", r"\bno (?:puedo|podré|debo|me es posible|me está permitido|estoy autorizad)\b", r"\blo siento\b", r"\blamento\b", r"\bme niego\b", r"\bprefiero no\b",
    r"\b(?:no|ne|n') ?me (?:permit|autoris)\w+\b", r"\berlauben (?:es )?mir nicht\b",
)

#: An answer must be at least this share of its passage to give most of it back.
COPY_SHARE = 0.3
#: Compressed size over plain size, with the passage as dictionary, up to which an answer may be a copy.
COPY_RATIO = 0.45
#: Share of the answer's words that must come from the passage in runs of RUN words.
COPY_WORDS, RUN = 0.8, 5
#: Language evidence: at least so many function words, and more by so many than the passage's language has.
LANGUAGE_LEAST, LANGUAGE_LEAD = 2, 2

_CLOSED_THINK = re.compile(r"<(think|thinking|thought|reasoning)>.*?</\1>", re.S | re.I)
_OPEN_THINK = re.compile(r"<(?:think|thinking|thought|reasoning)>(?!.*</)", re.S | re.I)
_TAG = re.compile(r"</?\w+/?>")
_WORD = re.compile(r"[^\W_]+")
_PROSE_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»")
_ARROW = re.compile(r"(?:->|→)")
_NONE = re.compile(r"\W*(?:final\s*:|answer\s*:|final answer\s*:)?\W*none\W*$", re.I)
_TERMINAL = re.compile(r"[.!?。…]+[\"”’')\]»*_`]*\s*[^\w\s.,;:\-(\[{<\"'“„«]*$")
_CONTINUED = re.compile(rf"(?:^|[\s(])(?:{'|'.join(re.escape(a) for a in CONTINUED)})\.$", re.I)
_REFUSAL = re.compile("|".join(REFUSALS), re.I | re.S)
_LANGUAGE = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words.split()}
for _w in {w for w in _LANGUAGE if sum(w in v.split() for v in FUNCTION_WORDS.values()) > 1}:
    del _LANGUAGE[_w]


class Judge:
    """Labels answers; ``names`` are the concept names and aliases, ``profiles`` those of the languages."""

    def __init__(self, names: list[str], profiles: dict[str, dict[str, float]] | None = None):
        self.profiles = profiles or {}
        own = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
        self.names = re.compile("|".join(map(re.escape, own)) or r"(?!)", re.I)
        self.beginnings: set[str] = set()
        whole = {n.lower() for n in own}
        for n in own:
            self.beginnings |= {n[:k].strip().lower() for k in range(1, len(n) - 1)} - whole
        self.beginnings.discard("")

    def ends_cut(self, text: str, closes: bool = False) -> bool:
        """Whether the terminal context of a stripped, non-empty answer is incomplete; ``closes``: its last line is a learned closing."""
        if _OPEN_THINK.search(text) or text.count("```") % 2:
            return True
        line = text[text.rfind("\n") + 1 :].strip()
        arrows = list(_ARROW.finditer(line))
        if arrows:
            right = line[arrows[-1].end() :].strip()
            bare = right.strip(" *_`<>[](){}\"'“”")
            return not bare or right.lower() in self.beginnings
        if closes or _NONE.match(line) or re.match(r"(?:</\w+>|```)$", line):
            return False
        return not _TERMINAL.search(line) or bool(_CONTINUED.search(line))

    def prose(self, text: str) -> str:
        """What is said in the answer's own words."""
        lines = [x for x in text.split("\n") if not _ARROW.search(x) and not _NONE.match(x)]
        return self.names.sub(" ", _TAG.sub(" ", _QUOTED.sub(" ", "\n".join(lines))))

    def language_of(self, text: str, expected: str) -> str | None:
        """The language of the prose if it is clearly another than ``expected``: by function words, and by character trigrams where both have a profile."""
        count = dict.fromkeys(FUNCTION_WORDS, 0)
        prose = self.prose(text).lower().replace("’", "'")
        for w in _PROSE_WORD.findall(prose):
            lang = _LANGUAGE.get(w)
            if lang is None and "'" in w:
                lang = "fr" if w[:2] in ("d'", "l'", "n'", "s'", "c'") or w[:3] == "qu'" else None
            if lang:
                count[lang] += 1
        best = max(count, key=lambda k: (count[k], k))
        if best == expected or count[best] < LANGUAGE_LEAST or count[best] < count.get(expected, 0) + LANGUAGE_LEAD:
            return None
        other, own = self.profiles.get(best), self.profiles.get(expected)
        if other and own and sum(other.get(g, other[""]) - own.get(g, own[""]) for g in _trigrams(prose)) <= 0:
            return None
        return best

    def is_copy(self, text: str, passage: "Passage") -> bool:
        words = _WORD.findall(text.lower())
        folded = " ".join(words)
        if len(folded) < COPY_SHARE * len(passage.folded) or passage.squeezed(folded) > COPY_RATIO:
            return False
        runs, covered, until = passage.runs(), 0, 0
        for i in range(len(words) - RUN + 1):
            if tuple(words[i : i + RUN]) in runs:
                covered += i + RUN - max(i, until)
                until = i + RUN
        return covered >= COPY_WORDS * len(words)

    def defect(self, answer: str | None, reasoning_end: str | None, passage: "Passage | None", lang: str | None, closes: bool = False) -> str | None:
        text = (answer or "").strip()
        own = _CLOSED_THINK.sub(" ", text) if "<" in text else text
        if not _WORD.search(_TAG.sub(" ", own)):
            end = (reasoning_end or "").strip()
            return None if answered(end) else "empty"
        own = own.strip()
        line = own[own.rfind("\n") + 1 :]
        answered_here = bool(_ARROW.search(line)) or bool(_NONE.match(line))
        if not answered_here and _REFUSAL.search(self.names.sub(" ", own).replace("’", "'")):
            return "refusal"
        if passage is not None and self.is_copy(own, passage):
            return "copied"
        if self.ends_cut(own, closes):
            return "truncated"
        if lang and ("\n" in own or not answered_here) and self.language_of(own, lang):
            return "other_language"
        return None


def answered(line: str) -> bool:
    """Whether a last line of reasoning is an answer."""
    arrow = list(_ARROW.finditer(line))
    return bool(arrow and line[arrow[-1].end() :].strip() and line[: arrow[0].start()].strip()) or bool(
        re.match(r"\W*(?:final|answer|final answer)\s*:\W*none\W*$|none\W*$", line, re.I)
    )


class Passage:
    """A passage and what answers are compared with."""

    def __init__(self, text: str):
        self.words = _WORD.findall(text.lower())
        self.folded = " ".join(self.words)
        self._compressor = self._runs = None

    def squeezed(self, folded: str) -> float:
        """Compressed over plain size of a folded answer with the passage as raw dictionary."""
        if self._compressor is None:
            own = zstandard.ZstdCompressionDict(self.folded.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._compressor = zstandard.ZstdCompressor(
                level=3, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False
            )
        data = folded.encode()
        return len(self._compressor.compress(data)) / max(1, len(data))

    def runs(self) -> set[tuple[str, ...]]:
        if self._runs is None:
            self._runs = {tuple(self.words[i : i + RUN]) for i in range(len(self.words) - RUN + 1)}
        return self._runs


def _key(column: str):
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def last_lines(results: DataFrame) -> DataFrame:
    """``row_id, __form``: the hashed last line of each answer that ends without terminal punctuation and without arrow, null for others; and its ``first_word``."""
    line = F.lower(F.trim(F.substring_index(trimmed(F.col("raw_response")), "\n", -1)))
    plain = (line != "") & ~line.contains("->") & ~line.contains("→") & ~line.rlike(TERMINAL)
    return results.where("error IS NULL AND raw_output IS NULL").select(
        "*", F.when(plain, F.xxhash64(line)).alias("__form"), F.substring_index(line, " ", 1).alias("__first_word")
    )


def closings_of(answers: DataFrame) -> DataFrame:
    """``__form`` of each last line that is a manner of closing: it makes up a set share of all without terminal punctuation.

    A single word that more last lines begin with, written further, is none: it is that word cut off.
    """
    counted = cut_lineage(answers.groupBy("__form", "__first_word").agg(F.count(F.lit(1)).alias("n")))
    plain = counted.where("__form IS NOT NULL")
    least = F.greatest(F.lit(CLOSING_LEAST), CLOSING_SHARES["line"] * plain.agg(F.sum("n")).scalar())
    often = plain.where(F.col("n") >= least)
    words = counted.where("length(__first_word) > 1").groupBy("__first_word").agg(F.sum("n").alias("n_word"))
    begun = words.select("n_word", F.explode(F.expr("transform(sequence(1, length(__first_word) - 1), k -> xxhash64(left(__first_word, k)))")).alias("__form"))
    begun = begun.groupBy("__form").agg(F.max("n_word").alias("n_word"))
    return often.join(begun, "__form", "left").where(F.coalesce("n_word", F.lit(0)) <= F.col("n")).select("__form")


#: Most passages that the language profiles are fitted on, and least uses of a trigram in them.
PROFILE_PASSAGES, PROFILE_LEAST = 1_000, 3


def _trigrams(text: str) -> Iterator[str]:
    for word in _PROSE_WORD.findall(text.lower()):
        padded = f" {word} "
        yield from (padded[i : i + 3] for i in range(len(padded) - 2))


def language_profiles(excerpts: DataFrame) -> dict[str, dict[str, float]]:
    """Per language of the passages, the log probability of each character trigram; "" has that of an unknown one.

    Fitted on at most ``PROFILE_PASSAGES`` passages in hash order.
    """
    sample = excerpts.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").orderBy(F.xxhash64("text"), "lang").limit(PROFILE_PASSAGES)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: Counter = Counter()
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                counted.update((lang, g) for g in _trigrams(text))
        yield pd.DataFrame([(*k, n) for k, n in counted.items()], columns=["lang", "gram", "n"])

    grams = sample.mapInPandas(batches, "lang STRING, gram STRING, n BIGINT").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, float]] = {}
    for r in grams.where(F.col("n") >= PROFILE_LEAST).collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    for own in out.values():
        every = sum(own.values())
        own.update({g: math.log(n / every) for g, n in own.items()})
        own[""] = math.log(1 / every)
    return out


def defects(results: DataFrame, excerpts: DataFrame, names: list[str]) -> DataFrame:
    """``row_id, defect`` of each defective pair."""
    judge = Judge(names, language_profiles(excerpts))
    end = F.substring_index(F.regexp_replace("raw_thinking", r"(?U)\s+$", ""), "\n", -1)
    answers = last_lines(results.select("row_id", "excerpt_id", "raw_response", "raw_thinking", "error", "raw_output"))
    closings = F.broadcast(closings_of(answers).withColumn("closes", F.lit(True)))
    answers = answers.join(closings, "__form", "left").select(
        "row_id", _key("excerpt_id").alias("__excerpt"), "raw_response", end.alias("reasoning_end"), "closes"
    )
    passages = (
        excerpts.where("excerpt_id IS NOT NULL")
        .groupBy(_key("excerpt_id").alias("__excerpt"))
        .agg(F.min(F.struct("excerpt_id", "text", "lang")).alias("first"))
        .select("__excerpt", F.col("first.text").alias("passage"), F.col("first.lang").alias("passage_lang"))
    )

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[str, Passage] = {}
            out = []
            for row_id, answer, reasoning_end, text, lang, closes in zip(
                frame["row_id"], frame["raw_response"], frame["reasoning_end"], frame["passage"], frame["passage_lang"], frame["closes"]
            ):
                passage = None
                if isinstance(text, str) and isinstance(answer, str):
                    passage = known.get(text) or known.setdefault(text, Passage(text))
                found = judge.defect(
                    answer if isinstance(answer, str) else None,
                    reasoning_end if isinstance(reasoning_end, str) else None,
                    passage,
                    lang if isinstance(lang, str) else None,
                    closes is True,
                )
                if found:
                    out.append((row_id, found))
            yield pd.DataFrame(out, columns=["row_id", "defect"])

    joined = answers.join(passages, "__excerpt", "left")
    return joined.select("row_id", "raw_response", "reasoning_end", "passage", "passage_lang", "closes").mapInPandas(
        batches, "row_id BIGINT, defect STRING"
    )


def defect_rates(results: DataFrame, excerpts: DataFrame, names: list[str]) -> DataFrame:
    """Per model: pairs, and pairs of each defect."""
    found = defects(results, excerpts, names)
    rows = results.where("error IS NULL AND raw_output IS NULL").select("row_id", F.coalesce(_key("model"), F.lit("")).alias("model"))
    return (
        rows.join(found, "row_id", "left")
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            *[
                F.count_if(F.coalesce(F.col("defect") == d, F.lit(False))).alias(f"n_{d}")
                for d in ("empty", "refusal", "copied", "truncated", "other_language")
            ],
        )
    )
