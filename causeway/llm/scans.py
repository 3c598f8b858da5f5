"""Noise in text from scanned pages: located, and repaired into readable paragraphs.

Noisy-channel correction. The source model is a corpus n-gram model (words and word pairs counted
over all pages and paragraphs, and pairs of characters within words); the channel has a probability for each true letter or cluster and
what it was read as, estimated from the corpus' own usual misreadings. Words that
the channel can turn into each other share a *skeleton* (every character class and every
look-alike cluster such as rn/m or cl/d written one way), so the candidates of a token are the
lexicon words with its skeleton, found by one look-up. Each line with a suspicious token is decoded by
Viterbi over the candidates of its tokens; a token with digits or signs among its letters that no word explains is decoded by Viterbi over
its characters. A word belongs to the lexicon if it is frequent enough and
no word with its skeleton is many times more frequent (else it is a usual misreading of that word).

Running headers and page numbers are decided per report, from the lines at page edges: header-like
lines by skeleton without numbers, kept if they recur over the report's pages; number lines by
style and by the offset of printed to actual page. Words broken in two are told from hyphenated compounds by the
lexicon.

Scale: the counts are combined per task before the shuffle; lexicon and pairs have a bounded number of entries whatever the
corpus (``MOST_WORDS``, 1 / ``PAIR_SHARE``) and are broadcast. Edge
statistics are aggregates per report and key, joined to the rows by report (AQE splits hot reports); no report is ever
gathered in one task. Texts are shuffled once, for that join. A worker builds its look-ups once, not for each task.

Defined results: null and blank texts have no noise; carriage returns and trailing blanks do not count; pages without a report
have no running headers; a wrong or null method changes nothing; repeated rows are each judged; very
long lines are decoded whole; a corpus too small to know any word only yields what needs no lexicon;
empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.sources.checkpoints import cut_lineage

#: Words and pairs are kept from LEAST uses on. Where that leaves more words than MOST_WORDS, the bar doubles until it does not; pairs, which
#: only weigh candidates against each other, have to reach this share of all tokens too.
LEAST, MOST_WORDS, PAIR_SHARE = 4, 500_000, 1e-6
#: A word is a misreading of one with its skeleton that is so many times more frequent.
DOMINANCE = 8
#: A capitalised word is taken for a misreading only of words from this share on: rare names look like each other.
NAME_SHARE = 2e-5
#: Channel: probability of a confusion before anything is counted, and the weight of that prior in uses. Unknown words: probability of one.
CONFUSION, PRIOR, UNKNOWN = 1e-2, 50.0, 1e-9
#: Uses that smooth the character pairs; log probability of a digit that begins or goes on a number; least probability of a digit beside a letter.
SMOOTH, NUMBER, MIXED = 0.01, math.log(0.1), 1e-6
#: A header recurs on at least so many pages, and this share of its report's pages.
HEADER_LEAST, HEADER_SHARE = 3, 0.1
MAX_CACHED = 400_000

#: Classes of characters that recognition confuses, and clusters that look like one letter.
CLASSES = str.maketrans({"1": "i", "l": "i", "!": "i", "|": "i", "j": "i", "0": "o", "@": "a", "c": "e", "5": "s", "$": "s",
                         "6": "b", "8": "b", "h": "b", "9": "g", "q": "g", "2": "z", "f": "t", "7": "t", "+": "t", "3": "b", "4": "a"})
CLUSTERS = str.maketrans({"n": "ri", "m": "rri", "u": "ii", "d": "ei", "w": "vv"})
#: Letters read in the place of digits.
AS_DIGIT = str.maketrans("lI|iOoDSsBZzbgqA", "1111000558226994")
HYPHENS = "-‐¬­‑"
#: Sign or letter -> the letters and digits it may have been; follows from the tables.
MAY_BE = {chr(c): [t] + [chr(k) for k, v in CLASSES.items() if v == t and chr(k).isalpha() and k != c] for c, t in CLASSES.items()}
for _c, _d in AS_DIGIT.items():
    MAY_BE.setdefault(chr(_c).lower(), []).append(chr(_d))

_D = r"[0-9lIOSBZ]{1,4}"
#: Ways to print a page number alone on its line.
NUMBER_STYLES = (
    ("bare", rf"({_D})"),
    ("page", rf"(?:[Pp]ag[ec]|[Ss]eite|[Pp]ágina|[Pp]agina)\s+({_D})(?:\s*(?:of|0f|von|sur|de|/)\s*{_D})?"),
    ("short", rf"(?:p|pg|pp|P|S|pág)\.?\s*({_D})"),
    ("slash", rf"({_D})\s*/\s*{_D}"),
    ("of", rf"({_D})\s+(?:of|von|sur|de)\s+{_D}"),
    ("bar", rf"({_D})\s*[|¦]|[|¦]\s*{_D}"),
    ("dash", rf"[-–—•·~]\s*({_D})(?:\s*[-–—•·~])?|{_D}\s*[-–—]"),
    ("box", rf"[\[(<{{]\s*({_D})\s*[\])>}}]"),
    ("roman", r"([ivxlc]{1,7})"),
)
_NUMBER_LINE = [(name, re.compile(rf"\s*(?:{p})\s*")) for name, p in NUMBER_STYLES]
_MAYBE_NUMBER = re.compile(r"\d|^[ivxlc]+$|^[lIOSBZ]{1,4}\b|\b[lIOSBZ]{1,4}$")
_NUMERIC = re.compile(r"[0-9lIOSBZ]*[0-9][0-9lIOSBZ]*")
_PLAIN_NUMBER = re.compile(r"[-+±~]?[$€£]?\d+(?:[.,:/’']\d+)*\.?[%°]?|\d+(?:st|nd|rd|th|er|e|o|a|\.)")
_LIKE_NUMBER = re.compile(r"(?=.*\d)[0-9lIOSBZiozsbg|!@]+(?:[.,][0-9lIOSBZiozsbg|!@]+)*%?")
_FOUR_LETTERS = re.compile(r"(?:[\W\d_]*[^\W\d_]){4}")
_SECTION = re.compile(r"[A-Z]+\d*-\d+\b")
_STRIP = " .,;:()[]{}\"'“”„«»‘’?…·•—–/|<>*_"


def skeleton(word: str) -> str:
    """What is left of a word when confusable characters are written one way."""
    plain = word.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
    return plain.translate(CLASSES).translate(CLUSTERS)


def _pieces(word: str) -> list[tuple[str, str]]:
    """(character, its skeleton) of a word."""
    return [(c, skeleton(c)) for c in word.lower()]


def confusions(read: str, true: str) -> list[tuple[str, str]]:
    """(true, read) letters or clusters in which two words of one skeleton differ, cut where their skeletons meet."""
    left, right = _pieces(true), _pieces(read)
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        a, b = i + 1, j + 1
        x, y = left[i][1], right[j][1]
        while x != y:
            if len(x) <= len(y) and a < len(left):
                x, a = x + left[a][1], a + 1
            elif b < len(right):
                y, b = y + right[b][1], b + 1
            else:
                return [*out, (true[i:], read[j:])]
        true_part, read_part = "".join(c for c, _ in left[i:a]), "".join(c for c, _ in right[j:b])
        if true_part != read_part:
            out.append((true_part, read_part))
        i, j = a, b
    return out


class Channel:
    """Probabilities of reading one letter or cluster as another: hard counts over the corpus' usual misreadings, with a prior."""

    def __init__(self, lexicon: dict[str, int], misread: dict[str, tuple[str, int]]):
        self.counts: Counter = Counter()
        self.known: dict[tuple[str, str], float] = {}
        for read, (true, n) in misread.items():
            for pair in confusions(read, true):
                self.counts[pair] += n
        parts = {t for t, _ in self.counts}
        self.uses: Counter = Counter()
        for word, n in lexicon.items():
            for c in set(word):
                self.uses[c] += n * word.count(c)
            for part in parts:
                if len(part) > 1 and part in word:
                    self.uses[part] += n

    def cost(self, true: str, read: str) -> float:
        """Log probability that ``true`` is read as ``read``."""
        return math.log((self.counts[true, read] + PRIOR * CONFUSION) / (self.uses[true] + self.counts[true, read] + PRIOR))

    def of_words(self, read: str, true: str) -> float:
        got = self.known.get((read, true))
        if got is None:
            got = sum(self.cost(t, r) for t, r in confusions(read, true) or [("", "")])
            if len(self.known) < MAX_CACHED:
                self.known[read, true] = got
        return got


class Spelling:
    """Pairs of characters within words, and the Viterbi decoding of a token over its characters."""

    def __init__(self, lexicon: dict[str, int], channel: Channel):
        self.channel, self.pairs, self.first = channel, Counter(), Counter()
        for word, n in lexicon.items():
            before = "^"
            for c in word:
                self.pairs[before, c] += n
                self.first[before] += n
                before = c

    def step(self, before: str, c: str) -> float:
        if c.isdigit() and (before == "^" or before.isdigit()):  # numbers are in no lexicon
            return NUMBER
        if c.isdigit() != before.isdigit() and before != "^":
            return math.log((self.pairs[before, c] + SMOOTH) / (self.first[before] + SMOOTH / MIXED))
        return math.log((self.pairs[before, c] + SMOOTH) / (self.first[before] + 100 * SMOOTH))

    def decode(self, core: str) -> str:
        """The likeliest spelling; the token itself if nothing else is likelier."""
        layer = {"^": (0.0, "")}
        for c in core.lower():
            options = [(c, 0.0)] + [(t, self.channel.cost(t, c)) for t in MAY_BE.get(c, ())]
            layer = {
                t: max((score + self.step(b, t) + cost, done + t) for b, (score, done) in layer.items()) for t, cost in options
            }
        return max(layer.values())[1]


_HEADER_WORDS: dict[str, str] = {}


def header_word(raw: str) -> str:
    """Skeleton of a token of a header, # for numbers, empty for signs; there, a is confused with o as well."""
    got = _HEADER_WORDS.get(raw)
    if got is None:
        bare = raw.strip(_STRIP)
        got = "#" if _NUMERIC.fullmatch(bare) else skeleton(bare).replace("a", "o")
        if len(_HEADER_WORDS) < MAX_CACHED:
            _HEADER_WORDS[raw] = got
    return got


def header_key(line: str) -> str:
    """Skeletons of the words of a line, numbers at its ends left out."""
    words = [b for w in line.split() if (b := header_word(w))]
    while words and words[0] == "#":
        words.pop(0)
    while words and words[-1] == "#":
        words.pop()
    return " ".join(words)


def roman(numeral: str) -> int | None:
    """The value of a numeral of i, v, x, l and c; None if it is none as numbers are written."""
    worth = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in numeral]
    value = sum(-a if a < b else a for a, b in zip(worth, [*worth[1:], 0]))
    written, rest = "", value
    for n, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        written, rest = written + sign * (rest // n), rest % n
    return value if written == numeral else None


def number_style(line: str) -> tuple[str, int | None] | None:
    """Style and number of a line that is a page number alone."""
    if not _MAYBE_NUMBER.search(line):
        return None
    for name, pattern in _NUMBER_LINE:
        m = pattern.fullmatch(line)
        if m:
            digits = next((g for g in m.groups() if g), None)
            if name == "roman":
                return name, roman(digits)
            if name == "bare" and digits and not any(c.isdigit() for c in digits):
                continue
            value = digits.translate(AS_DIGIT) if digits else ""
            return name, int(value) if value.isdigit() else None
    return None


def header_like(line: str) -> bool:
    """Whether a line may be a header: no sentence, no broken word, no section title."""
    return (
        len(line) >= 4
        and (line[0].isupper() or line[0].isdigit() or not line[0].isalnum())
        and line[-1] not in ".;:," + HYPHENS
        and not _SECTION.match(line)
        and _FOUR_LETTERS.match(line) is not None
    )


def _edges(lines: list[str]) -> Iterator[Iterator[tuple[int, str]]]:
    """The non-blank lines from the top and from the bottom, outermost first; who reads them stops at the first that is none of the edge."""
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        yield ((i, x) for i in order if (x := lines[i].strip()))


_EDGE_SCHEMA = "report_id STRING, kind STRING, key STRING, delta INT, pages BIGINT"


def _edge_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        seen: Counter = Counter()
        for report, page, text in zip(frame["report_id"], frame["page"], frame["text"]):
            if not isinstance(report, str):
                continue
            seen[report, "page", "", 0] += 1
            if not isinstance(text, str):
                continue
            mine = set()
            for edge in _edges(text.split("\n")):
                for _, line in edge:
                    number = number_style(line)
                    if number:
                        if number[1] is not None and not pd.isna(page):
                            mine.add((report, "number", number[0], number[1] - int(page)))
                    elif header_like(line):
                        mine.add((report, "header", header_key(line), 0))
                    else:
                        break
            seen.update(mine)
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["report_id", "kind", "key", "delta", "pages"])


def report_edges(pages: DataFrame) -> DataFrame:
    """Per report its header keys and its page-number styles and offsets."""
    counted = (
        pages.select("report_id", "page", "text").mapInPandas(_edge_batches, _EDGE_SCHEMA)
        .groupBy("report_id", "kind", "key", "delta").agg(F.sum("pages").alias("pages"))
    )
    counted = cut_lineage(counted)
    pages_of = counted.where("kind = 'page'").select("report_id", F.col("pages").alias("all_pages"))
    counted = counted.where((F.col("kind") != "page") & (F.col("pages") >= HEADER_LEAST)).join(pages_of, "report_id")
    enough = F.col("pages") >= F.greatest(F.lit(HEADER_LEAST), HEADER_SHARE * F.col("all_pages"))
    kept = counted.where(enough & ((F.col("kind") == "number") | ((F.col("kind") == "header") & (F.length("key") >= 4))))
    return kept.groupBy("report_id").agg(
        F.collect_list(F.when(F.col("kind") == "header", F.col("key"))).alias("headers"),
        F.collect_list(F.when(F.col("kind") == "number", F.struct(F.col("key").alias("style"), "delta", "pages"))).alias("numbers"),
    )


def as_text(edges: DataFrame) -> DataFrame:
    """``report_id, edges``: the header keys and number styles of a report as one text, which workers take apart once a report."""
    numbers = F.transform("numbers", lambda x: F.concat_ws("|", x["style"], x["delta"].cast("string"), x["pages"].cast("string")))
    return edges.select("report_id", F.concat(F.array_join("headers", "\n"), F.lit("\x01"), F.array_join(numbers, "\n")).alias("edges"))


def from_text(edges: str | None) -> tuple[set[str], dict[tuple[str, int], int]]:
    """Header keys, and pages by number style and offset, of a report."""
    headers, _, numbers = (edges or "").partition("\x01")
    rows = [x.split("|") for x in numbers.split("\n") if x]
    return {h for h in headers.split("\n") if h}, {(style, int(delta)): int(pages) for style, delta, pages in rows}


def _count_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs: Counter = Counter()
    bare: dict[str, str] = {}

    def plain(word: str) -> str:
        """The word without punctuation; empty for numbers."""
        got = bare.get(word)
        if got is None:
            got = word if word.isalpha() else word.strip(_STRIP)
            if not got.isalpha() and (not got or _PLAIN_NUMBER.fullmatch(got) or _LIKE_NUMBER.fullmatch(got)):
                got = ""
            bare[word] = got
        return got

    def flush() -> pd.DataFrame:
        merged: dict[tuple[str, str], int] = {}
        for (a, b), n in pairs.items():
            a = plain(a)
            if a:
                merged[a, ""] = merged.get((a, ""), 0) + n
                b = plain(b)
                if b:
                    merged[a, b] = merged.get((a, b), 0) + n
        pairs.clear()
        bare.clear()
        return pd.DataFrame([(*k, n) for k, n in merged.items()], columns=["a", "b", "n"])

    for frame in frames:
        for text in frame["text"]:
            if isinstance(text, str):
                tokens = text.lower().split()
                tokens.append("")
                pairs.update(zip(tokens, tokens[1:]))
        if len(pairs) > 400_000:
            yield flush()
    yield flush()


def language_model(texts: DataFrame) -> tuple[dict[str, int], dict[tuple[str, str], int], int, dict[str, tuple[str, int]]]:
    """Lexicon, pairs, the number of tokens, and the usual misreadings with their words.

    At most ``MOST_WORDS`` words and 1 / ``PAIR_SHARE`` pairs, whatever the corpus.
    """
    counted = cut_lineage(
        texts.select("text").mapInPandas(_count_batches, "a STRING, b STRING, n BIGINT").groupBy("a", "b").agg(F.sum("n").alias("n"))
    )
    total = counted.where("b = ''").agg(F.sum("n")).first()[0] or 0
    words = counted.where("b = ''")
    levels = words.where(F.col("n") >= LEAST).groupBy(F.floor(F.log2(F.col("n") / LEAST)).alias("level")).agg(F.count(F.lit(1)).alias("words"))
    by_level = sorted((r["level"], r["words"]) for r in levels.collect())  # 64 rows at most
    bar = LEAST
    while sum(n for level, n in by_level if LEAST << level >= bar) > MOST_WORDS:
        bar *= 2
    kept = counted.where(
        ((F.col("b") == "") & (F.col("n") >= bar)) | ((F.col("b") != "") & (F.col("n") >= max(LEAST, PAIR_SHARE * total)))
    ).collect()
    raw = {r["a"]: r["n"] for r in kept if not r["b"]}
    most: dict[str, int] = {}
    bones = {w: skeleton(w) for w in raw}
    for w, n in raw.items():
        most[bones[w]] = max(most.get(bones[w], 0), n)
    lexicon = {w: n for w, n in raw.items() if most[bones[w]] < DOMINANCE * n}
    top = {b: w for b, n, w in sorted((bones[w], n, w) for w, n in lexicon.items())}
    misread = {w: (top[bones[w]], n) for w, n in raw.items() if w not in lexicon and bones[w] in top}
    pairs = {(r["a"], r["b"]): r["n"] for r in kept if r["b"] and r["a"] in lexicon and r["b"] in lexicon}
    return lexicon, pairs, total, misread


class Reader:
    """Finds and repairs noise with a language model."""

    def __init__(self, lexicon: dict[str, int], pairs: dict[tuple[str, str], int], total: int, misread: dict[str, tuple[str, int]] | None = None):
        self.lexicon, self.pairs, self.total = lexicon, pairs, max(1, total)
        self.channel = Channel(lexicon, misread or {})
        self.spelling = Spelling(lexicon, self.channel)
        self.by_bones: dict[str, list[str]] = {}
        for w in lexicon:
            self.by_bones.setdefault(skeleton(w), []).append(w)
        self.known: dict[str, tuple | None] = {}
        self.well: set[str] = set()

    # -- tokens ---------------------------------------------------------------------------------

    def candidates(self, core: str) -> tuple[str, ...] | None:
        """None: read well. Else the words it may be, none if there is none."""
        low = core.lower()
        if not low or low in self.lexicon or _PLAIN_NUMBER.fullmatch(core):
            return None
        if not any(c.isalnum() for c in core):
            return None
        if any(h in core for h in HYPHENS) or "/" in core:
            parts = [p for p in re.split(rf"[/{HYPHENS}]", core) if p]
            found = [self.candidates(p.strip(_STRIP)) for p in parts]
            whole = self.by_bones.get(skeleton(core))
            if all(f is None for f in found):
                return None
            return tuple(whole or ())
        if _LIKE_NUMBER.fullmatch(core) and any(c.isdigit() for c in core):
            words = [w for w in self.by_bones.get(skeleton(core), ()) if not any(c.isdigit() for c in w)]
            return tuple(words) if sum(c.isdigit() for c in core) * 2 <= len(core) else ()
        found = self.by_bones.get(skeleton(core), ())
        if core[0].isupper() and core.isalpha():
            found = [w for w in found if self.lexicon[w] >= NAME_SHARE * self.total]
        if found:
            return tuple(found)
        if any(c in "0123456789@!|$" for c in core) and any(c.isalpha() for c in core):
            return ()
        return None

    def token(self, raw: str) -> tuple | None:
        """None if the token is read well, else (its core, its candidates)."""
        try:
            return self.known[raw]
        except KeyError:
            pass
        core = raw.strip(_STRIP)
        if core.endswith("!") and core[:-1].lower() in self.lexicon:
            core = core[:-1]
        found = self.candidates(core)
        got = None if found is None else (core, found)
        if len(self.known) < MAX_CACHED:
            self.known[raw] = got
            if got is None:
                self.well.add(raw)
        return got

    # -- Viterbi --------------------------------------------------------------------------------

    def _emit(self, core: str, word: str | None) -> float:
        if word is None:
            return math.log(UNKNOWN)
        return self.channel.of_words(core.lower(), word)

    def _step(self, before: str | None, word: str | None) -> float:
        if word is None:
            return 0.0
        own = self.lexicon.get(word, 0) / self.total
        if before is None:
            return math.log(own + 1e-9)
        n = self.lexicon.get(before, 0)
        return math.log((self.pairs.get((before, word), 0) + 5 * own + 1e-6) / (n + 5))

    def decode(self, tokens: list[str]) -> list[str | None]:
        """For each token the word it was misread from, or None; Viterbi over the candidates of the line."""
        layer: list[tuple[float, str | None, tuple]] = [(0.0, None, ())]
        for raw in tokens:
            found = self.token(raw)
            nxt = []
            if found is None:
                word = raw.strip(_STRIP).lower()
                word = word if word in self.lexicon else None
                options: list[tuple[str | None, float, str | None]] = [(word, 0.0, None)]
            else:
                core, words = found
                if words:
                    options = [(w, self._emit(core, w), w) for w in words]
                    if core.isalpha():  # no word has digits or signs within
                        options.append((None, math.log(UNKNOWN), None))
                else:
                    spelled = self.spelling.decode(core)
                    options = [(None, 0.0, spelled if spelled != core.lower() else None)]
            for word, cost, mark in options:
                score, before, path = max(((s + self._step(b, word), b, p) for s, b, p in layer), key=lambda x: x[0])
                nxt.append((score + cost, word, (path, mark)))
            layer = nxt
        path = max(layer, key=lambda x: x[0])[2]
        out: list[str | None] = []
        while path:
            path, mark = path
            out.append(mark)
        return out[::-1]

    def misread(self, tokens: list[str]) -> dict[int, str]:
        """Positions of misread tokens and their correction (empty if unknown)."""
        well = self.well
        if well.issuperset(tokens):
            return {}
        odd = [i for i, t in enumerate(tokens) if t not in well and self.token(t) is not None]
        out: dict[int, str] = {}
        at = 0
        while at < len(odd):
            # a token that is read well has one option, so a line falls apart at such tokens
            end = at
            while end + 1 < len(odd) and odd[end + 1] == odd[end] + 1:
                end += 1
            first = max(0, odd[at] - 1)
            for i, word in enumerate(self.decode(tokens[first : odd[end] + 2]), first):
                if word is not None:
                    out[i] = word
            at = end + 1
        return out

    # -- broken words ---------------------------------------------------------------------------

    def broken(self, left: str, mark: str, right: str) -> tuple[bool, str | None, tuple[bool, bool]]:
        """Whether ``left-right`` is one word broken in two, the word, and which halves are misread."""
        a, b = left.strip(_STRIP).lower(), right.strip(_STRIP).lower()
        if not a or not b or not right.strip(_STRIP)[:1].isalpha() and not right[:1].isdigit():
            return bool(a) and mark in "¬­" and not b, None, (False, False)
        solid, dashed = self.lexicon.get(a + b, 0), self.lexicon.get(f"{a}-{b}", 0)
        if not solid and b in ("and", "or", "und", "oder", "et", "ou", "y", "o"):
            return False, None, (False, False)
        if not solid and not dashed:
            bones = skeleton(a + b)
            words = self.by_bones.get(bones, ())
            dashes = self.by_bones.get(f"{skeleton(a)}-{skeleton(b)}", ())
            if words and not dashes:
                word = max(words, key=lambda w: self.lexicon[w])
                return True, word, self._halves(a, b, word)
            if dashes:
                word = max(dashes, key=lambda w: self.lexicon[w])
                x, _, y = word.partition("-")
                return False, word, (a != x, b != y)
            # compounds are seen whole somewhere; what is not is a broken name
            return mark in "¬­" or right[:1].islower(), None, (False, False)
        return solid > dashed, None, (False, False)

    @staticmethod
    def _halves(a: str, b: str, word: str) -> tuple[bool, bool]:
        cut = next((k for k in range(1, len(word)) if skeleton(word[:k]) == skeleton(a) and skeleton(word[k:]) == skeleton(b)), None)
        if cut is None:
            return True, False
        return a != word[:cut], b != word[cut:]


def edge_noise(lines: list[str], page: int | None, headers: set[str], numbers: dict[tuple[str, int], int]) -> dict[int, str]:
    """Line index -> ``running_header`` or ``page_number``, from the edges of the page inwards."""
    out: dict[int, str] = {}
    for edge in _edges(lines):
        for i, line in edge:
            number = number_style(line)
            if number:
                style, value = number
                sure = style not in ("bare", "roman")
                if not sure and page is not None and value is not None:
                    sure = (style, value - page) in numbers
                if not sure:
                    break
                out[i] = "page_number"
            elif header_like(line) and header_key(line) in headers:
                out[i] = "running_header"
            else:
                break
    return out


def read_page(
    reader: Reader, text: str, page: int | None, headers: set[str], numbers: dict, want_text: bool = True
) -> tuple[list[tuple[int, str]], str]:
    """((line number, noise) of a page), and its text as continuous paragraphs."""
    lines = text.split("\n")
    edge = edge_noise(lines, page, headers, numbers)
    noise = {(i + 1, kind) for i, kind in edge.items()}
    body = [(i, x.split()) for i, x in enumerate(lines) if i not in edge]
    well = reader.well
    paragraphs: list[list[str]] = [[]]
    carry: tuple[str, bool, str | None] | None = None  # left half, whether joined, correction
    for at, (i, tokens) in enumerate(body):
        if not tokens:
            if carry is None and paragraphs[-1]:
                paragraphs.append([])
            continue
        left = tokens[-1]
        ends_broken = left[-1] in HYPHENS and len(left) > 1 and left[-2].isalpha()
        if carry is None and not ends_broken:
            if well.issuperset(tokens):
                if want_text:
                    paragraphs[-1] += tokens
                continue
        checked = tokens
        if carry is not None:
            before, joined, word = carry
            first = tokens[0]
            tail = first[len(first.rstrip(_STRIP)) :]
            if want_text:
                whole = (_like(before.rstrip(HYPHENS), word) + tail) if word else (before.rstrip(HYPHENS) + ("" if joined else "-") + first)
                if paragraphs[-1]:
                    paragraphs[-1][-1] = whole
            checked, carry = tokens[1:], None
        if ends_broken:
            ahead = next(((j, t) for j, t in body[at + 1 :] if t), None)
            if ahead:
                is_break, word, (bad_left, bad_right) = reader.broken(left[:-1], left[-1], ahead[1][0])
                if bad_left:
                    noise.add((i + 1, "misread"))
                if bad_right:
                    noise.add((ahead[0] + 1, "misread"))
                carry = (left, is_break, word)
            else:
                is_break = left[-1] in "¬­" or left[:-1].strip(_STRIP).lower() not in reader.lexicon
            if is_break:
                noise.add((i + 1, "hyphen_break"))
            checked = checked[:-1]
        wrong = reader.misread(checked)
        if wrong:
            noise.add((i + 1, "misread"))
        if want_text:
            paragraphs[-1] += [_like(t, wrong[k]) if wrong.get(k) else t for k, t in enumerate(checked)]
            if ends_broken:
                paragraphs[-1].append(left)
    return sorted(noise), "\n\n".join(" ".join(p) for p in paragraphs if p)


def _like(raw: str, word: str) -> str:
    """``word`` with the case and punctuation of the token it replaces."""
    core = raw.strip(_STRIP)
    at = raw.find(core)
    if core[:1].isupper():
        word = word.upper() if len(core) > 1 and core.isupper() else word[:1].upper() + word[1:]
    return raw[:at] + word + raw[at + len(core) :]


_SOFT = re.compile(r"(.*[^\W\d_])([¬­])([^\W\d_].*)")
_BROKEN = re.compile(r"[^\W\d_][-‐‑]\s(?!and |or |und |oder |et |ou |y )")


def _maybe_broken(text: str) -> bool:
    if "¬" in text or "­" in text:
        return True
    return ("- " in text or "‐" in text or "‑" in text or "-\n" in text) and _BROKEN.search(text) is not None


def read_paragraph(reader: Reader, text: str, page: int | None, headers: set[str], numbers: dict) -> tuple[list[str], str]:
    """Kinds of noise within a running text, and the text repaired."""
    kinds: set[str] = set()
    tokens = text.split()
    # headers: the key's words among the text's words
    spans: list[tuple[int, int]] = []
    if headers:
        try:
            bones = list(map(_HEADER_WORDS.__getitem__, tokens))
        except KeyError:
            bones = [header_word(t) for t in tokens]
        present = set(bones)
        likely = [key for key in headers if key.partition(" ")[0] in present]
        joined = f" {' '.join([b for b in bones if b])} " if likely else ""
        for key in likely:
            at = joined.find(f" {key} ")
            if at >= 0:
                full = [i for i, b in enumerate(bones) if b]
                first = joined.count(" ", 0, at)
                start, end = full[first], full[first + key.count(" ")]
                if (" " not in key or len(key) < 10) and not _interrupts(reader, tokens, start, end):
                    continue
                if end + 1 < len(tokens) and re.fullmatch(r"(?:19|20)\d\d", tokens[end + 1].strip(_STRIP)):
                    end += 1
                kinds.add("running_header")
                spans.append((start, end))
    inside = {i for a, b in spans for i in range(a, b + 1)}
    # page numbers: the number this page would print, in any style
    if page is not None:
        found = _printed(reader, tokens, page, {delta for _, delta in numbers}, {delta for style, delta in numbers if style == "bare"}, inside)
        if found:
            kinds.add("page_number")
            inside |= set(found)
    rest = [t for i, t in enumerate(tokens) if i not in inside] if inside else tokens
    fixed: list[str] = []
    i = 0
    joined_at: set[int] = set()
    if not _maybe_broken(text):
        fixed, i = rest, len(rest)
    while i < len(rest):
        t = rest[i]
        core = t.rstrip()
        inner = _SOFT.fullmatch(core) if "¬" in core or "\u00ad" in core else None
        if inner:
            kinds.add("hyphen_break")
            fixed.append(inner[1] + inner[3])
            i += 1
            continue
        if len(core) > 1 and core[-1] in HYPHENS and core[-2].isalpha() and i + 1 < len(rest):
            is_break, word, (bad_left, bad_right) = reader.broken(core[:-1], core[-1], rest[i + 1])
            if bad_left or bad_right:
                kinds.add("misread")
            if is_break:
                kinds.add("hyphen_break")
            if is_break or word or reader.lexicon.get((core[:-1] + "-" + rest[i + 1]).strip(_STRIP).lower()):
                nxt = rest[i + 1]
                tail = nxt[len(nxt.rstrip(_STRIP)) :]
                joined_at.add(len(fixed))
                fixed.append((word + tail) if word else core[:-1] + ("" if is_break else "-") + nxt)
                i += 2
                continue
            fixed.append(t)
            i += 1
            continue
        fixed.append(t)
        i += 1
    for k, word in reader.misread(fixed).items():
        if k in joined_at and not word:
            continue
        kinds.add("misread")
        if word:
            fixed[k] = _like(fixed[k], word)
    return sorted(kinds), " ".join(fixed)


def _interrupts(reader: Reader, tokens: list[str], start: int, end: int) -> bool:
    """Whether short tokens stand between two words that follow each other elsewhere, and do not follow the first themselves."""
    around = tokens[start - 1 : start] + tokens[end + 1 : end + 2]
    if len(around) < 2 or around[0][-1] in ".!?":
        return False
    a, own, b = (x.strip(_STRIP).lower() for x in (around[0], tokens[start], around[1]))
    return (a, b) in reader.pairs and (a, own) not in reader.pairs


_INLINE = (
    re.compile(rf"(?:[Pp]ag[ec]|[Ss]eite|[Pp]ágina) ({_D}) (?:of|0f|von|sur|de) {_D}"),
    re.compile(rf"(?:p|pg|P|S|pág)\. ({_D})"),
    re.compile(rf"({_D}) ?/ ?{_D}"),
    re.compile(rf"({_D}) [|¦]"),
    re.compile(rf"[-–—] ({_D})(?: [-–—])?"),
    re.compile(rf"[\[(]({_D})[\])]"),
    re.compile(rf"({_D}) (?:of|von|sur|de) {_D}"),
    re.compile(rf"(?:[Pp]ag[ec]|[Ss]eite|[Pp]ágina) ({_D})"),
)


_NUMBER_SIGNS = ("[", "(", "/", "|", "¦", " - ", "— ", "– ", "age ", "agc ", "eite ", "ágina ", "agina ", "p. ", "P. ", "S. ", "pg. ", "pág. ")
_DIGIT = re.compile("[0-9]")
_OF = re.compile(r"[0-9lIOSBZ] (?:of|von|sur|de) [0-9lIOSBZ]")
_MAYBE_INLINE = re.compile(
    r"[\[(][0-9lIOSBZ]+[\])]|[0-9lIOSBZ] ?[/|¦]| [-–—] [0-9lIOSBZ]|(?:[Pp]ag[ec]|[Ss]eite|[Pp][áa]gina|\b[PpS]\.|pg\.|pág\.) [0-9lIOSBZ]|[0-9lIOSBZ] (?:of|von|sur|de) [0-9lIOSBZ]|^[-–—] [0-9lIOSBZ]"
)


def _printed(reader: Reader, tokens: list[str], page: int, deltas: set[int], bare: set[int], taken: set[int]) -> list[int]:
    """Positions of a page number that interrupts running text; none if it may be part of a sentence.

    The number must be the one the report prints on this page; where the pages print none, it must come after the
    actual number and stand between words that follow each other elsewhere.
    """
    line = " ".join(tokens)
    if not _DIGIT.search(line):  # a printed number has one at least
        return []
    bare_here = [n for d in bare if (n := str(page + d)) in tokens]
    signs = any([c in line for c in _NUMBER_SIGNS]) or line.startswith("- ")
    if not bare_here and not (signs and _MAYBE_INLINE.search(line)) and not _OF.search(line):
        return []
    wanted = {page + d for d in deltas}
    starts, at = {}, 0
    for i, t in enumerate(tokens):
        starts[at] = i
        at += len(t) + 1
    starts[at] = len(tokens)

    def interrupts(i: int, j: int) -> bool:
        before, after = (tokens[i - 1] if i else ""), (tokens[j] if j < len(tokens) else "")
        if (not before or before[-1] in ".!?") and (not after or after[:1].isupper()):
            return bool(before or after)
        a, b = before.strip(_STRIP).lower(), after.strip(_STRIP).lower()
        return bool(a and b) and before[-1] not in ".!?" and (a, b) in reader.pairs

    for pattern in _INLINE:
        for m in pattern.finditer(line):
            i, j = starts.get(m.start()), starts.get(m.end() + 1)
            value = m[1].translate(AS_DIGIT)
            if i is None or j is None or i in taken or not value.isdigit() or not any(c.isdigit() for c in m[1]):
                continue
            if int(value) in wanted or (not wanted and page <= int(value) and interrupts(i, j)):
                return list(range(i, j))
    for i, raw in enumerate(tokens):
        if i not in taken and raw in bare_here and interrupts(i, i + 1):
            return [i]
    return []


_READERS: dict[str, Reader] = {}


def reader_of(name: str, model: Broadcast) -> Reader:
    """The reader with this model, built once per worker; the one before is dropped."""
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = Reader(*model.value)
    return _READERS[name]


def _texts(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    page = pages.select(F.lit("page_text").alias("source_table"), F.col("page_row_id").alias("record_id"), "report_id", "page", "text")
    para = paragraphs.select(F.lit("paragraph_text").alias("source_table"), F.col("para_id").alias("record_id"), "report_id", "page", "text")
    return page.unionByName(para).where("text IS NOT NULL")


def _read_all(pages: DataFrame, paragraphs: DataFrame, want_text: bool) -> DataFrame:
    texts = _texts(pages, paragraphs)
    model = texts.sparkSession.sparkContext.broadcast(language_model(texts))
    joined = texts.join(as_text(report_edges(pages)), "report_id", "left")
    schema = "source_table STRING, record_id BIGINT, " + ("report_id STRING, page INT, text STRING" if want_text else "line_no INT, noise STRING")

    name, columns = uuid.uuid4().hex, ["source_table", "record_id", "report_id", "page", "text", "edges"]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = reader_of(name, model)
        known: dict[str | None, tuple[set[str], dict]] = {None: (set(), {})}
        for frame in frames:
            out = []
            for table, record, report, page, text, edges in zip(*(frame[c].tolist() for c in columns)):
                page = None if page is None or page != page else int(page)
                own, styles = known.get(edges) or known.setdefault(edges, from_text(edges))
                if table == "page_text":
                    found, repaired = read_page(reader, text, page, own, styles, want_text)
                else:
                    kinds, repaired = read_paragraph(reader, text, page, own, styles)
                    found = [(0, k) for k in kinds]
                if want_text:
                    out.append((table, record, report if isinstance(report, str) else None, page, repaired))
                else:
                    out += [(table, record, n, kind) for n, kind in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return joined.select(*columns).mapInPandas(batches, schema)


def locate_noise(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``source_table, record_id, line_no, noise``, one row per line (or paragraph) and kind."""
    return _read_all(pages, paragraphs, want_text=False)


def repaired_texts(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``source_table, record_id, report_id, page, text``: every text as continuous readable paragraphs."""
    return _read_all(pages, paragraphs, want_text=True)
