"""Scores for abusive, hateful and sexually explicit content.

Gradient-boosted trees over dense features of a document: lexicon densities, proximity of insults, violence and
profanity to the person addressed and of degrading or excluding words to a group, capitals, punctuation and obfuscation
rates; one model per kind, calibrated by isotonic regression. Features are taken per window of neighbouring words and the
strongest window counts, so one such sentence in a long report is not diluted.

Two sorts of lexicon. The general ones below are single words of everyday offensive vocabulary. The learned ones
are counted from the reviewed documents: words that documents of one verdict hold far more often than all
others (log-likelihood ratio), weighted by the log ratio of their shares. For training, a document is
measured with the weights of the other folds only, so no word speaks for the review it was learned from.

Words are read through disguises: compatibility forms, look-alike letters, invisible characters,
digits for letters, stars for letters, letters set apart, signs inside words.

Everything is fitted on the reviewed documents, at most ``max_labels`` of them (by hash order; a documented bound of the
training sample only). Reviews may be wrong or contradict each other: leaves need a least weight, and folds go by
document, so two reviews of one document are never on both sides. A kind that no review names has score 0 throughout.

Scale: features and scores are one Arrow pass over the documents without a shuffle; the reviewed documents are
picked by one join on the document id and written once. The trees and the learned weights are some tens of kilobytes.

Defined results: null, empty and blank texts score as a text without any sign; documents without reviews are scored
like all others; reviews of unknown documents, unsure and unknown verdicts are left out; repeated documents
are each scored; very long texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.sources.checkpoints import cut_lineage

KINDS = ("abusive", "hateful", "sexual")
VERDICTS = (*KINDS, "clean")
#: Most reviewed documents that the models are fitted on.
MAX_LABELS = 20_000
#: Calibrated score from which content is reported.
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 12
#: Weight of a leaf at least (and as a share of all weight), ridge on leaf values, gain of a split at least: reviews are noisy.
LEAF, LEAF_SHARE, RIDGE, GAIN = 4, 0.004, 3.0, 2.0
#: Folds of documents for held-out weights and scores.
FOLDS = 5
#: Words that are read together, and the log-likelihood ratio from which a word is learned.
WINDOW, LEARNED_FROM = 20, 16.0
#: What a review of another kind weighs for this one: it does not say that the document has nothing of it.
OTHER_KIND = 0.5

# Everyday offensive vocabulary of English, German, French and Spanish, single words.
INSULTS = """idiot idiots moron morons cretin cretins bastard bastards dickhead dickheads arsehole arseholes asshole assholes scumbag scumbags
dirtbag dirtbags halfwit halfwits jackass jackasses imbecile imbeciles prick pricks wanker wankers twat twats cunt cunts dunce fool fools loser losers clown
bitch bitches whore whores slut sluts motherfucker motherfuckers douchebag dumbass shithead bonehead dimwit nitwit scum lowlife retard
arschloch arschlöcher vollidiot vollidioten idioten mistkerl mistkerle drecksack drecksäcke hurensohn wichser schlampe fotze trottel depp drecksau schwachkopf
connard connards connasse salaud salauds salope crétin crétins crétine imbécile imbéciles abruti abrutis enculé enculés ordure pute bouffon
gilipollas imbécil imbéciles idiota idiotas cabrón cabrones cabrona pendejo pendejos puta hijoputa capullo subnormal mamón estúpido""".split()
#: Beginnings of scornful adjectives.
SCORNFUL = "slimy filthy pathetic brainless worthless useless stupid miserable disgusting rotten despicable widerlich erbärmlich hirnlos dumm dreckig verdammt pourri répugnant débile minable asqueros inútil estúpid miserabl repugnante podrid".split()
PROFANE = "fuck fucking fucked shit hell piss damn crap bloody fresse maul scheiße scheiss verpiss fick gueule merde foutre nique mierda joder jodan jode carajo infierno".split()
VIOLENCE = """break bleed kill killed beat beaten smash smashed choke stab shoot strangle hurt burn die dead rot park punch bash suffer regret hang
eingeschlagen einschlagen umbringen schlagen verrecke verrecken erschlagen prügeln casser crever tuer frapper brûler romperte matar matarte mueras golpear quemar""".split()
YOU = "you your yours yourself u du dir dich dein deine deinen deiner ihr euch toi tu te ta tes ton vous votre vos tú ti tus usted ustedes contigo".split()
GROUPS = """immigrants immigrant refugees refugee foreigners foreigner migrants migrant women cripples cripple elderly disabled muslims jews blacks gays lesbians gypsies
christians hindus asians africans arabs ausländer ausländern flüchtlinge flüchtlingen migranten behinderte behinderten frauen juden muslime moslems zigeuner schwule
étrangers étrangères réfugiés immigrés migrants handicapés femmes juifs musulmans arabes noirs vieux extranjeros refugiados inmigrantes inválidos
discapacitados mujeres judíos musulmanes gitanos negros moros viejos ancianos""".split()
DEGRADING = """vermin rats animals thieves infest scum filth subhuman breed cage parasites cockroaches pigs inferior abschaum ungeziefer ratten vermehren parasiten untermenschen
vermine rats reproduisent racaille cafards parasites escoria animales ratas multiplican alimañas ladrones basura""".split()
EXCLUDING = """out away expel deport banish drive thrown wiped deserve deserves belong keep rid raus hinausgejagt verjagen abschieben gehören verdienen
chasser dehors expulser virer méritent merecen echarlos expulsar fuera""".split()
SEXUAL = """horny nude nudes naked undress porn porno pornos pornography xxx hardcore strip uncensored tits ass boobs cock dick pussy cum moaning moaned groaned groaning thighs lick licking
sex sexy blowjob orgasm erotic geil geile geiler nackt nackte nackten nacktbilder brüste lecken stöhnte stöhnen ficken titten muschi seins lécher nus nue nues nu
gémissant gémissements bite baiser pechos lamer desnudo desnuda desnudos desnudas gemidos follar tetas polla coño""".split()
#: Words of rules, care and teaching, beside which such matters are mostly talked about, not done.
NEUTRAL = """policy policies rule rules law training course courses mandatory ban bans banned prohibited screening clinic cancer harassment prevention discrimination inclusion support
schulung schulungen regel regeln verboten belästigung vorbeugung kurs kurse förderung formation règle règles interdit harcèlement prévention cours soutien
formación regla reglas prohibido acoso prevención curso cursos apoyo""".split()

_INVISIBLE = re.compile("[​-‏⁠﻿­̀-ͯ҈҉]")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнαορτυκνι", "aeopcyxijsdhkmtbhaoptukvi")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LEETED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$!|€])[\w@$!|€]+")
_MASKED = re.compile(r"[^\W\d_][^\W_]*[*#_·•]+[^\W_]*")
_TRIPLED = re.compile(r"(.)\1{2,}")
_COMPOUND = re.compile(r"[^\W\d_]{2,}-[^\W\d_]{2,}")


def clean(text: str) -> str:
    """The text in lower case, without invisible characters and look-alike letters."""
    if text.isascii():
        return text.lower()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).lower()
        if _FOREIGN.search(text):
            text = text.translate(_LOOKALIKE)
    return text.lower()


_SETS = (INSULTS, VIOLENCE, YOU, GROUPS, DEGRADING, SEXUAL, NEUTRAL, PROFANE, EXCLUDING)
_INSULT, _VIOLENT, _YOU, _GROUP, _DEGRADING, _SEXUAL, _NEUTRAL, _PROFANE, _EXCLUDING, _SCORNFUL = range(10)
_BITS: dict[str, int] = {}
for _k, _words in enumerate(_SETS):
    for _w in _words:
        _BITS[_w] = _BITS.get(_w, 0) | 1 << _k
#: Categories that make a window worth looking at; the others only count beside them.
_OFFENSIVE = sum(1 << k for k in (_INSULT, _VIOLENT, _GROUP, _DEGRADING, _SEXUAL, _PROFANE, _SCORNFUL))
_DISGUISED = sum(1 << k for k in (_INSULT, _DEGRADING, _SEXUAL, _PROFANE, _SCORNFUL))


def bits(word: str) -> int:
    """Lexicon categories of a word."""
    return _BITS.get(word, 0) | (1 << _SCORNFUL if word.startswith(tuple(SCORNFUL)) else 0)


def _hidden(word: str) -> bool:
    return bool(bits(word) & _DISGUISED) or word[-1:] == "s" and bool(bits(word[:-1]) & 1 << _INSULT)


_BY_SHAPE: dict[tuple[str, int], list[str]] = {}
for _w in sorted({w + s for w, b in _BITS.items() if b & _DISGUISED for s in ("", "s")} | set(SCORNFUL)):
    _BY_SHAPE.setdefault((_w[0], len(_w)), []).append(_w)


def read_word(raw: str) -> tuple[list[str], bool]:
    """The words of a raw token, disguises undone, and whether there was one."""
    core = raw.strip(".,;:!?\"'()[]{}«»“”„…-–—")
    if core.isalpha():
        if len(core) > 4 and (m := _TRIPLED.search(core)):
            short = core.replace(m[0], m[1])
            if _hidden(short):
                return [short], True
        return [core], False
    if "*" in core or "#" in core or "_" in core:
        m = _MASKED.fullmatch(core)
        if m and core[0].isalpha():
            pattern = re.compile(re.sub(r"[*#_·•]", ".", core))
            fit = next((w for w in _BY_SHAPE.get((core[0], len(core)), ()) if pattern.fullmatch(w)), None)
            if fit:
                return [fit], True
    if _LEETED.fullmatch(core):
        plain = core.translate(_LEET)
        if _hidden(plain):
            return [plain], True
    joined = "".join(c for c in core if c.isalpha())
    if len(joined) >= 3 and not core.startswith("http") and _hidden(joined) and not _COMPOUND.fullmatch(core):
        return [joined], True
    if "-" in core and core.partition("-")[0] in _BITS and len(core.partition("-")[2]) > 2:
        return [core.replace("-", "")], False  # compounds such as idiot-proof mean something else
    return _LETTERS.findall(core), False


def _spelled(letters: list[str]) -> list[str]:
    """The one or two hidden words that single letters spell; none if they spell none."""
    joined = "".join(letters)
    halves = ([joined[:k], joined[k:]] for k in range(3, len(joined) - 2))
    return next((h for h in halves if all(map(_hidden, h))), [joined] if _hidden(joined) else [])


MAX_CACHED = 200_000
_SINGLE, _ENDS, _HIDDEN = 1, 2, 4


class Words:
    """Texts as words, a token being read once per worker."""

    def __init__(self):
        self.known: dict[str, tuple[list[str], int]] = {}

    def read(self, raw: str) -> tuple[list[str], int]:
        """The words of a raw token and its marks: a single letter, an end of a sentence, a disguise."""
        got = self.known.get(raw)
        if got is None:
            core = raw.rstrip(".,;:!?")
            marks = _ENDS if raw[-1] in ".!?" and len(raw) > 1 else 0
            if len(core) == 1 and core.isalpha():
                got = [core], marks | _SINGLE
            elif raw[0] in "<{" and raw[-1] in ">}" or raw.startswith("http"):
                got = [], 0
            else:
                found, hidden = read_word(raw)
                got = found, marks | _HIDDEN * hidden
            if len(self.known) < MAX_CACHED:
                self.known[raw] = got
        return got

    def sentences(self, text: str) -> Iterator[tuple[list[str], int]]:
        """(words, disguised words) of each sentence of a cleaned text; signs and numbers between words are passed over."""
        words: list[str] = []
        single: list[str] = []
        disguised = 0
        for raw in text.split():
            found, marks = self.read(raw)
            if marks & _SINGLE:
                single += found
                words += found
                if not marks & _ENDS:
                    continue
            if single:
                if len(single) >= 3 and (spelled := _spelled(single)):
                    words[-len(single) :] = spelled
                    disguised += 1
                single = []
            if not marks & _SINGLE:
                words += found
                disguised += marks & _HIDDEN != 0
            if marks & _ENDS and words:
                yield words, disguised
                words, disguised = [], 0
        if len(single) >= 3 and (spelled := _spelled(single)):
            words[-len(single) :] = spelled
            disguised += 1
        if words:
            yield words, disguised


#: Tokens read by this worker; what a token means depends on nothing else.
_WORDS = Words()

Weights = dict[str, tuple[float, float, float]]
Counts = dict[str, dict[str, int]]


def learn_words(counts: Counts, documents: dict[str, int]) -> Weights:
    """Word -> its weight for each kind; ``counts`` has by word the documents of each verdict that hold it.

    Learned are words whose log-likelihood ratio reaches ``LEARNED_FROM``; the weight is the log ratio of the shares.
    """
    every = sum(documents.values())
    out: Weights = {}
    for word, by in counts.items():
        held = sum(by.values())
        own = []
        for kind in KINDS:
            n, all_of = by.get(kind, 0), documents.get(kind, 0)
            rest, others = held - n, every - all_of
            weight = 0.0
            if n and all_of and others and n * others != rest * all_of:
                expected, unexpected = held * all_of / every, held * others / every
                ratio = 2 * (n * math.log(n / expected) + (rest * math.log(rest / unexpected) if rest else 0.0))
                if ratio >= LEARNED_FROM:
                    weight = math.log((n + 0.5) / (all_of + 1)) - math.log((rest + 0.5) / (others + 1))
            own.append(round(weight, 3))
        if any(own):
            out[word] = tuple(own)
    return out


FEATURES = (
    "insults", "insult_near_you", "scorn_with_insult", "profane_near_you", "profane", "violence_near_you", "violence", "you",
    "group_with_degrading", "group_with_excluding", "group_with_scorn", "degrading", "groups",
    "sexual", "sexual_most", "sexual_near_you", "neutral_beside",
    "insult_density", "sexual_density", "capitals", "marks", "disguised", "log_words",
    *(f"learned_{k}_{m}" for k in KINDS for m in ("sum", "most", "words")),
)


def _near(xs: list[int], ys: list[int], distance: int) -> bool:
    """Whether one place of a sorted list is within ``distance`` of one of another."""
    return any(bisect_left(ys, x - distance) < bisect_right(ys, x + distance) for x in xs) if ys else False


def _densest(places: list[int], width: int = WINDOW) -> int:
    """Most places within one window."""
    return max((bisect_right(places, x + width) - i for i, x in enumerate(places)), default=0)


#: Marks of a word: learned at all, and learned as a sign of a kind, which makes a sentence worth a look.
_LEARNED, _SIGN = 10, 11
#: Weight from which a learned word is a sign: e times as frequent as elsewhere.
SIGN_FROM = 1.0
_WORTH = _OFFENSIVE | 1 << _SIGN


class Features:
    """The dense features of texts, with the learned lexicon of one training."""

    def __init__(self, learned: Weights):
        self.learned = learned
        self.codes: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def code(self, word: str) -> int:
        got = self.codes.get(word)
        if got is None:
            own = self.learned.get(word)
            got = bits(word) | (0 if own is None else 1 << _LEARNED | (max(own) >= SIGN_FROM) << _SIGN)
            if len(self.codes) < MAX_CACHED:
                self.codes[word] = got
        return got

    def token(self, raw: str) -> int:
        """1000 if a raw token is worth a look, 1 if it is a single letter, else 0."""
        got = self.tokens.get(raw)
        if got is None:
            found, marks = _WORDS.read(raw)
            got = 1000 if marks & _HIDDEN or any(self.code(w) & _WORTH for w in found) else marks & _SINGLE
            if len(self.tokens) < MAX_CACHED:
                self.tokens[raw] = got
        return got

    def of(self, text: object) -> list[float]:
        out = dict.fromkeys(FEATURES, 0.0)
        if not isinstance(text, str) or not text.strip():
            return list(out.values())
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        upper, lower = int(((data >= 65) & (data <= 90)).sum()), int(((data >= 97) & (data <= 122)).sum())
        out["capitals"] = upper / max(1, upper + lower)
        out["marks"] = int(((data == 33) | (data == 63)).sum()) / len(text)
        cleaned = clean(text)
        tokens = cleaned.split()
        out["log_words"] = math.log1p(len(tokens))
        try:
            worth = sum(map(self.tokens.__getitem__, tokens))
        except KeyError:
            worth = sum(map(self.token, tokens))
        if worth < 3:  # three single letters may spell a word
            return list(out.values())
        offending = sexual_all = 0
        for words, disguised in _WORDS.sentences(cleaned):
            out["disguised"] += disguised
            found = [self.code(w) for w in words]
            if disguised or any([c & _WORTH for c in found]):
                a, b = self._sentence(words, found, out)
                offending += a
                sexual_all += b
        out["insult_density"] = offending / max(1, len(tokens))
        out["sexual_density"] = sexual_all / max(1, len(tokens))
        out["sexual"] = sexual_all
        return list(out.values())

    def _sentence(self, words: list[str], codes: list[int], out: dict[str, float]) -> tuple[int, int]:
        def top(name: str, value: float) -> None:
            if value > out[name]:
                out[name] = float(value)

        insults, violence, you, groups, degrading, sexual, neutral, profane, excluding, scorn = (
            [i for i, c in enumerate(codes) if c >> bit & 1] for bit in range(10)
        )
        if neutral:  # what is said beside such words is mostly talk about the matter
            insults, degrading, sexual, profane, violence = (
                [i for i in xs if not _near([i], neutral, WINDOW // 2)] for xs in (insults, degrading, sexual, profane, violence)
            )
        top("insults", _densest(insults))
        top("insult_near_you", _near(insults, you, 4))
        top("scorn_with_insult", _near(scorn, insults, 2))
        top("profane_near_you", _near(profane, you, 4))
        top("profane", _densest(profane))
        top("violence_near_you", _near(violence, you, 5))
        top("violence", _densest(violence))
        top("you", _densest(you))
        top("group_with_degrading", _near(groups, degrading, WINDOW) * _densest(degrading))
        top("group_with_excluding", _near(groups, excluding, WINDOW) * _densest(excluding))
        top("group_with_scorn", _near(groups, scorn, 5))
        top("degrading", _densest(degrading))
        top("groups", _densest(groups))
        top("sexual_most", _densest(sexual))
        top("sexual_near_you", _near(sexual, you, 4))
        top("neutral_beside", _densest(neutral))
        known = [(i, self.learned[w]) for i, w in enumerate(words) if codes[i] >> _LEARNED & 1]
        for k, kind in enumerate(KINDS):
            self._learned(kind, [(i, words[i], own[k]) for i, own in known if own[k]], top)
        return len(insults) + len(scorn), len(sexual)

    @staticmethod
    def _learned(kind: str, marks: list[tuple[int, str, float]], top) -> None:
        """The heaviest window of learned words, each word counted once."""
        first, held, weight = 0, Counter(), 0.0
        for i, word, own in marks:
            if not held[word]:
                weight += own
            held[word] += 1
            while marks[first][0] < i - WINDOW:
                _, old, less = marks[first]
                held[old] -= 1
                if not held[old]:
                    weight -= less
                first += 1
            top(f"learned_{kind}_most", own)
            if weight > 0:
                top(f"learned_{kind}_sum", weight)
                top(f"learned_{kind}_words", sum(1 for n in held.values() if n))


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, float(LEAF)
        self.base, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.leaf = max(LEAF, LEAF_SHARE * w.sum())
        share = float(np.clip((y * w).sum() / w.sum(), 1e-3, 1 - 1e-3))
        self.base = math.log(share / (1 - share))
        cuts = [self._cuts(column) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1).astype(np.uint8)
        # rows that fall into the same bins are one row with their summed weights
        cells, cell = np.unique(binned, axis=0, return_inverse=True)
        weight = np.bincount(cell.ravel(), w, len(cells))
        mean = np.bincount(cell.ravel(), w * y, len(cells)) / np.maximum(weight, 1e-12)
        score = np.full(len(cells), self.base)
        width = max(map(len, cuts)) + 1
        flat = cells.astype(np.int64) + np.arange(cells.shape[1]) * width
        usable = np.array([[j < len(c) for j in range(width)] for c in cuts])
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gain = np.zeros(len(cells))
            tree = self._grow(flat, np.arange(len(cells)), weight * (mean - p), weight * p * (1 - p), weight, usable, cuts, self.depth, gain)
            self.forest.append(tree)
            score += self.rate * gain
        return self

    def _cuts(self, column: np.ndarray) -> np.ndarray:
        values = np.unique(column)
        if len(values) > self.bins:
            return np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1]))
        return (values[:-1] + values[1:]) / 2

    def _grow(self, flat, rows, g, h, w, usable, cuts, depth, gain):
        """The tree over the cells ``rows``; their leaf values go to ``gain``."""
        own_g, own_h, own_w = g[rows], h[rows], w[rows]
        all_g, all_h, all_w = own_g.sum(), own_h.sum(), own_w.sum()
        value = float(all_g / (all_h + RIDGE))
        gain[rows] = value
        if depth == 0 or all_w < 2 * self.leaf:
            return value
        places, n = flat[rows].ravel(), usable.size
        repeat = flat.shape[1]
        gs, hs, ws = (np.bincount(places, np.repeat(v, repeat), n).reshape(usable.shape).cumsum(axis=1) for v in (own_g, own_h, own_w))
        better = gs**2 / (hs + RIDGE) + (all_g - gs) ** 2 / (all_h - hs + RIDGE) - all_g**2 / (all_h + RIDGE)
        better[~usable | (ws < self.leaf) | (all_w - ws < self.leaf)] = -1
        feature, bin_ = divmod(int(better.argmax()), usable.shape[1])
        if better[feature, bin_] <= GAIN:
            return value
        left = flat[rows, feature] <= feature * usable.shape[1] + bin_
        below = [self._grow(flat, part, g, h, w, usable, cuts, depth - 1, gain) for part in (rows[left], rows[~left])]
        return feature, float(cuts[feature][bin_]), *below

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        left = x[:, j] <= cut
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.forest:
            out += self.rate * self._walk(tree, x)
        return out


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: block borders and their calibrated values."""
    blocks: list[list[float]] = []
    for i in np.argsort(score, kind="stable"):
        blocks.append([score[i], y[i] * w[i], w[i], score[i]])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][3] or blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]):
            last = blocks.pop()
            blocks[-1] = [max(last[0], blocks[-1][0]), blocks[-1][1] + last[1], blocks[-1][2] + last[2], blocks[-1][3]]
    knots = [(x, b[1] / b[2]) for b in blocks for x in ({b[3], b[0]} if b[3] != b[0] else {b[0]})]
    knots.sort()
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class Model:
    """The forests of all folds of one kind, averaged, and the calibration of their held-out scores."""

    def __init__(self, folds: list[Boosted], knots: np.ndarray, values: np.ndarray):
        self.folds, self.knots, self.values = folds, knots, values

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.folds or not len(x):
            return np.zeros(len(x))
        return np.interp(sum(m.score(x) for m in self.folds) / len(self.folds), self.knots, self.values)


def fold_of(doc_id: int) -> int:
    """The fold of a document: all its reviews have the same."""
    return xxhash.xxh3_64_intdigest(str(doc_id)) % FOLDS


def train(x: np.ndarray, verdicts: list[str], folds: np.ndarray) -> dict[str, Model]:
    """A model per kind from the held-out features, verdicts and folds of at most ``MAX_LABELS`` reviews."""
    own = np.array(verdicts, dtype=object)
    out = {}
    for kind in KINDS:
        y = (own == kind).astype(float)
        w = np.where((own == kind) | (own == "clean"), 1.0, OTHER_KIND)
        if not y.any():
            out[kind] = Model([], np.array([0.0]), np.array([0.0]))
            continue
        held, models = np.empty(len(y)), []
        for k in range(FOLDS):
            inside, outside = folds != k, folds == k
            if not inside.any():
                continue
            models.append(Boosted().fit(x[inside], y[inside], w[inside]))
            held[outside] = models[-1].score(x[outside])
        seen = np.isin(folds, [k for k in range(FOLDS) if (folds != k).any()])
        if not seen.any():
            out[kind] = Model([], np.array([0.0]), np.array([0.0]))
            continue
        out[kind] = Model(models, *isotonic(held[seen], y[seen], w[seen]))
    return out


_COUNTED = "word STRING, cell INT, n BIGINT"


def _count_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counted: Counter = Counter()
    for frame in frames:
        for doc_id, verdict, text in zip(frame["doc_id"], frame["verdict"], frame["text"]):
            cell = fold_of(doc_id) * len(VERDICTS) + VERDICTS.index(verdict)
            counted["", cell] += 1
            if isinstance(text, str):
                counted.update((w, cell) for w in {w for words, _ in _WORDS.sentences(clean(text)) for w in words})
    yield pd.DataFrame([(*k, n) for k, n in counted.items()], columns=["word", "cell", "n"])


def word_counts(sample: DataFrame, least: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """By word, the reviews of each fold and verdict whose document holds it; the empty word counts all reviews.

    Words of fewer than ``least`` reviews can never be learned and stay on the executors.
    """
    counted = sample.mapInPandas(_count_batches, _COUNTED).groupBy("word", "cell").agg(F.sum("n").alias("n"))
    by_word = counted.groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"), F.sum("n").alias("all"))
    return [(r["word"], [tuple(c) for c in r["cells"]]) for r in by_word.where(F.col("all") >= least).collect()]


def lexicons(counted: list[tuple[str, list[tuple[int, int]]]]) -> list[Weights]:
    """The learned words without each fold, and of all folds last."""

    def without(fold: int) -> Weights:
        counts: Counts = {}
        for word, cells in counted:
            by: dict[str, int] = {}
            for cell, n in cells:
                if cell // len(VERDICTS) != fold:
                    verdict = VERDICTS[cell % len(VERDICTS)]
                    by[verdict] = by.get(verdict, 0) + n
            counts[word] = by
        return learn_words(counts, counts.pop("", {}))

    return [without(k) for k in (*range(FOLDS), -1)]


def sampled_reviews(documents: DataFrame, reviews: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``doc_id, verdict, text`` of at most ``max_labels`` reviews in hash order, written once."""
    verdicts = reviews.where(F.col("verdict").isin(*VERDICTS)).select("doc_id", "verdict")
    picked = verdicts.orderBy(F.xxhash64("doc_id", F.lit("train")), "verdict").limit(max_labels)
    return cut_lineage(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "verdict", "text"))


def fit(documents: DataFrame, reviews: DataFrame, max_labels: int = MAX_LABELS) -> tuple[Weights, dict[str, Model]]:
    """The learned lexicon and the models.

    Words are counted and features are made on the executors: a few hundred bytes a review come to the driver, never texts.
    """
    sample = sampled_reviews(documents, reviews, max_labels)
    *held_out, every = lexicons(word_counts(sample))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        makers = [Features(w) for w in held_out]
        for frame in frames:
            folds = [fold_of(d) for d in frame["doc_id"]]
            x = [makers[k].of(t) for k, t in zip(folds, frame["text"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "verdict": frame["verdict"], "fold": folds, "x": x})

    measured = sample.mapInPandas(batches, "doc_id BIGINT, verdict STRING, fold INT, x ARRAY<DOUBLE>").collect()
    measured.sort(key=lambda r: (r["doc_id"], r["verdict"], r["x"]))
    x = np.array([r["x"] for r in measured]).reshape(len(measured), len(FEATURES))
    return every, train(x, [r["verdict"] for r in measured], np.array([r["fold"] for r in measured], dtype=int))


def scores(documents: DataFrame, reviews: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``doc_id, source, abusive, hateful, sexual``: calibrated scores of every document."""
    learned, models = fit(documents, reviews, max_labels)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Features(learned)
        for frame in frames:
            x = np.array([maker.of(t) for t in frame["text"]]).reshape(len(frame), len(FEATURES))
            own = {kind: model.probability(x) for kind, model in models.items()}
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], **own})

    return documents.select("doc_id", "source", "text").mapInPandas(
        batches, "doc_id BIGINT, source STRING, abusive DOUBLE, hateful DOUBLE, sexual DOUBLE"
    )


def found(documents: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, kind``, one row per document and kind of content."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS])
    return scores(documents, reviews).select("doc_id", F.inline(kinds)).where(F.col("score") >= threshold).select("doc_id", "kind").distinct()


def source_rates(documents: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, and the share of each kind and of any."""
    hit = lambda k: F.col(k) >= threshold
    anyone = hit("abusive") | hit("hateful") | hit("sexual")
    return scores(documents, reviews).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        *[F.avg(hit(k).cast("double")).alias(f"{k}_rate") for k in KINDS],
        F.avg(anyone.cast("double")).alias("any_rate"),
    )
