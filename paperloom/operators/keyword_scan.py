"""Keywords of one text, in Python: its words and phrases are counted and ranked where the text is, so that no word is shuffled.

A text is read by its parts between white space. What a part has (words, phrase pieces, the end of a sentence) depends on the part
alone and is remembered for parts without digits. Letters and digits are those of Python's Unicode tables.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from paperloom.functions.fixed_values import KEYWORD_STOPWORDS
from paperloom.operators.scan import stand_in

#: Scores are compared to so many decimals; ties go to what comes first in the text.
DIGITS = 9
#: Parts that are remembered.
REMEMBERED = 100_000

_STOP_SET = frozenset(KEYWORD_STOPWORDS)
_DIGIT = re.compile(r"\d")
_ZEROS = dict.fromkeys(map(ord, "123456789"), "0")
_OTHER = re.compile(r"[^a-z0-9_\-]+")

#: keyword and score, the best first
Ranked = list[tuple[str, float]]


def _trie(words: tuple[str, ...]) -> str:
    """A pattern of the words that prefers longer ones, as their list from the longest to the shortest would."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    inner = "|".join(re.escape(c) + _trie(tuple(rest)) for c, rest in sorted(heads.items()))
    return f"(?:{inner})" + ("?" if "" in words else "")


_STOP = re.compile(rf"\b{_trie(KEYWORD_STOPWORDS)}\b")


def _kept(c: str) -> bool:
    return c in "_-" or unicodedata.category(c)[0] in "LN"


class Parts(dict):
    """What parts have: words, whether a sentence ends, and the pieces between stopwords, each as its token (or None) and whether
    anything is left of it."""

    def __init__(self, least: int):
        self.least, self.letters = least, re.compile(rf"\b[a-z]{{{least},}}\b")
        #: tokens that were shorter than least before they were written in lower case
        self.short: set[str] = set()
        #: Of parts of ASCII with digits, each written as 0: what they have if no stopword is in them. Digits are in no word.
        self.shapes: dict[str, tuple[tuple[str, ...], bool] | None] = {}

    def __missing__(self, part: str) -> tuple:
        low = part.lower()
        if not part.isascii() or not _DIGIT.search(part):
            out = self._whole(part, low)
            if len(self) < REMEMBERED and not _DIGIT.search(part):
                self[part] = out
            return out
        shape = low.translate(_ZEROS)
        if shape in self.shapes:
            known = self.shapes[shape]
        else:
            words, ends, _, _, more = self._whole(shape, shape)
            known = None if more else (words, ends)
            if len(self.shapes) < REMEMBERED:
                self.shapes[shape] = known
        if known is None:
            return self._whole(part, low)
        x = _OTHER.sub("", low)
        return (*known, x if len(x) >= self.least else None, 1 if x else 0, ())

    def _whole(self, part: str, low: str) -> tuple:
        words = tuple(w for w in self.letters.findall(low) if w not in _STOP_SET)
        if part.isascii():
            cut = _STOP.split(low)
            kept = [(x, x) for x in (_OTHER.sub("", x) for x in cut)]
        else:
            at, cut = 0, []
            for m in _STOP.finditer(stand_in(part).lower()):
                cut.append(part[at : m.start()])
                at = m.end()
            kept = [(x, x.lower()) for x in ("".join(filter(_kept, x)) for x in [*cut, part[at:]])]
        pieces = []
        for x, token in kept:
            if len(x) < self.least <= len(token):
                self.short.add(token)
            pieces.append((token if len(token) >= self.least else None, 1 if x else 0))
        return (words, part[-1] in ".!?", *pieces[0], pieces[1:])

    def read(self, text: str) -> tuple[list[list[str]], list[list[str]]]:
        """The words of each sentence, and those of each phrase."""
        sentences, phrases = [], []
        sentence: list[str] = []
        phrase: list[str] = []
        filled, open_ = 0, False
        for part in text.split():
            words, ends, token, some, more = self[part]
            if words:
                sentence += words
            open_ = not ends
            if ends:
                sentences.append(sentence)
                sentence = []
            filled += some
            if token:
                phrase.append(token)
            for token, some in more:
                if phrase and not (filled == 1 and phrase[0] in self.short):
                    phrases.append(phrase)
                phrase, filled = [token] if token else [], some
        if open_:
            sentences.append(sentence)
        if phrase and not (filled == 1 and phrase[0] in self.short):
            phrases.append(phrase)
        return sentences, phrases


def rounded(score: float) -> int:
    """The score in units of the last decimal that counts, halves up as the engine rounds."""
    x = score * 10**DIGITS
    low = math.floor(x)
    if abs(x - low - 0.5) < 1e-3:
        return int(Decimal(repr(score)).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return low + (x - low > 0.5)


def _best(scores: dict[str, float], top: int) -> Ranked:
    """From scores in the order of their keywords' places."""
    items = list(scores.items())
    near = [score * 10**DIGITS + 0.5 for _, score in items]
    keys = list(map(int, near))
    for i, (x, k) in enumerate(zip(near, keys)):
        if not 1e-3 < x - k < 0.999:
            keys[i] = rounded(items[i][1])
    return [items[i] for i in sorted(range(len(keys)), key=keys.__getitem__, reverse=True)[:top]]


def tfidf(sentences: list[list[str]], top: int) -> Ranked:
    """A text's sentences are the corpus of its words' document frequencies."""
    n, tf, df = len(sentences), {}, {}
    for words in sentences:
        if words:
            size, counts = len(words), {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            for w, c in counts.items():
                if w in tf:
                    tf[w] += c / size
                    df[w] += 1
                else:
                    tf[w], df[w] = c / size, 1
    weights = {d: math.log((n + 1) / (d + 1)) + 1 for d in set(df.values())}
    return _best({w: x * weights[df[w]] for w, x in tf.items()}, top)


def rake(phrases: list[list[str]], top: int) -> Ranked:
    """Phrases by their words' degree and frequency."""
    count: dict[str, int] = {}
    degree: dict[str, int] = {}
    keys: dict[str, list[str]] = {}
    for words in phrases:
        size = len(words)
        for w in words:
            count[w] = count.get(w, 0) + 1
            degree[w] = degree.get(w, 0) + size
        keys.setdefault(" ".join(words), words)
    scores = {w: d / count[w] for w, d in degree.items()}
    return _best({key: sum([scores[w] for w in words]) for key, words in keys.items()}, top)


def merged(sentences: list[list[str]], phrases: list[list[str]], top: int) -> Ranked:
    """The best 2 * top of either kind, scores of equal keywords added up."""
    scores = dict(tfidf(sentences, 2 * top))
    for key, score in rake(phrases, 2 * top):
        scores[key] = scores[key] + score if key in scores else score
    return _best(scores, top)


class Several:
    """The same for several texts of one id: equal words at equal places of sentences of equal length and number are counted as one."""

    def __init__(self) -> None:
        self.words: dict[tuple[int, int, int, str], list[int]] = {}
        self.count: dict[str, int] = {}
        self.degree: dict[str, int] = {}
        self.keys: dict[str, tuple[int, list[str]]] = {}

    def add(self, sentences: list[list[str]], phrases: list[list[str]]) -> None:
        for at, words in enumerate(sentences):
            for i, w in enumerate(words):
                x = self.words.setdefault((len(sentences), at, len(words), w), [0, i])
                x[0] += 1
                x[1] = min(x[1], i)
        for i, words in enumerate(phrases):
            for w in words:
                self.count[w] = self.count.get(w, 0) + 1
                self.degree[w] = self.degree.get(w, 0) + len(words)
            key = " ".join(words)
            self.keys[key] = min((i, words), self.keys.get(key, (i, words)))

    def _first(self, rows: list[tuple[float, tuple, str]], top: int) -> Ranked:
        return [(key, score) for score, _, key in sorted(rows, key=lambda x: (-rounded(x[0]), x[1], x[2]))[:top]]

    def tfidf(self, top: int) -> Ranked:
        sums: dict[tuple[int, str], list] = {}
        for (n, at, size, w), (c, i) in self.words.items():
            x = sums.setdefault((n, w), [0, [], (at, i)])
            x[0] += 1
            x[1].append(c / size)
            x[2] = min(x[2], (at, i))
        return self._first([(math.fsum(tf) * (math.log((n + 1) / (df + 1)) + 1), first, w) for (n, w), (df, tf, first) in sums.items()], top)

    def rake(self, top: int) -> Ranked:
        return self._first([(math.fsum(self.degree[w] / self.count[w] for w in words), (i,), key) for key, (i, words) in self.keys.items()], top)

    def merged(self, top: int) -> Ranked:
        scores: dict[str, list] = {}
        for source, rows in enumerate((self.tfidf(2 * top), self.rake(2 * top))):
            for rank, (key, score) in enumerate(rows):
                x = scores.setdefault(key, [0.0, (source, rank)])
                x[0] += score
        return self._first([(score, first, key) for key, (score, first) in scores.items()], top)


def letters(least: int) -> Callable[[str], list[str]]:
    """The lower-case words of at least so many letters a-z of a text, in order."""
    found = re.compile(rf"\b[a-z]{{{least},}}\b").findall
    return lambda text: found(text.lower())


def frequent(words: list[str], top: int) -> list[tuple[str, int]]:
    """The most frequent words, ties as they first occur."""
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return sorted(counts.items(), key=lambda x: -x[1])[:top]


class SeveralCounts:
    """The same for several texts of one id; ties by the first place in any of them, then by the word."""

    def __init__(self) -> None:
        self.counts: dict[str, list[int]] = {}

    def add(self, words: list[str]) -> None:
        for i, w in enumerate(words):
            x = self.counts.setdefault(w, [0, i])
            x[0] += 1
            x[1] = min(x[1], i)

    def best(self, top: int) -> list[tuple[str, int]]:
        return [(w, n) for w, (n, _) in sorted(self.counts.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))[:top]]
