"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams of letters, word ends as a letter of their own) is counted over all documents. Its letters
   are those of Latin-1; letters of other scripts count as word ends.
2. Words written with digits, signs or look-alike letters of other scripts for letters, with letters repeated three times or more,
   or spaced out letter by letter become lattices: every character is read as itself, as the letters it is used for, or as
   nothing. Viterbi decoding finds the reading of least cost under the channel's costs and the language model. It takes time in
   proportion to a word's length, and words of any length are decoded.
3. A document's features are the words, and beginnings of words, of its text and of its restored words, and beginnings that
   two or three different words share. Those that labelled documents tell apart (log-likelihood ratio) get weights by
   logistic regression. A word, or a beginning of five letters or more, that only toxic documents have, and many of them, is enough
   alone, whatever the regression says: the score is at least its share of toxic documents under a cautious prior.

The classifier is fitted on at most ``max_training_rows`` labelled documents (those whose ids have the smallest
hashes), a bound that is a parameter; language model and scores cover every document and its whole text. Labels are read only from
rows whose crc32(id as text) mod 3 isn't 1.

Edge cases: null and empty texts have no features and the score of the bias alone; very long texts are read whole; a label that
is null, or whose document is missing, isn't used; of several labels of one id the larger counts; without both kinds of labels every
score is the share of toxic labels (0 without any); ties between readings go to the first in alphabetical order; repeated rows are
scored each; an empty table gives an empty result; of clashing columns only the named ones are read, and all are kept.
"""

from __future__ import annotations

import math
import os.path
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.shipping import ship_package, then_released, written

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What signs are used for letters, and its cost; a sign can also mean nothing.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
#: Letters of other scripts that look like Latin ones, and the letters they look like.
LOOKALIKES = dict(zip("абвгԁеһіјкӏмпорԛѕтуѵԝхуʏѕɡαβεηικνορτυχωɑℓⅼ", "abbrdehijklmnopqstyvwxyysgabenikvoptuxwall"))
#: OTHER_COST: a look-alike is itself, among Latin letters.
LEET_COST, UNUSED_COST, DROP_COST, REPEAT_COST, SPACE_COST, GAP_COST, END_COST, OTHER_COST = 1.5, 12.0, 2.0, 0.7, 0.3, 5.0, 8.0, 12.0
_TABLE = np.zeros(256, np.int64)
for _c, _i in CODE.items():
    _TABLE[ord(_c)] = _i
_RUN = re.compile(r"(.)\1\1+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?![^\W_])")
#: What every phrase that is spaced letter by letter has inside. A search begins at separators, so most texts are passed over fast.
_SPACED_INSIDE = re.compile(r"[ .\-_*][^\W_][ .\-_*]{1,2}[^\W_][ .\-_*]{1,2}[^\W_](?![^\W_])")
_ALPHA = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6, 7)
#: The share of toxic documents that a word must be in to be enough alone.
ALONE_SHARE = 0.1
#: Steps of decoding after which what all readings have in common is put aside.
SETTLED = 64


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter follows each two, over all texts; the table's size is that of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                value = value.as_py()
                if value:
                    c = np.concatenate(([0, 0], _TABLE[np.frombuffer(value.lower().encode("latin-1", "replace"), np.uint8)], [0]))
                    before = np.where(c[1:-1] == 0, 0, c[:-2])
                    total += np.bincount((before * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(SIZE**3, np.int64)
    for gram, n in docs.select(text).mapInArrow(then_released(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect():  # at most SIZE^3 rows
        out[gram] = n
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(trigrams: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a letter after two: trigrams, bigrams and single letters interpolated."""
    one = trigrams.sum((0, 1)) + 1.0
    two = trigrams.sum(0) + 0.0
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (trigrams + 5 * p2[None]) / (trigrams.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def readings(word: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each character what it can stand for, with costs; "" is nothing, a space a word's end."""
    out = []
    for i, c in enumerate(word):
        options = []
        if c in CODE:
            options.append((c, 0.0))
            if i and word[i - 1] == c:
                options.append(("", REPEAT_COST))
        elif c.isalpha():
            options.append((c, OTHER_COST if c in LOOKALIKES else 0.0))
            if c in LOOKALIKES:
                options.append((LOOKALIKES[c], LEET_COST))
        else:
            options += [(x, LEET_COST) for x in LEET.get(c, "")]
            options.append(("", SPACE_COST if c in " .-_*" else UNUSED_COST if c in LEET else DROP_COST))
            options.append((" ", GAP_COST if c in " .-_*" else END_COST))
        out.append(options)
    return out


def viterbi(word: str, costs: np.ndarray) -> str:
    """The reading of least cost; ties go to the first in alphabetical order."""
    best, settled = {(0, 0): (0.0, "")}, []
    for i, options in enumerate(readings(word), 1):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, made) in best.items():
            for x, extra in options:
                if x == "":
                    state, new = (a, b), (cost + extra, made)
                elif x == " " and b == 0:
                    state, new = (a, b), (cost + extra, made)
                else:
                    c = CODE.get(x, 0)
                    state, new = (b if c else 0, c), (cost + extra + float(costs[a, b, c]), made + x)
                if state not in after or new < after[state]:
                    after[state] = new
        best = after
        if i % SETTLED == 0:
            settled.append(os.path.commonprefix([made for _, made in best.values()]))
            best = {state: (cost, made[len(settled[-1]) :]) for state, (cost, made) in best.items()}
    last = min(((cost + (float(costs[a, b, 0]) if b else 0.0), made) for (a, b), (cost, made) in best.items()), default=(0.0, ""))[1]
    return "".join([*settled, last]).strip()


def _inner(word: str) -> str:
    return word.strip("\"'.,;:?()[]{}#%&*-_/\\~`^=»«…").rstrip("!.,;:?\"'")


_LOOKALIKE, _FORM = re.compile(f"[{''.join(LOOKALIKES)}]"), re.compile("[\u2001-\U0010ffff]")


def _mixed_scripts(word: str) -> bool:
    """Letters of other scripts that look Latin beside Latin ones, or forms of letters that stand for plain ones (full width, bold)."""
    if word.isascii():
        return False
    if _LOOKALIKE.search(word) and any(c in CODE for c in word):
        return True
    return _FORM.search(word) is not None and word != plain_letters(word)


def plain_letters(word: str) -> str:
    """Forms of Latin letters and digits as these: full width, bold, circled. Accents and other scripts stay."""
    if word.isascii():
        return word
    made = []
    for c in word:
        x = unicodedata.normalize("NFKC", c).lower() if ord(c) > 0x2000 else c
        made.append(x if x != c and len(x) == 1 and x.isascii() and x.isalnum() else c)
    return "".join(made)


def is_noisy(word: str) -> bool:
    """Letters mixed with signs used for letters or with look-alikes, signs between letters, or a letter three times."""
    if _mixed_scripts(word):
        return True
    if word.isalpha():
        return _RUN.search(word) is not None
    inner = _inner(word)
    if inner.isalpha():
        return _RUN.search(inner) is not None
    letters = sum(c.isalpha() for c in inner)
    return 0 < letters and letters + sum(c in LEET for c in inner) >= 3


def _cut_runs(word: str) -> str:
    return _RUN.sub(lambda m: m[1] * 3, word)


def restore(word: str, costs: np.ndarray) -> str:
    """A noisy word's likely spelling: runs of a letter are first cut to three."""
    return viterbi(_cut_runs(_inner(plain_letters(word))), costs)


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in _PREFIXES if len(word) >= k)]


def shared_features(words: Iterable[str]) -> list[str]:
    """2:x and 3:x for beginnings x of at least two and three of the words."""
    counts = Counter(w[:k] for w in words for k in _PREFIXES if len(w) >= k)
    return [f"{m}:{x}" for x, n in counts.items() if n > 1 for m in range(2, min(n, 3) + 1)]


class Reader:
    """From texts to the features of their words, plain and restored; a bounded cache keeps what tokens gave.

    known: the model's features, by which words that have none of them are passed over.
    """

    def __init__(self, costs: np.ndarray, known: dict[str, int] | None = None, generation: int = 150_000):
        self.costs, self.known, self.cache, self.generation = costs, known, {}, generation
        self.parts = None if known is None else {f for f in known if ":" not in f} | {f[2:] for f in known if ":" in f}
        # by its first letters most words are passed over
        self.heads = None if known is None else {f.removeprefix("=")[: _PREFIXES[0]] for f in self.parts}

    def _of(self, token: str) -> tuple[str, ...]:
        words = [token] if token.isalpha() else _ALPHA.findall(token)
        if is_noisy(token):
            words += _ALPHA.findall(restore(token, self.costs))
        if self.heads is not None:
            n = _PREFIXES[0]
            words = [w for w in words if w[:n] in self.heads and any(f in self.parts for f in word_features(w))]
        return tuple(dict.fromkeys(words)) if words else ()

    def features(self, text: str) -> set:
        text = text.lower()
        tokens = set(text.split())
        if _SPACED_INSIDE.search(text):
            tokens.update(spaced[0] for spaced in _SPACED.finditer(text))
        if missing := tokens.difference(self.cache):
            if len(self.cache) > self.generation:
                self.cache, missing = {}, tokens
            for t in missing:
                self.cache[t] = self._of(t)
        words = set()
        for w in map(self.cache.__getitem__, tokens):
            if w:
                words.update(w)
        if not words:
            return set()
        found = {f for w in words for f in word_features(w)}
        found.update(shared_features(words))
        return found if self.known is None else {self.known[f] for f in found if f in self.known}


class Model(NamedTuple):
    costs: np.ndarray
    known: dict[str, int]
    weights: np.ndarray
    alone: np.ndarray
    bias: float

    def score(self, features: set[int]) -> float:
        at = sorted(features)
        share = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[at].sum())))))
        return max(share, float(self.alone[at].max(initial=0.0)))


def logistic_regression(rows: list[list[int]], labels: np.ndarray, width: int, l2: float = 0.002, rounds: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights of binary features and the bias, by Adam on all rows; the penalty is on the mean loss."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(col, err[at], width), err.sum()) / len(rows)
        g[:-1] += l2 / width * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def _log_likelihood_ratio(pos: str, neg: str, p: int, n: int):
    """Twice the log-likelihood ratio of a feature that toxic documents have more often, else zero."""
    a, b = F.col(pos).cast("double"), F.col(neg).cast("double")
    c, d, t = F.lit(float(p)) - a, F.lit(float(n)) - b, float(p + n)
    term = lambda x, row, col: F.when(x > 0, x * F.log(x * t / (row * col))).otherwise(0.0)
    g = 2 * (term(a, a + b, F.lit(float(p))) + term(b, a + b, F.lit(float(n))) + term(c, c + d, F.lit(float(p))) + term(d, c + d, F.lit(float(n))))
    return F.when(a * n > b * p, g).otherwise(0.0)


def fit(
    docs: DataFrame, labels: DataFrame, max_training_rows: int = 20_000, max_features: int = 3_000, least_ratio: float = 13.0,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    spark = docs.sparkSession
    ship_package(spark)
    costs = language_model(count_trigrams(docs, text))
    usable = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    chosen = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_training_rows)
    sample = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "y"), "labelled")
    shared = spark.sparkContext.broadcast(costs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(shared.value), {}

        def out() -> pa.RecordBatch:
            values = np.array(list(found.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(values[:, 0]), pa.array(values[:, 1])], names=["feature", "pos", "neg"])

        for batch in batches:
            for value, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for f in reader.features(value.as_py() or ""):
                    found.setdefault(f, [0, 0])[0 if y else 1] += 1
                if len(found) > 100_000:
                    yield out()
                    found.clear()
        yield out()

    kinds = {bool(y): n for y, n in sample.groupBy((F.col("y") != 0).alias("y")).count().collect()}
    p, n = kinds.get(True, 0), kinds.get(False, 0)
    if not p or not n:
        share = p / (p + n) if p + n else 0.0
        return Model(costs, {}, np.zeros(0), np.zeros(0), 30.0 if share == 1 else -30.0)
    counted = sample.mapInArrow(then_released(count), "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = counted.filter("pos > 1").withColumn("g", _log_likelihood_ratio("pos", "neg", p, n)).filter(F.col("g") >= least_ratio)
    best = ranked.orderBy(F.desc("g"), "feature").limit(max_features).select("feature", "pos", "neg").collect()
    known = {r["feature"]: i for i, r in enumerate(best)}
    sure = [r["neg"] == 0 and r["pos"] >= ALONE_SHARE * p and (r["feature"][0] == "=" or (":" not in r["feature"] and len(r["feature"]) >= 5)) for r in best]
    alone = np.array([(r["pos"] + 0.5) / (r["pos"] + 3) if x else 0.0 for r, x in zip(best, sure)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(reader.features(v.as_py() or "")) for v in batch.column(0)], pa.list_(pa.int32())), batch.column(1)], names=["f", "y"])

    found = sample.mapInArrow(then_released(rows), "f array<int>, y int").collect()  # at most max_training_rows rows of max_features numbers
    found.sort(key=lambda r: (r["y"], r["f"]))  # in a fixed order, so that sums are the same each time
    weights, bias = logistic_regression([r["f"] for r in found], np.array([float(r["y"] != 0) for r in found]), len(known))
    return Model(costs, known, weights, alone, bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of the documents, and the score of each whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader, none = Reader(model.costs, model.known), model.score(set())
        for batch in batches:
            scores = [model.score(f) if (f := reader.features(v.as_py() or "")) else none for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    return docs.mapInArrow(then_released(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    name = f"score_{uuid.uuid4().hex}"  # a name that no table has
    return score(docs, fit(docs, labels, doc_id=doc_id, text=text), text, name).filter(F.col(name) < threshold).drop(name)
