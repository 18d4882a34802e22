"""Extractive summaries by ranking a graph of sentences. The ranking iterates within a document, so it runs over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.shipping import ship_package

_LETTERS = re.compile(r"\b[a-z]{3,}\b")
LEAST_WORDS, MOST_WORDS = 5, 80


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", re.sub(r"\s+", " ", text)) if s.strip()]


def sentence_ranks(sentences: list[str], damping: float = 0.85, most_rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray | None:
    """PageRank over sentences that share words, weighted by cosine; None if it doesn't settle.

    The similarity matrix is never made: it is the product of the term matrix with its transpose, so a round takes
    time and memory in proportion to the words.
    """
    terms: dict[str, int] = {}
    row, col, val = [], [], []
    for i, s in enumerate(sentences):
        counts: dict[int, int] = {}
        for w in _LETTERS.findall(s.lower()):
            t = terms.setdefault(w, len(terms))
            counts[t] = counts.get(t, 0) + 1
        norm = sum(c * c for c in counts.values()) ** 0.5
        for t, c in counts.items():
            row.append(i)
            col.append(t)
            val.append(c / norm)
    n = len(sentences)
    r, c, v = np.array(row, np.int64), np.array(col, np.int64), np.array(val)
    own = np.bincount(r, v * v, n)  # the diagonal, which is no edge

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(r, v * np.bincount(c, v * x[r], len(terms))[c], n) - own * x if len(r) else np.zeros(n)

    strength = times(np.ones(n))
    strength[strength < 1e-12] = 0.0
    linked = strength > 0
    if not linked.any():
        return 1.0 / np.arange(1, n + 1)
    x = np.full(n, 1.0 / n)
    for _ in range(most_rounds):
        share = np.divide(x, strength, out=np.zeros(n), where=linked)
        new = damping * (times(share) + x[~linked].sum() / n) + (1 - damping) / n
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return None


def summary(text: str | None, most: int = 5, damping: float = 0.85, most_rounds: int = 100) -> str:
    if not text or not text.strip():
        return ""
    sentences = split_sentences(text)
    kept = [s for s in sentences if LEAST_WORDS <= len(s.split()) <= MOST_WORDS]
    if not kept:
        return sentences[0] if sentences else ""
    if len(kept) <= most:
        return " ".join(kept)
    ranks = sentence_ranks(kept, damping, most_rounds)
    best = range(most) if ranks is None else sorted(np.argsort(-np.round(ranks, 12), kind="stable")[:most].tolist())
    return " ".join(kept[i] for i in best)


def summaries(docs: DataFrame, most: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, summary."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([summary(x.as_py(), most) for x in batch.column(1)], pa.string())], names=["doc_id", "summary"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, summary string")
