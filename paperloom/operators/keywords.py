"""Ranked keywords: words by TF-IDF over a document's sentences, phrases by degree and frequency, and both together.

Texts are dealt out by id once and ranked in Arrow batches by keyword_scan.py; their words aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import KEYWORD_STOPWORDS
from paperloom.operators import keyword_scan
from paperloom.shipping import ship_package, then_released

#: Longest first, so that contractions win over their beginnings.
STOP_PATTERN = r"(?i)\b(?:" + "|".join(sorted(KEYWORD_STOPWORDS, key=lambda w: (-len(w), w))) + r")\b"
#: Texts whose ranks are in memory at a time.
SLICE = 1_000


def _by_id(docs: DataFrame, doc_id: str, text: str, names: tuple[str, str], kind: str, reader: Callable[[], tuple]) -> DataFrame:
    """doc_id, rank and two columns of each id's ranked items. reader: makes functions for a text that is its id's only one, and, for
    the texts of other ids and of none, a new collector, which takes a text (and whether it has an id), and its result.

    Texts of one id follow each other, and the first of them says how many there are. Ids of one text, as ids should be, need no
    collector; those of many keep only what is counted.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "text", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"), F.col("doc_id").isNotNull().alias("named"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, new, add, result = reader()
        several, seen = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows_of, ranks, items = [], [], []
                for i, (t, n, named) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))):
                    if n == 1 and named:
                        found = single(t) if t else ()
                    else:
                        several = new() if seen == 0 else several
                        seen += 1
                        if t:
                            add(several, t, named)
                        if seen < n:
                            continue
                        found, several, seen = result(several), None, 0
                    rows_of += [i] * len(found)
                    ranks += range(1, len(found) + 1)
                    items += found
                shown, values = zip(*items) if items else ((), ())
                columns = [part.column(0).take(pa.array(rows_of, pa.int32())), pa.array(ranks, pa.int32()), pa.array(shown, pa.string()), pa.array(values, kinds[kind])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rank", *names])

    kinds = {"double": pa.float64(), "bigint": pa.int64()}
    return rows.mapInArrow(then_released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rank int, {names[0]} string, {names[1]} {kind}")


def _keywords(docs: DataFrame, doc_id: str, text: str, least: int, single: Callable[[list, list], list], result: Callable[[keyword_scan.Several], list]) -> DataFrame:
    def reader() -> tuple:
        read = keyword_scan.Parts(least).read

        def add(several: keyword_scan.Several, t: str, named: bool) -> None:
            s, p = read(t)
            several.add(s, p if named else [])  # words' scores are found by id, so rows without one have no phrases

        return (lambda t: single(*read(t))), keyword_scan.Several, add, result

    return _by_id(docs, doc_id, text, ("keyword", "score"), "double", reader)


def sentence_tfidf(docs: DataFrame, top: int = 30, least: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rank, keyword, score; a document's sentences are the corpus of its words' document frequencies."""
    return _keywords(docs, doc_id, text, least, lambda s, _: keyword_scan.tfidf(s, top), lambda several: several.tfidf(top))


def phrases(docs: DataFrame, top: int = 30, least: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rank, keyword, score: what is left between stopwords, scored by its words' degree and frequency."""
    return _keywords(docs, doc_id, text, least, lambda _, p: keyword_scan.rake(p, top), lambda several: several.rake(top))


def keywords(docs: DataFrame, top: int = 15, least: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rank, keyword, score: the best 2 * top of either kind, scores of equal keywords added up."""
    return _keywords(docs, doc_id, text, least, lambda s, p: keyword_scan.merged(s, p, top), lambda several: several.merged(top))


def word_frequencies(docs: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rank, term, n: the most frequent words of two letters or more; ties as they first occur (by id within a larger key)."""
    letters = keyword_scan.letters(2)

    def reader() -> tuple:
        single = lambda t: keyword_scan.frequent(letters(t), top)
        return single, keyword_scan.SeveralCounts, (lambda several, t, _: several.add(letters(t))), (lambda several: several.best(top))

    return _by_id(docs, key, text, ("term", "n"), "bigint", reader).withColumnRenamed("doc_id", key)
