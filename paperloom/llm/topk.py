"""Exact top-k inner products by term-at-a-time accumulation.

A vector is a sparse row of weighted terms (its non-zero components). Candidates are dealt into cells once; a cell is an inverted
index, with a posting list (candidates and their weights) for each term, and stays where it is. Blocks of distinct query
rows are sent to every cell, a stated query set against all rows. There every term of a query scatters its weight times its
postings into a dense array of scores; the best k come from partition selection, and the cells' winners are merged by query.

Scores are exact: 64-bit integers where the bounds of a cell and a block show that nothing overflows, else Python integers,
which are then clipped to the range of a long.

Edge cases: vectors that are null or hold a null or non-finite component take no part; an empty vector scores 0 with
everything; vectors of other lengths meet on their common terms, and a very long one costs no other row anything; a query is no
candidate of its own id; ties go to the smaller id; fewer candidates than k give fewer rows; repeated rows are candidates each,
but one query; rows of one id with different vectors are queries each, ranked each; null ids take no part; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.shipping import ship_package, then_released, written

#: Candidates of a cell at most (about), and queries that are sent together.
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 512
_LONG = 1 << 63


def floor_weights(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a double; null where a vector takes no part."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.call_function("floor", v * F.lit(scale)).cast("double")))


class Postings:
    """The inverted index of a cell: for each term its candidates, in ascending places, and their weights."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, flat: np.ndarray):
        """Rows of weights one after another: row i is flat[ends[i] : ends[i + 1]]."""
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)
        term = np.arange(len(flat)) - np.repeat(ends[:-1], size)
        there = np.flatnonzero(flat)
        order = there[np.argsort(term[there], kind="stable")]
        self.ids, self.place, self.weight = ids, row[order], flat[order]
        self.starts = np.searchsorted(term[order], np.arange(int(size.max(initial=0)) + 1))
        self.most = float(np.abs(flat).max(initial=0))
        self._whole: np.ndarray | None = None

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The inner product of each candidate with a query row, one term at a time."""
        terms = np.flatnonzero(query[: len(self.starts) - 1])
        bound = self.most * float(np.abs(query[terms]).max(initial=0)) * max(len(terms), 1)
        if bound < 2**62:
            if self._whole is None and self.most < 2**62:
                self._whole = self.weight.astype(np.int64)
            weight, out = self._whole, np.zeros(len(self.ids), np.int64)
            wanted = query[terms].astype(np.int64).tolist()
        else:
            weight, out = np.array([int(x) for x in self.weight], object), np.zeros(len(self.ids), object)
            wanted = [int(x) for x in query[terms]]
        for t, w in zip(terms.tolist(), wanted):
            a, b = self.starts[t], self.starts[t + 1]
            if b - a == len(out):  # every candidate has the term
                out += w * weight[a:b]
            else:  # a candidate is in a list once
                out[self.place[a:b]] += w * weight[a:b]
        return out if out.dtype == np.int64 else np.clip(out, -_LONG, _LONG - 1).astype(np.int64)


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the rows, from 0, and their values one after another."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.flatten().to_numpy(zero_copy_only=False)


def select_best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best (score descending, id ascending) other than the query's own."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s = scores[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= least]
    return at[np.lexsort((ids[at], -scores[at].astype(object) if (scores[at] == -_LONG).any() else -scores[at]))][:k]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    weights: str = "weights",
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score. weights: arrays of doubles with integer values; null where a row takes no part."""
    spark = vectors.sparkSession
    ship_package(spark)
    clean = lambda df: df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(weights).cast("array<double>").alias("w")).dropna()
    # equal rows are counted before they are dealt; more than k of them can't be in any answer
    counted = clean(vectors).groupBy("id", "w").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    candidates = written(counted, "candidates").select("id", "w", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    asked = clean(queries).distinct()
    # numbered queries are stored, so that a repeated task sees the same numbers
    asked = written(asked.withColumn("no", F.monotonically_increasing_id()), "queries")
    n = candidates.count()
    cells = max(1, -(-n // candidate_block), min(spark.sparkContext.defaultParallelism, n // 1_024))
    # a candidate goes to one cell, a query to all; in a cell, the candidates come first
    dealt = candidates.select(F.pmod(F.xxhash64("id", "w"), F.lit(cells)).cast("int").alias("cell"), F.lit(-1).cast("bigint").alias("no"), "id", "w")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "no", "id", "w")
    met = dealt.unionByName(sent).repartition(cells, "cell").sortWithinPartitions("cell", "no")

    def answers(cell: Postings, own: list[int], numbers: list[int], ends: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        found = [(np.zeros(0, np.int64),) * 4]
        for i, (q, no) in enumerate(zip(own, numbers)):
            s = cell.scores(flat[ends[i] : ends[i + 1]])
            at = select_best(s, cell.ids, q, k)
            found.append((np.full(len(at), no), np.full(len(at), q), cell.ids[at], s[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["no", "query_id", "vec_id", "score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, cell = None, [], None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1, append=-1))
            for start, end in zip(edges[:-1], edges[1:]):
                part = batch.slice(start, end - start)
                if part.column(0)[0].as_py() != number:
                    number, parts, cell = part.column(0)[0].as_py(), [], None
                split = int(np.searchsorted(part.column(1).to_numpy(), 0))
                if split:
                    parts.append(part.slice(0, split))
                for at in range(split, part.num_rows, QUERY_BLOCK):
                    if cell is None:
                        rows = pa.concat_arrays([x.column(3) for x in parts]) if parts else part.column(3).slice(0, 0)
                        ids = np.concatenate([np.zeros(0, np.int64), *(x.column(2).to_numpy() for x in parts)])
                        cell, parts = Postings(ids, *_ragged(rows)), []
                    block = part.slice(at, QUERY_BLOCK)
                    yield answers(cell, block.column(2).to_pylist(), block.column(1).to_pylist(), *_ragged(block.column(3)))

    best = met.mapInArrow(then_released(score), "no bigint, query_id bigint, vec_id bigint, score bigint")

    # a query has k rows of each cell; array_sort over structs merges them without a Python call per query
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("o"), "vec_id", "score")
    merged = best.groupBy("no", "query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("b"))
    return merged.select("query_id", F.posexplode("b").alias("i", "m")).select("query_id", (F.col("i") + 1).alias("rank"), "m.vec_id", "m.score")
