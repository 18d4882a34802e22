"""Best-fit packing of token sequences by exact-complement hashing.

1. Documents are encoded and cut; each piece's length, place and checksum go to a table in the shared folder.
2. The pieces are counted by length. There are at most ``capacity`` lengths, so the counts, and nothing larger, go to the
   driver, where ``plan_sequences`` makes patterns (multisets of lengths with a number of repeats): from the longest
   length on, the gap is closed exactly by one available length, by a pair or by a triple, each looked up in the index of
   sums and used as often as the availability counts allow; what can't be closed exactly is filled best fit.
3. Every piece gets its rank among those of its length, in two steps: a rank within (length, bucket) and the bucket's
   first rank, so no task holds all pieces of a frequent length.
4. Ranks turn into (sequence, offset) by a binary search in the plan, which is broadcast: its size depends on the
   capacity, not on the number of pieces.

Triples are not stored one by one: a gap is looked up as one available length and an indexed pair of the rest.

Edge cases: null text is empty and has only the end token; very long texts become many pieces, of which only the last is
short; repeated rows are packed each; pieces of one length are interchangeable, so ties change which piece is where, not how
many sequences there are; pieces of the same document may be in different sequences; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm.tokens import LATIN_LETTERS, LATIN_NUMBERS, TokenCache, is_latin, shown
from paperloom.shipping import ship_package, then_released, written

_WORDS = re.compile(r"[^ \n\t\r]+")
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+")
PIECE_SCHEMA = "piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokenizer:
    """A tokenizer file's ids of whole texts, for models that work on words and drop white space.

    Texts of the first 256 characters are lower-cased and cut here; each piece goes to the library's model alone. All
    others are cut at white space, and each word goes through the library as a whole.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        model, lower = tokenizer.model, tokenizer.normalizer
        self.pieces = TokenCache(lambda x: [t.id for t in model.tokenize(shown(x))])
        self.words = TokenCache(lambda x: tokenizer.encode(x, add_special_tokens=False).ids)
        sample = "It's 12 Ärger, NAÏVE* don't\n''ll x2\xb2"
        # the shortcut is only for files whose rules are these
        self.short = self.pieces.ids(_PIECES.findall(sample.lower())) == self.words.ids(_WORDS.findall(sample)) and lower is not None

    def ids(self, text: str) -> bytes:
        if self.short and is_latin(text):
            return self.pieces.ids(_PIECES.findall(text.lower()))
        return self.words.ids(_WORDS.findall(text))


@functools.lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. The tokenizer must drop white space, so words can be encoded one by one."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_tokenizer(tokenizer_file)
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                value = value.as_py()
                ids = (cache.ids(value) if value else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    source.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(then_released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE_SCHEMA}")


class SumIndex:
    """Availability counts of lengths, with the number of available pairs of lengths for each sum."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()
        self.size = len(counts)
        self.have = self.n > 0
        self.pairs = np.zeros(self.size, np.int64)
        for a in np.flatnonzero(self.have):
            self._pairs_of(a, 1)

    def _pairs_of(self, a: int, by: int) -> None:
        """Adds or removes the sums of a with every available length up to a, and of larger ones with a."""
        other = np.flatnonzero(self.have)
        sums = other[other <= a] + a if by > 0 else other + a
        np.add.at(self.pairs, sums[sums < self.size], by)

    def take(self, pattern: dict[int, int], times: int) -> None:
        for length, m in pattern.items():
            self.n[length] -= m * times
            if self.n[length] == 0:
                self._pairs_of(length, -1)
                self.have[length] = False

    def single(self, gap: int) -> list[int]:
        return [gap] if self.have[gap] else []

    def pair(self, gap: int, used: tuple[int, ...] = ()) -> list[int]:
        if self.pairs[gap] <= 0:
            return []
        a = np.arange(gap // 2 + gap % 2, gap)
        found = a[self.have[a] & self.have[gap - a]]
        for x in found[::-1]:
            if self.fits([*used, int(x), gap - int(x)]):
                return [int(x), gap - int(x)]
        return []

    def triple(self, gap: int, used: tuple[int, ...] = ()) -> list[int]:
        a = np.arange(-(-gap // 3), gap - 1)
        for x in a[self.have[a] & (self.pairs[gap - a] > 0)][::-1]:
            if found := self.pair(gap - int(x), (*used, int(x))):
                return [int(x), *found]
        return []

    def fits(self, lengths: list[int]) -> bool:
        return all(self.n[x] >= lengths.count(x) for x in set(lengths))

    def exact(self, gap: int, used: list[int]) -> list[int]:
        """Up to three lengths that close the gap beside those used already."""
        if gap < 1 or gap >= self.size:
            return []
        found = self.single(gap)
        if found and self.fits(used + found):
            return found
        return self.pair(gap, tuple(used)) or self.triple(gap, tuple(used))


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: pieces of it}) until no piece is left; counts[length] pieces have that length.

    Every round uses up at least one length as far as its pattern can repeat, so the number of patterns depends on
    the capacity alone. A piece count is never exceeded and never left over.
    """
    index = SumIndex(np.asarray(counts)[: capacity + 1])
    out = []
    for longest in range(capacity, 0, -1):
        while index.n[longest] > 0:
            pattern, gap = [longest], capacity - longest
            while gap > 0:
                if found := index.exact(gap, pattern):
                    pattern += found
                    break
                rest = np.flatnonzero(index.have[: gap + 1])
                best = next((int(x) for x in rest[::-1] if index.n[x] > pattern.count(int(x))), 0)
                if not best:
                    break
                pattern.append(best)
                gap -= best
            counted = {x: pattern.count(x) for x in sorted(set(pattern), reverse=True)}
            times = int(min(index.n[x] // m for x, m in counted.items()))
            index.take(counted, times)
            out.append((times, counted))
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that is stored (it is read several times)."""
    spark = pieces.sparkSession
    ship_package(spark)
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    total = int(histogram.sum())
    buckets = min(4096, max(16, -(-total // 262_144)))
    # for each length: ranks from, pieces of it in a sequence, place of the first, first sequence
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, pattern in plan_sequences(histogram, capacity):
        place = 0
        for length, m in pattern.items():
            entries.setdefault(length, []).append((int(used[length]), m, place, sequence))
            used[length] += m * times
            place += m * length
        sequence += times
    first = np.cumsum([0] + [len(entries.get(x, ())) for x in range(capacity + 1)])
    table = np.array([e for x in range(capacity + 1) for e in entries.get(x, ())], np.int64).reshape(-1, 4)
    # one ascending key for all lengths: the rank is below 2^48
    keys = np.repeat(np.arange(capacity + 1, dtype=np.int64), np.diff(first)) * (1 << 48) + table[:, 0]
    shared = spark.sparkContext.broadcast((keys, table))

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("first_rank")).drop("bucket", "first_rank")

    def place_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            names = batch.schema.names
            length, r = (batch.column(names.index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "r"))
            e = table[np.searchsorted(keys, length * (1 << 48) + r, side="right") - 1]
            j = r - e[:, 0]
            kept = [k for k in names if k != "r"]
            made = [pa.array(e[:, 3] + j // e[:, 1]), pa.array(e[:, 2] + j % e[:, 1] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(k)) for k in kept] + made, names=[*kept, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "r"]
    return ranked.mapInArrow(then_released(place_of), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(token_pieces(docs, tokenizer_file, capacity, end_id, doc_id, text), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
