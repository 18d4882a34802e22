"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merge ranks come from a rank file (base64 bytes and a rank per line). Bytes become printable characters by the
usual reversible table, the library merges them, and decoding looks up each id's bytes and joins them: characters whose
bytes are split over tokens come back whole, and bytes that are no UTF-8 stay bytes.

The pattern cuts a text into pieces, whose ids come from a bounded cache. Texts of the first 256 characters can be cut by
``latin_pattern``, the same pattern for the standard library's faster engine.

Edge cases: null is the empty text, which has no ids; ids, names of special tokens in a text are ordinary text; very long
words are encoded whole and not cached; repeated rows are encoded each; ties don't arise; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from paperloom.llm.tokens import LATIN_LETTERS, LATIN_NUMBERS, TokenCache, byte_characters, is_latin, shown
from paperloom.shipping import ship_package, then_released

#: public patterns' classes written for texts that ``is_latin`` accepts
_L, _N = LATIN_LETTERS, LATIN_NUMBERS
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts from which each token is made: what lower ranks alone make of its bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else 1 << 40)
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBpe:
    """encode: text to ids; spans: each token's place in the text; decode: ids to bytes."""

    def __init__(self, rank_file: str, pattern: str, latin_pattern: str | None = None):
        ranks = read_ranks(rank_file)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        chars = byte_characters()
        name = lambda token: "".join(chars[b] for b in token)
        self.model = models.BPE(vocab={name(t): i for t, i in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges_of(ranks)])
        self.cache = TokenCache(lambda piece: [t.id for t in self.model.tokenize(shown(piece))])
        self.pattern, self.latin = regex.compile(pattern), re.compile(latin_pattern) if latin_pattern else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.cache.ids((self.latin if self.latin and is_latin(text) else self.pattern).findall(text))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """First and last place (exclusive) of each token in code points; parts of a split character have its span."""
        out, at = [], 0
        starts = []
        for i, c in enumerate(text):
            starts += [i] * len(c.encode())
        for i in np.frombuffer(self.encode(text), "<u4"):
            n = len(self.table[i])
            out.append((starts[at], starts[at + n - 1] + 1))
            at += n
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(rank_file: str, pattern: str, latin_pattern: str | None = None) -> ByteBpe:
    return ByteBpe(rank_file, pattern, latin_pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, latin_pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, n_tokens and the outputs asked for: ids, starts and ends (code points), decoded (bytes), ids_sha256, decoded_sha256."""
    ship_package(docs.sparkSession)
    kinds = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    arrow = {"array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "string": pa.string()}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern, latin_pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, made = [], {k: [] for k in outputs}
                for value in part.column(1).to_pylist():
                    value = value or ""
                    ids = bpe.encode(value)
                    n.append(len(ids) // 4)
                    decoded = bpe.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
                    spans = bpe.spans(value) if "starts" in made or "ends" in made else []
                    for k, out in made.items():
                        out.append(
                            np.frombuffer(ids, "<u4").astype("i4") if k == "ids" else [a for a, _ in spans] if k == "starts" else [b for _, b in spans] if k == "ends"
                            else decoded if k == "decoded" else hashlib.sha256(ids if k == "ids_sha256" else decoded).hexdigest()
                        )
                columns = [part.column(0), pa.array(n, pa.int64())] + [pa.array(made[k], arrow[kinds[k]]) for k in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *outputs])

    return rows.mapInArrow(then_released(run), f"doc_id {id_type}, n_tokens bigint" + "".join(f", {k} {kinds[k]}" for k in outputs))
