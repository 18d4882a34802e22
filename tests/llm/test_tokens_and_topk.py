import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import byte_bpe, topk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "it's  a\n\n test\t", "<|endoftext|>", "é😀́ \xa0x\x0b\x1cy", "x" * 5000, "don't 12½ ² ª µ ÷", "﻿ﬁ　日本語", "a\r\n  b  "]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_encoding_matches_tiktoken(spark):
    rnd = random.Random(5)
    signs = "ab 'stllve\n\t  \r\xa0\x0b\x1c\x85é😀́ß1２٣$%€​﻿ªµ½"
    texts = TEXTS + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    rows = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, byte_bpe.LATIN_PATTERN, outputs=("ids", "starts", "ends", "decoded", "ids_sha256", "decoded_sha256")).collect()
    e = reference()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = e.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = list(zip(r.starts, r.ends))
        assert all(a < b for a, b in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text)))


def test_split_characters_share_a_span():
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    assert bpe.spans("é😀 ab")[1:3] == [(1, 2), (1, 2)]
    assert bpe.decode(bpe.encode("é😀 ab")[4:8]) in "é😀 ab".encode() and bpe.decode(b"") == b""


def brute(rows, modulo, k):
    ok = {}
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    for q in ok:
        if q % modulo == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q][0], w)), i) for i, ws in ok.items() if i != q for w in ws)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_top_k_matches_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rnd.normal(size=6), 1)]) for i in range(300)]
    rows += [
        (300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []),
        (350, [0.0] * 6), (305, [1.0, 2.0]), (306, rows[0][1]), (None, [1.0] * 6)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.select("vec_id", topk.floor_weights(F.col("embedding")).alias("weights"))
    for block in (64, 16_384):
        got = defaultdict(list)
        for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5, candidate_block=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert dict(got) == brute(rows, 50, 5)


def test_few_candidates_and_none(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, weights array<double>")
    assert [tuple(r) for r in topk.top_k(v, v.filter("vec_id = 0")).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_repeated_queries_and_candidates(spark):
    """Equal query rows are one query; equal candidates are ranked each; rows of one id with other vectors are queries each."""
    rows = [(50, [1.0, 0.0, 2.0]), (50, [1.0, 0.0, 2.0]), (50, [0.0, 1.0]), (1, [5.0]), (2, [0.0, 7.0]), *[(3, [1.0, 1.0, 1.0])] * 9, (4, [0.0] * 5000 + [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, weights array<double>").withColumns({c: F.lit(1) for c in ("id", "w", "no", "cell", "copies", "score")})
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id = 50"), 4).collect())
    first, second = [(1, 5), (3, 3), (3, 3), (3, 3)], [(2, 7), (3, 1), (3, 1), (3, 1)]
    assert got == sorted((50, i + 1, *x) for found in (first, second) for i, x in enumerate(found))


def test_postings_are_sparse_and_exact():
    rows = [[0.0, 3.0], [], [2.0**40, 0.0, 5.0], [0.0] * 1000 + [1.0]]
    ends = np.cumsum([0, *map(len, rows)])
    cell = topk.Postings(np.arange(4), ends, np.array([x for r in rows for x in r]))
    assert len(cell.place) == 4 and cell.scores(np.array([2.0, 5.0])).tolist() == [15, 0, 2**41, 0]
    assert cell.scores(np.array([2.0**40, 1.0, 1.0])).tolist() == [3, 0, 2**63 - 1, 0] and cell.scores(np.zeros(0)).tolist() == [0] * 4
    assert cell.scores(np.array([-(2.0**22), 0.0, 1.0])).tolist() == [0, 0, 5 - 2**62, 0]


def test_latin_fast_path_agrees_with_the_library_on_random_text():
    rnd = random.Random(7)
    signs = [chr(c) for c in range(256)]
    bpe, right = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, byte_bpe.LATIN_PATTERN), reference()
    for _ in range(300):
        text = "".join(rnd.choice(signs) if rnd.random() < 0.4 else rnd.choice("etaoin  \n'sS01") for _ in range(rnd.randint(0, 200)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == right.encode_ordinary(text)
