import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import exact_dedup, packing, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            kept = i == keep and first
            first = first and not kept
            out[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


ROWS = [
    (1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, " "), (7, "\x0b\x0c"), (8, "a b"), (8, "a b"), (None, "a b"),
    (None, "alone"), (9, "é" * 50_000), (10, "é" * 50_000), (11, "a\xa0b"), (12, "A b")
]


@pytest.mark.parametrize("hot_rows", [2, 2000])
def test_groups_match_brute_force(spark, hot_rows):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("d", "t", "n", "salt", "salts", "keep", "members", "keep_id")})
    got = Counter(map(tuple, exact_dedup.duplicate_groups(docs, hot_rows=hot_rows).collect()))
    assert got == brute_groups(ROWS)


def test_hot_group_is_salted_and_whole(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("text"))
    rows = exact_dedup.duplicate_groups(docs, hot_rows=20).filter("group_size > 1").collect()
    assert len(rows) == 167 and {r.keep_id for r in rows} == {0} and {r.group_size for r in rows} == {167} and sum(r.kept for r in rows) == 1


def test_hot_group_is_never_in_one_task(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = exact_dedup.duplicate_groups(docs, hot_rows=20)
        rows = groups.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 2000 and {(r.keep_id, r.group_size) for r in rows} == {(0, 2000)} and [r.doc_id for r in rows if r.kept] == [0]
    assert max(Counter(r.task for r in rows).values()) < 1000


def test_colliding_digests_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda text, bits: F.lit("00" * 32))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = Counter(tuple(r)[:4] for r in exact_dedup.duplicate_groups(docs, hot_rows=2).collect())
    want = Counter()
    for row, n in brute_groups(ROWS).items():
        want[row[:4]] += n
    assert got == want


def test_dropping_keeps_columns_and_rows_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("keep_id", F.lit("own"))
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 4, 6, 9, 11, 12]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0
    assert packing.pack_documents(empty, WORDS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65) if lengths else np.zeros(65, np.int64)
    used = np.zeros(65, np.int64)
    n = 0
    for times, pattern in packing.plan_sequences(counts, 64):
        assert times > 0 and sum(x * m for x, m in pattern.items()) <= 64
        n += times
        for x, m in pattern.items():
            used[x] += times * m
    assert (used == counts).all()
    # never more than first fit decreasing
    bins = []
    for x in sorted(lengths, reverse=True):
        i = next((i for i, b in enumerate(bins) if b + x <= 64), None)
        if i is None:
            bins.append(x)
        else:
            bins[i] += x
    assert n <= len(bins) + 1


def test_exact_complements_fill_sequences():
    counts = np.zeros(101, np.int64)
    for a, n in ((100, 3), (60, 5), (40, 5), (50, 4), (20, 2), (30, 2), (45, 2), (25, 2)):
        counts[a] += n
    plan = packing.plan_sequences(counts, 100)
    assert sum(t for t, _ in plan) == -(-int((counts * np.arange(101)).sum()) // 100)


def test_packing_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "word " * 5000), (-3, "word " * 5000), (-4, "<|endoftext|> É\x1cx")], "doc_id long, text string"
    ))
    rows = packing.pack_documents(docs, WORDS, 512).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[(r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(places) <= 1.02 * -(-total // 512) + 1


def test_short_way_agrees_with_the_library_on_random_latin_text():
    rnd = np.random.default_rng(6)
    signs, plain = [chr(c) for c in range(256)], list("etaoin  \n'sS01-._")
    library, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    library.encode_special_tokens = True
    assert own.short
    for _ in range(400):
        text = "".join(signs[rnd.integers(256)] if rnd.random() < 0.4 else plain[rnd.integers(len(plain))] for _ in range(rnd.integers(0, 200)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_reaches_the_lower_bound(spark, small):
    rows = packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet"), WORDS).select("sequence_id", "length").collect()
    full = sum(r.length == 2048 for r in rows)
    rest = sum(r.length for r in rows if r.length < 2048)
    assert len({r.sequence_id for r in rows}) <= full + -(-rest // 2048) + 1


def test_query_is_registered():
    assert "op6_exact_complement_packing" in queries.QUERIES and "op7_skew_safe_exact_dedup" in queries.ORACLE_SQL
