import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import golay, toxicity


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_golay_code_is_perfect():
    table = golay.decode_table()
    assert (np.bincount(table, minlength=4096) == 2048).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints_within_four_bits_share_a_key(seed):
    rnd = np.random.default_rng(seed)
    a = rnd.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rnd.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = []
    for x in (a, b):
        found = [set() for _ in range(len(x))]
        for row, key in zip(*(z.tolist() for z in golay.keys_within_four(x))):
            found[row].add(key)
        keys.append(found)
    assert all(x & y for x, y in zip(*keys))


def test_groups_match_brute_force(spark, small):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = list(base)
    for k in range(40):
        text = [rnd.choice(words) for _ in range(rnd.choice([5, 80, 900]))]
        for copy in range(rnd.choice([1, 2, 30])):
            changed = list(text)
            changed[rnd.randrange(len(changed))] = rnd.choice(words)
            rows.append((10_000 + 100 * k + copy, " ".join(changed)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "One"), (20_004, "one"), (20_005, "É b"), (20_006, "é b"), (20_007, "z " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("node", "fp0", "a", "b", "component_id", "key")})
    assert sorted(map(tuple, golay.near_duplicate_groups(docs).collect())) == brute(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001)]
    got = dict(map(tuple, golay.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000), 5000: 5000, 5001: 5000}
    assert golay.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_are_dropped_and_others_stay(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, copies = [], set()
    for k in range(60):
        text = [word() for _ in range(300)]
        rows.append((k * 10, " ".join(text)))
        if k % 2:
            changed = list(text)
            changed[150] = word()
            rows.append((k * 10 + 1, " ".join(changed)))
            copies.add(k * 10 + 1)
        half = text[:150] + [word() for _ in range(150)]
        rows.append((k * 10 + 2, " ".join(half)))
    rows += [(9000, None), (9001, ""), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    kept = golay.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, _ in rows} - copies
    assert clean <= ids and len(ids & copies) <= 1


def test_a_large_group_of_near_copies_keeps_one(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(i % 4):
            text[rnd.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(50)] + [(2000, rows[0][1]), (2000, rows[0][1])]

    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    kept = [r.doc_id for r in golay.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "b", "node", "s", "in_a")})).collect()]
    near = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    clean = set(range(1000, 1050))
    assert 0 in kept and clean <= set(kept) and 2000 not in kept
    assert sum(any(near(i, j) for j in kept if j < i) for i in kept) <= 2


def test_links_of_a_large_group_do_not_depend_on_its_hub(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        text = list(base)
        for at in rnd.sample(range(5, 395), 7 + i % 2):
            text[at] = word()
        rows.append((i, " ".join(text)))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    near = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    assert all(near(i, 1000) for i in range(60)) and sum(near(i, j) for i in range(60) for j in range(i)) < 60
    kept = {r.doc_id for r in golay.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0}  # all are linked to 1000, so one stays


def near_groups(rows, least=0.8):
    """The smallest id of each group of near copies, over all pairs."""
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def test_large_group_of_copies_near_the_threshold_matches_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, base = [], [word() for _ in range(150)]
    for i in range(700):  # blocks of a cluster meet blocks; a third of the copies are linked to none
        text = list(base)
        for at in rnd.sample(range(150), rnd.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            text[at] = word()
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, right = {r.doc_id for r in golay.drop_near_duplicates(docs).collect()}, near_groups(rows)
    assert 50 < len(right) < 650 and kept == right


def test_sketches_lose_no_pair_and_tell_most_others():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for size, similarity, passes in ((90, 0.8, True), (900, 0.8, True), (9000, 0.8, True), (90, 0.7, False), (900, 0.65, False)):
        common = round(2 * size * similarity / (1 + similarity) + 1e-9)
        for _ in range(100):
            shared = draw(common)
            sets = [np.concatenate((shared, draw(size - common))) for _ in range(2)]
            true = common / (2 * size - common)
            bits = golay.distance(*(np.frombuffer(golay.parity_sketch(x), "<u8") for x in sets))
            assert (bits <= golay.most_odd_cells(np.array([2 * size]), min(0.8, true) if passes else 0.8)[0]) == passes


def test_near_copies_need_whole_number_ids_and_stay_whole(spark):
    with pytest.raises(ValueError):
        golay.drop_near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, text, 7), (2, text + " end", 8), (2, "other words of the same id", 9), (3, "short", 1), (4, "short", 2), (None, text, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, cluster int").withColumns({c: F.lit(1) for c in ("s", "group", "home", "n", "id", "__id")})
    kept = golay.drop_near_duplicates(docs)
    assert kept.schema == docs.schema and sorted((r.doc_id or 0, r.cluster) for r in kept.collect()) == [(0, 3), (1, 7), (3, 1)]
    assert golay.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_with_repeated_lines_are_dropped(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(20):
        text, line = [word() for _ in range(304)], [word() for _ in range(12)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + 20 * line))]
    kept = {r.doc_id for r in golay.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 40, 2)) <= kept and len(kept) <= 21, len(kept)


def test_candidate_bits_lose_no_isolated_pairs():
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    lost = 0
    for _ in range(1000):
        common = draw(267)  # of 300 each: a similarity of 0.80
        bits = 0
        sets = [np.concatenate((common, draw(33))) for _ in range(2)]
        for k in range(golay.WIDE_WORDS):
            sets = [golay._mixed(h) for h in sets] if k else sets
            bits += (golay.simhash(sets[0]) ^ golay.simhash(sets[1])).bit_count()
        lost += bits > golay.CANDIDATE_BITS
    assert lost <= 2


def labelled(spark, n=900, seed=1):
    rnd = random.Random(seed)
    plain = ["the", "there", "other", "thing", "hand", "stone", "river", "anthem", "lantern", "gather", "winter", "motor"]
    bad = ["idiot", "stupid", "worthless", "moron"]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(spark)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).filter("held").collect()
    assert len(scored) > 200 and sum((r.score >= 0.7) == (r.toxic == 1) for r in scored) >= 0.98 * len(scored)
    extra = spark.createDataFrame(
        [
            (1, "river 1d1ot stone"), (2, "hand s t u p i d thing"), (3, "motor worthlessss winter"), (4, "river stone hand"), (5, None),
            (6, ""), (7, "m0r0n the")
        ],
        "doc_id long, text string"
    )
    got = {r.doc_id: r.score for r in toxicity.score(extra, model).collect()}
    assert all(got[i] >= 0.7 for i in (1, 2, 3, 7)) and all(got[i] < 0.7 for i in (4, 5, 6))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 720


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = labelled(spark)
    docs = rows.select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = rows.select("doc_id", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = toxicity.fit(docs, rows.select("doc_id", "toxic")), toxicity.fit(docs, turned)
    assert a.known == b.known and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r.score < 0.7 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {True}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_viterbi_prefers_the_language():
    counts = np.zeros((toxicity.SIZE,) * 3)
    for word in ("idiot", "stupid", "other"):
        codes = [0, 0, *(toxicity.CODE[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a if b else 0, b, c] += 100
    costs = toxicity.language_model(counts)
    for noisy in ("1d10t", "i.d.i.o.t", "i d i o t", "idiooot", "!d!ot"):
        assert toxicity.restore(noisy, costs) == "idiot"
    assert toxicity.restore("$tup1d", costs) == "stupid" and not toxicity.is_noisy("other") and not toxicity.is_noisy("12345")


def test_long_spaced_and_repeated_words_are_restored(spark):
    rows = labelled(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    spaced = " ".join("theriverworthlessidiot")
    texts = [spaced, f"river {spaced} stone", ".".join("gatherwinterstupidmoron"), "1d1" + "o" * 60 + "t", "river " + " ".join("stoneanthem" * 6), "x7q" * 20]
    got = [r.score >= 0.7 for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert len(spaced) > 40 and got == [True, True, True, True, False, False]
    texts = ["rivеr", "stone idiоt", "ѕtuрid river", "ｉｄｉｏｔ", "𝐬𝐭𝐮𝐩𝐢𝐝 hand", "слово и дело", "the mоtor", "1d1ot" * 9]
    got = [r.score >= 0.7 for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == [False, True, True, True, True, False, False, True]


def test_spaced_phrases_are_never_passed_over():
    rnd = random.Random(9)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab1é  .-_*\n") for _ in range(rnd.randint(0, 30)))
        assert toxicity._SPACED_INSIDE.search(text) or not toxicity._SPACED.search(text), text


def best_reading(word, costs):
    """All readings of a word, one after another."""
    lattice, best = toxicity.readings(word), None

    def go(i, a, b, cost, made):
        nonlocal best
        if i == len(lattice):
            found = (cost + (float(costs[a, b, 0]) if b else 0.0), made)
            best = found if best is None or found < best else best
            return
        for x, extra in lattice[i]:
            if x == "" or (x == " " and b == 0):
                go(i + 1, a, b, cost + extra, made)
            else:
                c = toxicity.CODE.get(x, 0)
                go(i + 1, b if c else 0, c, cost + extra + float(costs[a, b, c]), made + x)

    go(0, 0, 0, 0.0, "")
    return best[1].strip()


def test_viterbi_finds_the_best_of_all_readings():
    rnd = random.Random(4)
    counts = np.zeros((toxicity.SIZE,) * 3)
    for word in ("idiot", "stupid", "other", "élan", "a", "is"):
        codes = [0, 0, *(toxicity.CODE[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a if b else 0, b, c] += rnd.randint(1, 90)
    for costs in (toxicity.language_model(counts), toxicity.language_model(np.random.default_rng(1).integers(0, 9, (toxicity.SIZE,) * 3))):
        for _ in range(150):
            word = "".join(rnd.choice("idotsup1!0$@. -5ео|") for _ in range(rnd.randint(0, 8)))
            assert toxicity.viterbi(word, costs) == best_reading(word, costs), word


def test_toxic_documents_are_dropped_beside_clashing_columns(spark):
    rows = labelled(spark)
    docs = rows.withColumns({c: F.lit(1) for c in ("score", "__score", "features")})
    kept = toxicity.drop_toxic(docs, rows.select("doc_id", "toxic"))
    assert kept.columns == docs.columns and kept.count() == 720


def test_decoding_in_parts_is_decoding_of_the_whole(monkeypatch):
    counts = np.random.default_rng(2).integers(0, 50, (toxicity.SIZE,) * 3)
    costs, rnd = toxicity.language_model(counts), random.Random(2)
    words = ["".join(rnd.choice("abest014$. -") for _ in range(300)) for _ in range(5)]
    parts = [toxicity.viterbi(w, costs) for w in words]
    monkeypatch.setattr(toxicity, "SETTLED", 10**9)
    assert parts == [toxicity.viterbi(w, costs) for w in words] and all(len(x) > 100 for x in parts)
