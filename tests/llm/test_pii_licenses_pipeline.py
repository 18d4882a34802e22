import datetime
import hashlib
import re
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import licenses, pii, queries

KEY = "k"


def feistel(digits, kind):
    n = len(digits)
    u = n // 2
    a, b = int(digits[:u] or 0), int(digits[u:])
    f = lambda part, i: int(hashlib.sha256(f"{KEY}|{kind}|{i}|{n}|{part}".encode()).hexdigest()[:15], 16)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + f(b, i)) % 10**u
        else:
            b = (b + f(a, i)) % 10 ** (n - u)
    return (str(a).zfill(u) if u else "") + str(b).zfill(n - u)


def luhn(number):
    d = [int(c) for c in number][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def iban_valid(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def only(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_feistel_matches_a_plain_version_and_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 16, 19):
        values = [str(random.Random(n * 100 + i).randrange(10**n)).zfill(n) for i in range(20)]
        got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.feistel_digits(F.col("v"), F.lit(KEY), "x").alias("p")).collect()
        assert all(r.p == feistel(r.v, "x") for r in got)
    assert spark.range(1000).select(pii.feistel_digits(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(KEY), "x").alias("p")).distinct().count() == 1000


def test_cards_stay_valid_and_linked(spark):
    a, b, c = only(spark, "pay 4532015112830366.", "card 4532-0151-1283-0366", "acct 4952935900253052!!")
    first, second = re.search(r"\d{16}", a)[0], re.search(r"[\d-]{19}", b)[0]
    assert first != "4532015112830366" and luhn(first) and second.replace("-", "") == first and a.endswith(".")
    assert re.fullmatch(r"acct \d{16}!!", c) and "4952935900253052" not in c
    # without a valid check digit a number is no card
    assert only(spark, "at 1700000000123 of 4111111111111112") == ["at 1700000000123 of 4111111111111112"]


def test_every_kind_keeps_its_format(spark):
    texts = [
        "mail Jo.Doe99@mail3.example.com now", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ip 169.122.221.182.",
        "on 2024-01-15", "on 15.01.2024", "on 01/15/2024", "ssn 123-45-6789", "+1 (017) 555-7713", "tel 555-123-4567"
    ]
    got = only(spark, *texts)
    for before, after in zip(texts, got):
        assert after != before and len(after) == len(before) or "ip" in before or "mail" in before
    assert re.fullmatch(r"mail [a-z]{2}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.com now", got[0])
    assert iban_valid(got[1]) and iban_valid(got[2]) and got[2][4:8] == "WEST"
    ip = re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+)\.", got[3])
    assert all(0 <= int(x) <= 255 for x in ip.groups())
    days = {datetime.datetime.strptime(t[3:], f).date() for t, f in zip(got[4:7], ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"))}
    assert len(days) == 1 and days != {datetime.date(2024, 1, 15)}


def test_social_security_numbers_stay_valid_and_apart(spark):
    rnd = random.Random(1)
    valid = lambda x: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) is not None
    numbers = ["001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999"]
    while len(numbers) < 800:
        x = f"{rnd.randrange(900):03}-{rnd.randrange(100):02}-{rnd.randrange(10000):04}"
        numbers += [x] if valid(x) and x not in numbers else []
    got = only(spark, *numbers)
    assert all(map(valid, got)) and len(set(got)) == len(numbers)
    plain, areas = [], 898 * 99
    f = lambda part, i: int(hashlib.sha256(f"{KEY}|ssn|{i}|9|{part}".encode()).hexdigest()[:15], 16)
    for x in numbers:
        area, group, serial = map(int, x.split("-"))
        a, b = (area - 1 - (area > 666)) * 99 + group - 1, serial - 1
        for i in range(pii.ROUNDS):
            a, b = ((a + f(b, i)) % areas, b) if i % 2 == 0 else (a, (b + f(a, i)) % 9999)
        area = a // 99 + 1
        plain.append(f"{area + (area >= 666):03}-{a % 99 + 1:02}-{b + 1:04}")
    assert got == plain
    assert only(spark, "000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000") == ["000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000"]


def test_addresses_have_pseudonyms_of_their_own(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [*letters, *(a + b for a in letters for b in letters), *(f"{a}{i}" for a in "xyz" for i in range(10)), "Jo.Doe", "a-very.long_name+" + "of"
             * 20 + "42" * 30, "5", "55", "..x"]
    got = only(spark, *(f"{n}@mail.example.com" for n in names))
    assert len(set(got)) == len(names) and len({x.split("@")[1] for x in got}) == 1
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", x.lower()))
    assert all(shape(x.split("@")[0]) == shape(n) for n, x in zip(names, got)) and all(x.endswith(".com") for x in got)
    assert only(spark, "JO.Doe@Mail.example.COM") == [got[names.index("Jo.Doe")]]
    assert {x.split("@")[0] for x in got[:26]} == set(letters)


def test_dates_in_all_forms(spark):
    day = datetime.date(2020, 3, 25)
    forms = ["2020-03-25", "2020-3-25", "25.03.2020", "25.3.2020", "03/25/2020", "25/03/2020", "3/25/2020", "25/3/2020"]
    got = only(spark, *forms)
    read = [datetime.date(*map(int, x.split("-"))) for x in got[:2]] + [
        datetime.datetime.strptime(x, f).date() for x,
        f in zip(got[2:], ("%d.%m.%Y", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%m/%d/%Y", "%d/%m/%Y"))
    ]
    assert len(set(read)) == 1 and read[0] != day
    days = [(datetime.date(1850, 1, 1) + datetime.timedelta(7 * i)).isoformat() for i in range(2000)]
    assert len(set(only(spark, *days))) == 2000
    assert only(spark, "31.2.2020 and 30/30/2020 1.2.3.4.5") == ["31.2.2020 and 30/30/2020 1.2.3.4.5"]


def test_report_matches_a_plain_version(spark):
    """Which matches are found, by another engine's expressions, and that the rest of the text stays."""
    rnd = random.Random(3)
    items = [
        "4532015112830366", "4532 0151 1283 0366", "4532015112830367", "a.b@c-d.org", "10.0.0.7", "300.1.1.1", "2024-02-30", "2024-02-29",
        "123-45-6789", "000-45-6789", "+49 301 234 5678", "GB82WEST12345698765432", "GB83WEST12345698765432"
    ]
    valid = {"4532015112830366", "4532 0151 1283 0366", "a.b@c-d.org", "10.0.0.7", "2024-02-29", "123-45-6789", "+49 301 234 5678", "GB82WEST12345698765432"}
    texts = [[rnd.choice(["plain", "words", *items]) for _ in range(12)] for _ in range(60)]
    df = spark.createDataFrame([(i, " , ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.pseudonym_report(df, KEY).collect():
        after, before = r.text.split(" , "), texts[r.doc_id]
        assert [a != b for a, b in zip(after, before)] == [b in valid for b in before] and len(after) == len(before)
        assert r.n_email == before.count("a.b@c-d.org") and r.changed == any(b in valid for b in before)


def test_the_key_is_not_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "parts", "__parts", "original")})
    for out in (pii.pseudonymise(df, "very-secret"), pii.pseudonym_report(df, "very-secret")):
        assert "very-secret" not in out._jdf.queryExecution().toString() and out.collect()
    assert pii.pseudonymise(df, "k").columns == df.columns


def test_what_is_not_personal_stays(spark):
    texts = [None, "", "version 2.0. and 4.0", "2024-13-40", "999.1.1.1", '"b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "DE00 3704 0044 0532 0130 00", "word " * 20_000, "mark  here"]
    assert only(spark, *texts) == texts


def test_report_counts_and_columns(spark):
    df = spark.createDataFrame([(1, "a@b.com 4532015112830366 a@b.com", 5)], "doc_id long, text string, parts int")
    r = pii.pseudonym_report(df, KEY).first()
    assert (r.n_email, r.n_card, r.n_phone, r.changed) == (2, 1, 0, True)
    assert pii.pseudonymise(df, KEY).columns == df.columns
    assert pii.pseudonym_report(df.limit(0), KEY).count() == 0


def test_other_keys_give_other_pseudonyms(spark):
    df = spark.createDataFrame([(1, "4532015112830366")], "doc_id long, text string")
    assert pii.pseudonymise(df, "one").first().text != pii.pseudonymise(df, "two").first().text


MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
TEXTS = [
    MIT, "Some text.\nLicensed under the Apache License, Version 2.0.",
    "x. Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License.", None, "", "the licence of nobody",
    "All rights reserved; no license is granted. See the GNU General Public License for more details.", "a | license | b",
    "long " * 30_000 + ". This work is licensed under the GNU General Public License, version 3."
]


def test_licences(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "left0", "licenses")})
    got = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    assert [got[i].licenses for i in range(9)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0; MIT", "", "", "", "", "", "GPL-3.0"]
    assert got[0].sentence_ids == "MITtitle MITperm MITnotice AsIs NoLiability" or got[0].sentence_ids == "MITperm MITnotice AsIs NoLiability"
    assert got[6].leftover_ids == "GPLsee" and got[2].n_sentence_ids == 3
    assert licenses.license_report(docs.limit(0)).count() == 0


def test_licences_match_sql(spark):
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(licenses.report_sql()).fetchall())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(map(tuple, licenses.license_report(docs).collect())) == want


def test_broken_lines_and_wide_spaces_match_sql(spark):
    """Known sentences in any order and dress, all by the SQL that has no filter by keywords."""
    import pandas as pd

    rnd = random.Random(11)
    known = [s for _, s in licenses.SENTENCES]

    def dressed(sentence):
        words = [w.upper() if rnd.random() < 0.1 else w for w in sentence.split()]
        return "".join(w + rnd.choice([" ", "  ", "\n", "\t", ", ", " - ", "\r\n  "]) for w in words[:-1]) + words[-1]

    texts = [" ".join(dressed(rnd.choice(known)).capitalize() + rnd.choice([".", "!", ".\n\n", ";"]) for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    texts += [dressed(s) for s in known]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = sorted(con.execute(licenses.report_sql()).fetchall())
    got = sorted(map(tuple, licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert got == want and all(r[2] == 1 for r in got[150:])


def test_every_sentence_has_a_keyword():
    assert all(any(k in s for k in licenses.KEYWORDS) for _, s in licenses.SENTENCES)
    known = {i for i, _ in licenses.SENTENCES}
    assert all(x in known for _, ids in licenses.RULES for x in ids)


def test_wrapped_unlicense_is_found(spark):
    texts = ["This is free and unencumbered software released into the public\ndomain.", "This is free and unencumbered software released into the public  domain."]
    got = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licenses for r in got] == ["Unlicense"] * 2 and not any(" " in k for k in licenses.KEYWORDS)


def test_pipeline(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
        docs = after
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in packed} == left and len(left) > 100


def test_ten_operators_are_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
