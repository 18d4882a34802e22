"""The scan of texts in Python against the same rules as columns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import classify, entities, scan
from paperloom.plans import fields

BITS = """a@b.com|x.y_z%+-@d-e.f.org|@c.org|http://a.b/c?d|www.q.com/z|2020-01-02|2023-02-29|0000-01-01|1/2/20|13/1/2021|31/2/99|1/2/345|1.2.2020|1.2.3.2020|January 5, 2024|jan. 5, 2024|may  31 2020|5 March  2020|
30 feb 2021|$|$ 5,000.50|USD 5|5 EUR|USD5,5.5EUR|total: 5|subtotal $5.00|amount\n9|price:$,|(555) 123-4567|555-123-4567|+1 555 1234 5678|1-800-555-1234|1 800 555 1234|12 Main St|5 A Street, Suite 7 x|7\nBest|a12 Road|99 way|
12 a lane.|5 Oak Blvd_|invoice # ab-12345|inv 123|P.O. Box 12345|purchase order: A-999|ref: Z12345|Reference|no. 12345|Number A12345|# x123456|Mr. Smith|Dr Jane Ann Lee|Acme Inc.|Acme Inc.x|Foo & Bar GmbH|ALLP|X LLP|
A Co.B|Date:|invoice date:|due date:|total|to:|from:|bill to|\n|\n| |,|.|-|_|  |:|Label one:\n|x|12|é|ø|é|́|§|ß|İ|K|ſ|²|٣|中|𝒜||| |\x85|\xa0|\x1c|\x0b|\r""".replace("|\n30", "|30").split("|")


def random_texts(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(1, 40))) for _ in range(n)] + ["", "a" * 300 + ":" + " " * 400 + "a@b.com", "\nlab el:" + " " * 400 + "a@b.com"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(random_texts(3_000))), "doc_id long, text string").repartition(4).persist()


def test_scan_gives_what_the_columns_give(spark, docs):
    t = F.col("text")
    names = ("ord", "text", "entity_type", "start", "end", "confidence", "normalized")
    bare = F.transform(entities.recognised(t), lambda e: F.struct(*(e[n].alias(n) for n in names), F.lit(None).cast("string").alias("role")))
    for want, how in ((bare, {"dedup": False, "link": False}), (entities.linked(t, entities.deduplicated(entities.recognised(t))), {})):
        got = entities.with_entities(docs.select("doc_id", t.alias("t")), "t", **how)
        both = docs.select("doc_id", want.alias("want")).join(got, "doc_id")
        assert both.count() == docs.count() and both.filter(~F.col("want").eqNullSafe(F.col("entities"))).count() == 0
    one = entities.entity_rows(docs, dedup=False, link=False, kinds=("date",))
    assert one.count() == docs.select(F.explode(entities.recognised(t, ("date",)))).count() > 0


def test_fields_are_filled_in_one_reading(spark, docs):
    """No join, no grouping: a document's fields come from its own text."""
    typed = docs.withColumn("document_type", F.element_at(F.array(*map(F.lit, ("invoice", "letter", "unknown"))), (F.col("doc_id") % 3 + 1).cast("int")))
    out = fields.structured_fields(typed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    got = {(r.doc_id, r.field_ord): (r.field_name, r.field_values) for r in out.collect()}
    linked = {}
    for r in entities.entity_rows(docs).collect():
        linked.setdefault(r.doc_id, []).append(r)
    want = {}
    for i in range(docs.count()):
        for kind, name, place, roles, types in fields.field_rows():
            if kind == ("invoice", "letter", "unknown")[i % 3]:
                typed = sorted((e for e in linked.get(i, []) if e.entity_type in types), key=lambda e: (e.start, e.ord))
                want[i, place] = (name, [e.normalized or e.text for e in [e for e in typed if (e.role or "") in roles] or typed])
    assert got == want


def test_types_of_single_texts(spark, docs):
    """The rules in Python give what they give as columns."""
    words = [p for phrases in classify.SIGNATURES.values() for p in phrases]
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(words).upper() if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randint(0, 7))) for _ in range(2_000)] + ["", "\u0130nvoice \u212aeyword", None]
    typed = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(docs.select("text"))
    rows = classify.rule_classified(typed).select("text", "document_type").collect()
    assert len({r.document_type for r in rows}) == 7 and all(classify.rule_type(r.text) == r.document_type for r in rows)


@pytest.mark.parametrize("part", ["a1 ", "A b ", "1 b ", "a.b.", "Inc. ", "12 st x:"])
def test_time_grows_with_the_text(part):
    """Patterns of a head, a run and a suffix were tried from every head to the end of the run."""
    began = time.perf_counter()
    scan.entities(part * 100_000 + " end st")
    assert time.perf_counter() - began < 20
