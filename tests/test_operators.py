"""Single operators on small inputs."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators import boilerplate, classify, entities, keywords, layout, similarity, summary, tables
from paperloom.plans import documents
from paperloom.plans.store import DocumentStore, chunk_rows
from paperloom.sources import files, ocr, pixels
from paperloom.streaming import ingest


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"v{i}") for i in range(len(values)))).alias("x")).first().x


# --- text --------------------------------------------------------------------------------------------------------


def test_sentences(spark):

    assert one(spark, T.sentences, "Mr. A. Then B? Yes.") == ["Mr. A.", "Then B?", "Yes."]
    assert one(spark, T.sentences, "") == [] and one(spark, T.loose_sentences, "a. b! c") == ["a.", "b!", "c"]
    assert one(spark, T.plain_sentences, "One  two.\nThree four. five") == ["One two.", "Three four. five"]


def test_words_and_space(spark):
    assert one(spark, lambda c: T.letter_words(c, 3), "The cat's café x_yz don't abc1 End") == ["the", "cat", "don", "end"]
    assert one(spark, T.collapse, " \xa0 a  \n b\x1c ") == "a b" and one(spark, T.token_count, " a\xa0b  c ") == 3
    assert one(spark, lambda c: T.truncate(c, 2), "a b c") == "a b..." and one(spark, lambda c: T.truncate(c, 3), "a b  c") == "a b  c"
    assert one(spark, T.paragraphs, "a\n \nb\nc\n\n\n") == ["a", "b\nc"]
    assert one(spark, T.language, "The cat is in the hat of it") == "en" and one(spark, T.language, "a a a a") == "unknown"


@pytest.mark.parametrize("word,n", [("", 0), ("...", 0), ("table", 1), ("the", 1), ("Beautiful,", 3), ("rhythm", 1), ("e", 1), ("see", 1), ("xyz", 1)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables, word) == n


def test_cleaning(spark):
    assert one(spark, T.clean_block, " ﬁne —  “x” \x00\t ok ") == 'fine -- "x" ok'
    assert one(spark, boilerplate.cleaned, "  a  b \r\n\n\n\n\n rn | é \n") == "a b\n\n\nm I e"
    assert one(spark, boilerplate.cleaned, "") == ""


# --- geometry and layout -------------------------------------------------------------------------------------------


def boxes(spark, *rows):
    return spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(rows)], "idx int, x0 double, y0 double, x1 double, y1 double"
    ).select("idx", G.box(*(F.col(k) for k in ("x0", "y0", "x1", "y1"))).alias("bbox"))


def test_boxes(spark):
    b = boxes(spark, (0, 0, 10, 10), (5, 5, 20, 20), (-5, -5, 1, 1))
    e = b.agg(G.envelope(F.col("bbox")).alias("e")).first().e
    assert tuple(e) == (-5, -5, 20, 20)
    pair = b.filter("idx = 0").select(F.col("bbox").alias("a")).crossJoin(b.filter("idx = 1").select(F.col("bbox").alias("b")))
    r = pair.select(
        G.overlap(F.col("a"), F.col("b")).alias("o"), G.iou(F.col("a"), F.col("b")).alias("i"),
        G.relative_position(F.col("a"), F.col("b")).alias("p"), G.aspect_ratio(F.col("a")).alias("q")
    ).first()
    assert (r.o, round(r.i, 6), r.p, r.q) == (25.0, round(25 / 300, 6), "overlapping", 1.0)
    kept = boxes(spark, (0, 0, 10, 10), (0, 0, 9, 10), (50, 50, 60, 60)).agg(F.collect_list(F.struct("idx", "bbox")).alias("b")).select(G.non_maximum_suppression(F.col("b"), 0.5).alias("k")).first().k
    assert [k.idx for k in kept] == [0, 2]


ROLE_CASES = [
    ("Section Title", 16.0, "header"), ("Section Title", 18.0, "title"), ("An ordinary sentence of text.", 11.0, "paragraph"), ("• item", 11.0, "list_item"), ("1. item", 11.0, "list_item"),
    ("Page 1 of 10", 11.0, "footer"), ("Figure 1: things", 11.0, "caption"), ("SECTION ONE", 11.0, "header"), ("due 1/2", 20.0, "footer"), ("   ", 20.0, "paragraph"),
]


def test_block_roles(spark):
    df = spark.createDataFrame(ROLE_CASES, "text string, size double, want string")
    assert all(r.got == r.want for r in df.select("want", layout.block_role(F.col("text"), F.col("size"), F.lit(11.0)).alias("got")).collect())


def page(spark, places, size=11.0):
    rows = [(1, 1, i, f"block {i}", float(x0), float(y0), size) for i, (x0, y0) in enumerate(places)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, block_idx int, text string, x0 double, y0 double, font_size double")
    blocks = df.select(
        "doc_id", "page_num", "block_idx", "text", G.box(F.col("x0"), F.col("y0"), F.col("x0") + 100, F.col("y0") + 10).alias("bbox"),
        "font_size", F.lit("paragraph").alias("block_type")
    )
    return blocks, spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id long, page_num int, width double, height double")


def test_reading_order_and_columns(spark):
    b, p = page(spark, [(50, 300), (50, 100), (50, 200)])
    assert [r.block_idx for r in layout.analysed(b, p).orderBy("reading_order").collect()] == [1, 2, 0]
    b, p = page(spark, [(20 + i % 2 * 350, 100 + 40 * (i // 2)) for i in range(12)])
    rows = layout.analysed(b, p).orderBy("reading_order").collect()
    assert rows[0].columns == 2 and [r.block_idx for r in rows] == [0, 2, 4, 6, 8, 10, 1, 3, 5, 7, 9, 11]
    b, p = page(spark, [(50, 15), (50, 405), (50, 755)])
    assert [r.zone for r in layout.analysed(b, p).orderBy("block_idx").collect()] == ["header", "body", "footer"]


def test_clusters_follow_the_order(spark):
    b, _ = page(spark, [(0, 0), (200, 0), (100, 0), (900, 0)])
    got = [r.cluster for r in layout.proximity_clusters(b, 110.0).orderBy("block_idx").collect()]
    assert got == [0, 1, 0, 2]


# --- tables ---------------------------------------------------------------------------------------------------------


def test_ocr_words_become_blocks(spark):
    rows = [
        (1, 1, 0, 1, 1, 10, 20, 50, 15, 90, "Hello"), (1, 1, 1, 1, 1, 65, 20, 50, 15, 85, "World"),
        (1, 1, 2, 1, 1, 120, 20, 30, 15, 88, "Test"), (1, 1, 3, 2, 1, 0, 0, 1, 1, -1, "x"), (1, 1, 4, 2, 1, 0, 0, 1, 1, 90, " ")
    ]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, word_idx int, block_num int, par_num int, left int, top int, width int, height int, conf int, text string")
    got = tables.ocr_blocks(df).collect()
    assert len(got) == 1 and got[0].text == "Hello World Test" and tuple(got[0].bbox) == (10, 20, 150, 35) and abs(got[0].confidence - 263 / 300) < 1e-9


def words(spark, rows):
    return spark.createDataFrame(
        [(1, 1, i, w, float(x), float(y), float(x + 20), float(y + 8)) for i, (w, x, y) in enumerate(rows)],
        "doc_id int, page_num int, word_idx int, word string, x0 double, y0 double, x1 double, y1 double"
    )


def test_tables(spark):
    w = words(spark, [(f"{r}{c}", c * 100 + 10, r * 20 + 4) for r in range(4) for c in range(3)])
    t = tables.whitespace_tables(w).first()
    assert t.headers == ["00", "01", "02"] and t["rows"] == [[f"{r}{c}" for c in range(3)] for r in range(1, 4)]
    lines = [(1, 1, 0.0, y, 300.0, y) for y in (0.0, 20.0, 40.0)] + [(1, 1, x, 0.0, x, 40.0) for x in (0.0, 100.0, 200.0)] + [(1, 1, 0.0, 0.0, 5.0, 0.0)]
    d = spark.createDataFrame(lines, "doc_id int, page_num int, x1 double, y1 double, x2 double, y2 double")
    r = tables.page_tables(d, w).collect()
    assert len(r) == 1 and r[0].method == "ruled_lines" and r[0].headers == ["00", "01"] and r[0]["rows"] == [["10", "11"]]
    assert tables.page_tables(d.limit(0), w).first().method == "whitespace_columns"


def test_otsu_in_both_forms(spark):
    rnd = np.random.default_rng(1)
    image = np.concatenate([rnd.normal(60, 10, 500), rnd.normal(180, 12, 700)]).clip(0, 255).astype(np.uint8)
    df = spark.createDataFrame([(1, int(v)) for v in image], "image_id int, value int")
    assert tables.otsu_thresholds(df).first().threshold == pixels.otsu(image) and 90 < pixels.otsu(image) < 150
    assert pixels.otsu(np.full((3, 3), 7, np.uint8)) == 128


def test_skewed_lines_are_found():
    flat = np.zeros((120, 160), np.uint8)
    flat[20::20] = flat[21::20] = 1
    assert pixels.skew_angle(flat) == 0 and pixels.prepared((255 - 255 * flat).astype(np.uint8)).shape == flat.shape


# --- entities ---------------------------------------------------------------------------------------------------------


def found(spark, text, **how):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return entities.entity_rows(df, **how).orderBy("start", "ord").collect()


ENTITY_CASES = [
    (
        "Contact test@Example.com today", "email", "test@Example.com", "test@example.com"
    ), ("on 2024-01-15.", "date", "2024-01-15", "2024-01-15"), ("on 1/15/75.", "date", "1/15/75", "1975-01-15"), ("on 15/01/2024.", "date", "15/01/2024", "2024-01-15"),
    (
        "on January 15, 2024.", "date", "January 15, 2024", "2024-01-15"
    ), ("on Jan. 15, 2024.", "date", "Jan. 15, 2024", None), ("on 5 march 2024", "date", "5 march 2024", "2024-03-05"), ("on 2024-02-31", "date", "2024-02-31", None), ("pay $1,234.56 now", "amount", "$1,234.56", "1234.56"),
    ("pay EUR 12 now", "amount", "EUR 12", "12"), ("call (555) 123-4567.", "phone", "(555) 123-4567", "5551234567"), ("see https://x.org/a?b now", "url", "https://x.org/a?b", None), (
        "at 12 Main Street, Town", "address", "12 Main Street, Town", None
    ),
    (
        "Dr. Jane Miller spoke", "person", "Dr. Jane Miller", "Dr. Jane Miller"
    ), ("from Acme Widgets LLC today", "organization", "Acme Widgets LLC", None), ("PO: ab-1234", "reference_number", "ab-1234", "AB-1234"),
]


def test_entity_types(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(ENTITY_CASES)], "doc_id int, text string")
    rows = entities.entity_rows(df, link=False).collect()
    for i, (text, kind, shown, normal) in enumerate(ENTITY_CASES):
        assert any((r.entity_type, r.text, r.normalized) == (kind, shown, normal) for r in rows if r.doc_id == i), text


def test_spans_are_the_text(spark):
    text = "é😀 test@example.com, Invoice Number: INV-2024-001 and $5.00 on 2024-01-15\nTotal: $247.50"
    rows = found(spark, text, dedup=False)
    assert rows and all(text[r.start : r.end] == r.text for r in rows)


def test_roles(spark):
    assert [(r.text, r.role) for r in found(spark, "Total: $247.50")] == [("$247.50", "invoice_total")]
    assert [(r.text, r.role) for r in found(spark, "Email: vendor@x.com")] == [("vendor@x.com", "contact_email")]
    assert [(r.text, r.role) for r in found(spark, "Delivery window: 2024-03-15")] == [("2024-03-15", "field:delivery window")]
    assert found(spark, "text with a date 2024-01-15")[0].role is None
    assert found(spark, "") == [] and found(spark, None) == []


def contained(spans):
    kept = []
    for s, e, o in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if not any(a <= s and b >= e for a, b, _ in kept):
            kept.append((s, e, o))
    return sorted(kept)


def test_containment_matches_the_greedy_rule(spark):
    rnd = np.random.default_rng(0)
    cases = []
    for i in range(150):
        spans = [(int(s), int(s + n), o) for o, (s, n) in enumerate(zip(rnd.integers(0, 20, 8), rnd.integers(1, 9, 8)))]
        cases.append((i, [(o, "x", "t", s, e, 1.0, None) for s, e, o in spans]))
    df = spark.createDataFrame(cases, f"i int, e array<{entities.ENTITY}>")
    for (_, given_), r in zip(cases, df.select("i", entities.deduplicated(F.col("e")).alias("k")).orderBy("i").collect()):
        assert sorted((k.start, k.end, k.ord) for k in r.k) == contained([(x[3], x[4], x[0]) for x in given_])


# --- classification, keywords, similarity, summaries --------------------------------------------------------------------

TYPED = {
    "invoice": "INVOICE\nInvoice Number: INV-1\nInvoice Date: 2024-01-15\nBill To: Acme\nSubtotal: $5\nTax: $1\nTotal: $6\nPayment due", "contract": "This agreement between the parties, whereas the party hereinafter has obligations; termination and governing law; liability.",
    "resume": "Curriculum vitae. Education: university degree, bachelor. Work history, employment and skills. References.",
}


def test_rule_and_model_types(spark):
    df = spark.createDataFrame([(k, t) for k, t in TYPED.items()] + [("none", ""), ("null", None), ("other", "zzz qqq")], "doc_id string, text string")
    rules = {r.doc_id: r for r in classify.rule_classified(df).collect()}
    model = {r.doc_id: r for r in classify.model_classified(df, classify.fit_text_model(spark)).collect()}
    for k in TYPED:
        assert rules[k].document_type == k == model[k].document_type
        assert abs(sum(rules[k].all_scores.values()) - 1) < 1e-9
    for k in ("none", "null"):
        assert (rules[k].document_type, rules[k].confidence, rules[k].features_used) == ("unknown", 0.0, []) and model[k].document_type == "unknown"
    assert rules["other"].features_used == ["rule_based"]


LONG = "Machine learning studies algorithms. Deep networks learn features from large data sets.\nSupport vectors separate classes of data with wide margins. Random forests combine many trees trained on data. Boosting adds weak learners one after another to learn data. Good evaluation needs held out data and clear measures. Careful people check data before they train networks."


def test_keywords_and_summaries(spark):
    df = spark.createDataFrame([(1, LONG), (2, ""), (3, "  "), (4, None), (5, "Too short.")], "doc_id int, text string")
    k = keywords.keywords(df, 5).collect()
    assert {r.doc_id for r in k} == {1, 5} and max(r["rank"] for r in k) == 5 and [r.score for r in sorted(k, key=lambda r: (r.doc_id, r["rank"])) if r.doc_id == 1] == sorted((r.score for r in k if r.doc_id == 1), reverse=True)
    s = {r.doc_id: r.summary for r in summary.summaries(df, 3).collect()}
    assert s[2] == s[3] == s[4] == "" and s[5] == "Too short." and 0 < len(s[1]) < len(LONG)
    kept = [x for x in summary.split_sentences(LONG) if x in s[1]]
    assert len(kept) == 3 and s[1] == " ".join(kept)


def test_sentence_ranks_match_a_dense_matrix():
    sents = summary.split_sentences(LONG) + ["Zq zr zs zt zu."]
    import re

    counts = [{w: re.findall(r"\b[a-z]{3,}\b", s.lower()).count(w) for w in re.findall(r"\b[a-z]{3,}\b", s.lower())} for s in sents]
    n = len(sents)
    w = np.array([[0 if i == j or not counts[i] or not counts[j] else sum(counts[i].get(t, 0) * c for t, c in counts[j].items()) / (sum(c * c for c in counts[i].values()) * sum(c * c for c in counts[j].values())) ** 0.5 for j in range(n)] for i in range(n)])
    x = np.full(n, 1 / n)
    for _ in range(100):
        s = w.sum(1)
        new = 0.85 * (w.T @ np.divide(x, s, out=np.zeros(n), where=s > 0) + x[s == 0].sum() / n) + 0.15 / n
        if np.abs(new - x).sum() < n * 1e-6:
            break
        x = new
    assert np.allclose(summary.sentence_ranks(sents), new, atol=1e-9)


def test_similarity(spark):
    df = spark.createDataFrame([(0, "invoice payment total invoice"), (1, "invoice payment total invoice"), (2, "mountain river"), (3, "")], "doc_id int, text string")
    m = {(r.a, r.b): r.score for r in similarity.similarity_matrix(df).collect()}
    assert len(m) == 16 and abs(m[0, 1] - 1) < 1e-9 and m[0, 2] == 0 and m[3, 3] == 1 and all(m[a, b] == m[b, a] for a, b in m)
    q = df.filter("doc_id = 0").withColumnRenamed("doc_id", "item_id")
    assert [(r["rank"], r.doc_id) for r in similarity.most_similar(q, df, 3).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]


# --- files, plan, store, stream ------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    for name, data in (("a.PDF", b"%PDF-1.4"), ("b.txt", b"%PDF-1.4"), ("c.png", b"\x89PNG...."), ("d.jpg", b"none"), ("e.xyz", b"none")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/f.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "sub/empty.pdf").write_bytes(b"")  # the file source leaves out files without bytes
    listed = {r.name: r.file_type for r in files.read_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.PDF": "pdf", "c.png": "image", "d.jpg": "image"}
    assert {r.name: r.file_type for r in files.read_files(spark, str(tmp_path), pattern="*.txt").collect()} == {"b.txt": "pdf"}
    assert files.read_files(spark, str(tmp_path), recursive=True).count() == 4
    assert one(spark, files.clean_name, "  my file?.pdf ") == "my_file_.pdf" and one(spark, files.file_type, "/x/y") == "scan"
    if not files.capabilities()["pdf"]:
        with pytest.raises(RuntimeError):
            files.pdf_blocks(files.read_files(spark, str(tmp_path)))


def test_plan_and_formats(spark):
    df = spark.createDataFrame([(1, TYPED["invoice"]), (2, "")], "doc_id int, text string")
    out = documents.run(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].classification.document_type == "invoice" and rows[2].entities == [] and rows[2].keywords == []
    values = {f.field_name: f.field_values for f in rows[1].structured_fields}
    assert values["invoice_date"] == ["2024-01-15"] and values["vendor"] == []
    import json

    made = {r.doc_id: json.loads(r.json) for r in documents.formatted(out, "json").collect()}
    assert made[1]["structured_fields"]["invoice_date"] == "2024-01-15" and made[1]["structured_fields"]["vendor"] is None and made[1]["document_id"] == "1"
    csv = {r.doc_id: r.csv for r in documents.formatted(out, "csv").collect()}
    assert csv[2] == "=== ENTITIES ===\r\ntype,text,normalized,confidence,start,end,role\r\n" and "0.90" in csv[1]
    md = {r.doc_id: r.markdown for r in documents.formatted(out, "markdown").collect()}
    assert "**Type:** invoice" in md[1] and "## Keywords" not in md[2]
    assert list(made[2]) == [
        "document_id", "source_path", "file_type", "page_count", "classification", "structured_fields", "entities", "tables", "summary",
        "keywords", "processing_time_ms", "errors"
    ]
    assert made[2]["tables"] == [] and made[1]["entities"][0]["metadata"].keys() <= {"role"} and made[2]["source_path"] is None
    with pytest.raises(ValueError):
        documents.formatted(out, "xml")
    only = documents.run(df, documents.Options(run_entities=False, run_summary=False, run_keywords=False)).first()
    assert only.entities is None and only.summary is None and only.classification is not None
    assert documents.Options.of({"top_keywords": 0, "x": 1}) == documents.Options() and documents.Options.load("/none") == documents.Options()


def test_words_of_pages(spark, tmp_path):
    def read(page):
        if page.shape == (1, 1):
            raise ValueError("nothing there")
        return {k: [1, 1] for k in ocr.WORD_FIELDS} | {"text": ["a", "b"], "conf": ["96.5", "-1"]}

    rows, pages, error = ocr.word_rows("d", iter([np.zeros((1, 1), np.uint8), np.zeros((9, 9), np.uint8)]), read, True)
    assert pages == 2 and error == "page 1: nothing there"
    assert [(r[1], r[2], r[-2], r[-1]) for r in rows] == [(2, 0, 96, "a"), (2, 1, -1, "b")]
    if not files.capabilities()["ocr"]:
        (tmp_path / "a.png").write_bytes(b"\x89PNG....")
        with pytest.raises(RuntimeError):
            ocr.ocr_words(files.read_files(spark, str(tmp_path)))


def test_tables_and_metadata_in_formats(spark):
    docs = spark.createDataFrame(
        [("d", "", "/x/a.pdf", "pdf", 2, {"title": "T", "author": ""})],
        "doc_id string, text string, source_path string, file_type string, page_count int, metadata map<string,string>"
    )
    tables = spark.createDataFrame(
        [("d", 2, ["Item", "Qty"], [["a, b", "1"], ["c", None]]), ("d", 1, None, [['say "x"']])],
        "doc_id string, page_num int, headers array<string>, rows array<array<string>>"
    )
    out = documents.run(docs, documents.Options(run_linking=False), tables=tables)
    import json

    made = json.loads(documents.formatted(out, "json").first().json)
    assert [(t["page_num"], t["num_rows"], t["num_cols"]) for t in made["tables"]] == [(1, 1, 1), (2, 2, 2)] and made["source_path"] == "/x/a.pdf" and made["page_count"] == 2
    lines = documents.formatted(out, "csv").first().csv.split("\r\n")
    assert lines[2:] == ["", "=== TABLE 1 (page 1) ===", '"say ""x"""', "", "=== TABLE 2 (page 2) ===", "Item,Qty", '"a, b",1', "c,", ""]
    md = documents.formatted(out, "markdown").first().markdown
    assert "# Document: /x/a.pdf" in md and "### Table 2 (page 2)\n\n| Item | Qty |\n|---|---|\n| a, b | 1 |\n| c |  |\n" in md and "- **title:** T" in md and "author" not in md


class Book:
    """What a PDF decoder gives, made of a file's text: pages between form feeds, blocks between empty lines, "IMAGE" is one."""

    def __init__(self, content):
        text = content.decode()
        if "BROKEN" in text:
            raise ValueError("no book")
        self.pages = text.removeprefix("%PDF").split("\f") if "\f" in text else []
        self.metadata, self.page_count, self.is_encrypted = {"title": "T", "author": None, "modDate": "D:2024"}, len(self.pages), False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __iter__(self):
        return iter(map(Sheet, self.pages))


class Sheet:
    def __init__(self, text):
        from types import SimpleNamespace

        self.text, self.rect = text, SimpleNamespace(width=612, height=792)

    def get_text(self, _):
        line = lambda x: {"spans": [{"text": x[:3], "size": 9, "font": "A"}, {"text": x[3:], "size": 12, "font": "B"}]}
        return {"blocks": [{"type": 1, "bbox": (1, 2, 3, 4)} if b == "IMAGE" else {"type": 0, "bbox": (5, 6, 7, 8), "lines": list(map(line, b.split("\n")))} for b in self.text.split("\n\n")]}


def draw_text(content, is_pdf, dpi):
    if b"BROKEN" in content:
        raise ValueError("no image")
    yield np.full((40, 40), 200, np.uint8)


def read_text(page):
    return {k: [1, 1] for k in ocr.WORD_FIELDS} | {"text": ["hello", "scan"], "conf": [90, 91]}


def test_books_pages_and_scans(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    from paperloom import __main__ as command

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    (tmp_path / "a.pdf").write_bytes(b"%PDFInvoice\nnumber\n\nIMAGE\f\f  \n\nTotal: $5.00")
    (tmp_path / "none.pdf").write_bytes(b"%PDF")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF BROKEN")
    (tmp_path / "c.png").write_bytes(b"\x89PNGhello scan")
    (tmp_path / "d.png").write_bytes(b"\x89PNGBROKEN")
    found = files.read_files(spark, str(tmp_path))
    pages = {(r.path.rsplit("/", 1)[1], r.page_num): r for r in files.pdf_pages(found.filter("file_type = 'pdf'"), Book).collect()}
    assert set(pages) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("none.pdf", None), ("bad.pdf", None)} and pages["bad.pdf", None].error == "no book"
    first = pages["a.pdf", 1]
    assert [(b.text, b.font_size, b.font_name, b.x0) for b in first.blocks] == [("Invoice\nnumber", 12.0, "B", 5.0)] and [tuple(i) for i in first.images] == [(1.0, 2.0, 3.0, 4.0)]
    assert first.metadata["title"] == "T" and first.metadata["modification_date"] == "D:2024" and first.metadata["page_count"] == "3" and first.metadata["author"] == ""
    assert pages["a.pdf", 2].blocks == [] and [b.text for b in pages["a.pdf", 3].blocks] == ["Total: $5.00"]
    assert files.pdf_blocks(found.filter("file_type = 'pdf'"), Book).count() == 3
    docs, errors = command.read_documents(spark, str(tmp_path), open_book=Book, read=read_text, draw=draw_text)
    got = {r.source_path.rsplit("/", 1)[1]: r for r in docs.collect()}
    assert {k: (r.text, r.page_count) for k, r in got.items()} == {"a.pdf": ("Invoice\nnumber\n\n\n\nTotal: $5.00", 3), "none.pdf": ("", 0), "c.png": ("hello scan", 1)}
    assert {r.path.rsplit("/", 1)[1] for r in errors.collect()} == {"bad.pdf", "d.png"}
    made = documents.formatted(documents.run(docs), "markdown").collect()
    assert any("- **title:** T" in r.markdown and "**Pages:** 3" in r.markdown for r in made)
    if not files.capabilities()["pdf"]:  # without decoders every file is named
        docs, errors = command.read_documents(spark, str(tmp_path))
        assert docs.count() == 0 and errors.count() == 5


def test_repeated_and_null_ids_have_their_results(spark):
    df = spark.createDataFrame([(1, TYPED["invoice"]), (1, TYPED["contract"]), (None, "Pay $5.00 to a@b.org."), (None, None)], "doc_id int, text string")
    for options in (documents.Options(), documents.Options(use_model=True)):
        rows = documents.run(df, options).collect()
        assert len(rows) == 4 and all(r.classification is not None and r.entities is not None and r.summary is not None for r in rows)
        assert sorted(e.text for r in rows if r.doc_id is None for e in r.entities) == ["$5.00", "a@b.org"]


def test_texts_of_blocks(spark):
    blocks = spark.createDataFrame([("d", 2, 0, "c"), ("d", 1, 1, "b"), ("d", 1, 0, "a"), ("d", 1, 2, " ")], "doc_id string, page_num int, block_idx int, text string")
    assert tuple(documents.texts_of_blocks(blocks).first()) == ("d", "a\nb\n\nc", 2)


def test_command_line(spark, tmp_path):
    from paperloom.__main__ import main

    spark.createDataFrame([(1, TYPED["invoice"]), (2, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/docs.parquet")
    assert main(["classify", f"{tmp_path}/docs.parquet", "--out", f"{tmp_path}/types"]) == 0
    assert {r.doc_id: r.document_type for r in spark.read.parquet(f"{tmp_path}/types").collect()} == {1: "invoice", 2: "unknown"}
    assert main(["extract", f"{tmp_path}/docs.parquet", "--output", "csv", "--out", f"{tmp_path}/csv"]) == 0
    assert spark.read.parquet(f"{tmp_path}/csv").count() == 2


def test_store(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/store")
    assert store.count() == 0
    docs = spark.createDataFrame([("a", "x" * 100_005, datetime.datetime(2024, 1, 1)), ("b", "y", datetime.datetime(2024, 1, 2))], "document_id string, text string, created_at timestamp")
    ents = spark.createDataFrame(
        [("a", 0, "t", "email", 0, 1, 0.5, "t", None)],
        "document_id string, ord int, text string, entity_type string, start int, end int, confidence double, normalized string, role string"
    )
    blocks = spark.createDataFrame([("a", 1, 0, "t", "p"), ("a", 1, 4, "u", "p"), ("a", 2, 1, "v", "p")], "document_id string, page_num int, block_idx int, text string, block_type string")
    store.save(docs, ents, chunk_rows(blocks))
    assert [r.document_id for r in store.page().collect()] == ["b", "a"] and len(store.get("a").first().text) == 100_000
    assert [r.chunk_index for r in store.table("chunks").orderBy("page_num", "chunk_index").collect()] == [0, 1, 0]
    store.save(docs.filter("document_id = 'a'").withColumn("text", F.lit("new")))
    assert store.count() == 2 and store.table("entities").count() == 0 and store.get("a").first().text == "new"
    assert store.delete("a") and not store.delete("a") and store.count() == 1 and [r.document_id for r in store.page(1, 0).collect()] == ["b"]
    assert len(store._numbers()) == 3  # old versions are removed
    before = {b: p for b, p in store._newest()[1]["documents"].items()}
    store.save(spark.createDataFrame([(f"n{i}", "t") for i in range(2)], "document_id string, text string"))
    after = store._newest()[1]["documents"]
    assert sum(after.get(b) == p for b, p in before.items()) >= len(before) - 2 and store.count() == 3  # other buckets aren't touched
    number, version = store._newest()
    assert not store._claim(number, version) and store._newest()[0] == number  # a number is taken once
    other, claims = DocumentStore(spark, f"file://{tmp_path}/store"), []
    claim = store._claim

    def late(number, version):
        """Another writer is first, once."""
        if not claims:
            claims.append(number)
            other.save(spark.createDataFrame([("z", "first")], "document_id string, text string"))
        return claim(number, version)

    store._claim = late
    store.save(spark.createDataFrame([("y", "second")], "document_id string, text string"))
    assert store.get("z").count() == store.get("y").count() == 1 and store.count() == 5
    store.delete_all(spark.createDataFrame([("z",), ("none",)], "document_id string"))
    assert store.count() == 4


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, TYPED["invoice"]), (2, TYPED["contract"]), (3, None)], "doc_id int, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    store = DocumentStore(spark, f"file://{tmp_path}/store")
    ingest.ingest(ingest.document_stream(spark, f"{tmp_path}/in", "doc_id int, text string", 1), store, f"{tmp_path}/marks", once=True).awaitTermination(120)
    got = {r.document_id: r.document_type for r in store.page().collect()}
    assert got == {r.document_id: r.document_type for r in ingest.enriched(rows).collect()} and store.table("entities").count() > 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .@1$-\né", max_size=30), min_size=1, max_size=4))
def test_spans_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in entities.entity_rows(df, dedup=False, link=False).collect():
        cut = texts[r.doc_id][r.start : r.end]
        assert cut == r.text or r.entity_type in entities.TRIMMED and cut.strip() == r.text
