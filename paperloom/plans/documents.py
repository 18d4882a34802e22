"""The whole document plan: classification, entities, fields, summaries and keywords of a table of documents, and its renderings."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import classify, keyword_scan, layout, scan, summary
from paperloom.operators.entities import SLICE
from paperloom.plans import fields
from paperloom.shipping import ship_package, then_released, written


@dataclasses.dataclass(frozen=True)
class Options:
    """What a run does; unknown names in a mapping are ignored, invalid values give the defaults."""

    run_layout: bool = True
    run_classification: bool = True
    run_entities: bool = True
    run_linking: bool = True
    run_summary: bool = True
    run_keywords: bool = True
    summary_sentences: int = 5
    top_keywords: int = 15
    use_model: bool = False

    @classmethod
    def of(cls, settings: dict) -> Options:
        known = {f.name: f for f in dataclasses.fields(cls)}
        kept = {k: v for k, v in settings.items() if k in known and type(v) is type(known[k].default)}
        bounds = {"summary_sentences": (1, 50), "top_keywords": (1, 100)}
        return cls(**kept) if all(a <= kept.get(k, a) <= b for k, (a, b) in bounds.items()) else cls()

    @classmethod
    def load(cls, path: str) -> Options:
        """From a YAML file; a missing or broken one gives the defaults."""
        try:
            import yaml

            with open(path) as file:
                found = yaml.safe_load(file)
            return cls.of(found if isinstance(found, dict) else {})
        except Exception:
            return cls()

    def save(self, path: str) -> None:
        import yaml

        with open(path, "w") as file:
            yaml.safe_dump(dataclasses.asdict(self), file)


#: What a word of a keyword has at least.
LEAST_LETTERS = 3
#: What a result has besides its id, and the type of each.
RESULT = {
    "source_path": "string", "file_type": "string", "page_count": "int", "metadata": "map<string,string>",
    "classification": "struct<document_type:string,confidence:double,all_scores:map<string,double>,features_used:array<string>>",
    "entities": f"array<{scan.ENTITY}>", "structured_fields": f"array<{fields.FIELD}>",
    "tables": "array<struct<page_num:int,headers:array<string>,rows:array<array<string>>>>", "summary": "string", "keywords": "array<string>",
}


def texts_of_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, text, page_count: the blocks of a page that aren't blank, line by line; pages are parted by an empty line.

    The order is that of extraction: entities, summaries and keywords don't depend on the layout that is found later.
    """
    page = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"].rlike(r"\S")), lambda b: b["text"]), "\n")
    pages = blocks.groupBy("doc_id", "page_num").agg(page.alias("t"))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "t"))), lambda p: p["t"]), "\n\n").alias("text"),
        F.count("*").cast("int").alias("page_count")
    )


def ordered_blocks(blocks: DataFrame, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """The blocks with their roles and their place on the page (reading_order): that of extraction without the layout step."""
    if options.run_layout:
        return layout.analysed(blocks, pages)
    place = Window.partitionBy("doc_id", "page_num").orderBy("block_idx")
    return blocks.withColumn("reading_order", F.row_number().over(place) - 1)


def run(docs: DataFrame, options: Options = Options(), doc_id: str = "doc_id", text: str = "text", tables: DataFrame | None = None) -> DataFrame:
    """doc_id and the columns of RESULT; what isn't asked for isn't planned and is null.

    docs can have source_path, file_type, page_count and metadata, which are passed on. tables: doc_id, page_num, headers, rows.
    All but tables and the text model is computed in a row of its own, so repeated and null ids have their results, no row is
    multiplied, and texts are neither stored nor shuffled. What the text model needs is joined by a number that each row has.
    """
    spark = docs.sparkSession
    passed = [c for c in ("source_path", "file_type", "page_count", "metadata") if c in docs.columns and c not in (doc_id, text)]
    out = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *passed)
    if options.run_classification:
        names = ("document_type", "confidence", "all_scores", "features_used")
        if options.use_model:
            out = written(out, "documents")  # so that both sides see the same numbers
            scored = classify.model_classified(out.select("row_id", "text"), classify.fit_text_model(spark), "row_id")
            scores = F.create_map(*(x for c in scored.columns if c.startswith("score_") for x in (F.lit(c[6:]), F.col(c))))
            used = F.array(F.lit("tfidf"), F.lit("logistic_regression"))
            kinds = scored.select(F.col("doc_id").alias("row_id"), F.struct("document_type", "confidence", scores.alias("all_scores"), used.alias("features_used")).alias("classification"))
            out = out.join(kinds, "row_id")
        else:
            out = classify.rule_classified(out).select(*out.columns, F.struct(*names).alias("classification"))
    out = _read(out, options)
    if tables is not None:
        row = F.struct("page_num", F.col("headers").cast("array<string>").alias("headers"), F.col("rows").cast("array<array<string>>").alias("rows"))
        out = out.join(tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("tables")), "doc_id", "left")
    return out.select("doc_id", *((F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RESULT.items()))


def _read(rows: DataFrame, options: Options) -> DataFrame:
    """The rows with what is read from their texts, in place of them, in one pass over Arrow batches."""
    makers: list[tuple[str, Callable[[list[str], list[str | None]], list[pa.Array]]]] = []
    with_fields = options.run_entities and options.run_classification

    def found(texts: list[str], kinds: list[str | None]) -> list[pa.Array]:
        each = [scan.entities(t, link=options.run_linking) for t in texts]
        return [scan.as_arrow(each), *([fields.as_arrow([fields.filled(k, e) for k, e in zip(kinds, each)])] if with_fields else [])]

    if options.run_entities:
        makers.append((f"entities array<{scan.ENTITY}>" + (f", structured_fields array<{fields.FIELD}>" if with_fields else ""), found))
    if options.run_summary:
        makers.append(("summary string", lambda texts, _: [pa.array([summary.summary(t, options.summary_sentences) for t in texts], pa.string())]))
    if options.run_keywords:
        makers.append(("keywords array<string>", lambda texts, _: [pa.array([[k for k, _ in keyword_scan.merged(*read(t), options.top_keywords)] for t in texts], pa.list_(pa.string()))]))
    if not makers:
        return rows.drop("text")
    ship_package(rows.sparkSession)
    read = keyword_scan.Parts(LEAST_LETTERS).read
    kept = [c for c in rows.columns if c != "text"]
    kind = F.col("classification.document_type") if with_fields else F.lit(None).cast("string")
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(ddl for ddl, _ in makers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = batch.column("text").to_pylist(), batch.column("__kind").to_pylist()
            for at in range(0, len(texts), SLICE):
                made = [a for _, make in makers for a in make(texts[at : at + SLICE], kinds[at : at + SLICE])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, SLICE) for c in kept), *made], names=[*kept, *names])

    names = [x for x in ("entities", "structured_fields", "summary", "keywords") if any(f"{x} " in ddl for ddl, _ in makers)]
    return rows.select(*kept, "text", kind.alias("__kind")).mapInArrow(then_released(run), schema)


def _json(c: Column) -> Column:
    """One value as JSON, null too."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _object(items: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in items)), F.lit("}"))


def _scalar_or_list(values: Column) -> Column:
    return F.when(F.size(values) == 0, F.lit("null")).when(F.size(values) == 1, _json(F.get(values, F.lit(0)))).otherwise(F.to_json(values))


def as_json(result: DataFrame) -> DataFrame:
    """doc_id, json: twelve keys. A field with one value is that value, with none null, with more a list.

    Documents aren't timed one by one in a distributed plan, so processing_time_ms is 0, and a plan that runs has no errors.
    """
    shown = F.concat(F.lit("{"), F.array_join(F.transform("structured_fields", lambda f: F.concat(_json(f["field_name"]), F.lit(":"), _scalar_or_list(f["field_values"]))), ","), F.lit("}"))
    role = lambda e: F.when(e["role"].isNotNull(), F.create_map(F.lit("role"), e["role"])).otherwise(F.create_map().cast("map<string,string>"))
    entity = lambda e: F.struct(*(e[n].alias(n) for n in ("text", "entity_type", "start", "end", "confidence", "normalized")), role(e).alias("metadata"))
    table = lambda t: F.struct(
        t["headers"].alias("headers"), t["rows"].alias("rows"), F.size(t["rows"]).alias("num_rows"),
        F.coalesce(F.array_max(F.transform(t["rows"], lambda r: F.size(r))), F.lit(0)).alias("num_cols"), t["page_num"].alias("page_num"),
    )
    listed = lambda c: F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("[]"))
    items = [
        ("document_id", _json(F.col("doc_id").cast("string"))), ("source_path", _json(F.col("source_path"))), ("file_type", _json(F.col("file_type"))), ("page_count", _json(F.coalesce("page_count", F.lit(0)))),
        ("classification", _json(F.col("classification"))), ("structured_fields", F.coalesce(shown, F.lit("{}"))), ("entities", listed(F.transform("entities", entity))), ("tables", listed(F.transform("tables", table))),
        ("summary", _json(F.col("summary"))), ("keywords", listed(F.col("keywords"))), ("processing_time_ms", F.lit("0.0")), ("errors", F.lit("[]")),
    ]
    return result.select("doc_id", _object(items).alias("json"))


def _quoted(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _numbered(tables: Column, use) -> Column:
    """The lines that use(table, its number from 1) gives for each table, in one array."""
    return F.coalesce(F.flatten(F.transform(tables, lambda t, i: use(t, i + 1))), F.array().cast("array<string>"))


def as_csv(result: DataFrame) -> DataFrame:
    """doc_id, csv: a title, a header and a row per entity, then a title and the rows of each table, with CRLF line ends."""
    row = lambda e: F.concat_ws(",", *(_quoted(c) for c in (e["entity_type"], e["text"], e["normalized"], F.format_string("%.2f", e["confidence"]), e["start"], e["end"], e["role"])))
    head = F.array(F.lit("=== ENTITIES ==="), F.lit("type,text,normalized,confidence,start,end,role"))
    cells = lambda r: F.array_join(F.transform(r, _quoted), ",")

    def section(t: Column, i: Column) -> Column:
        title = F.format_string("=== TABLE %d (page %d) ===", i, t["page_num"])
        return F.concat(F.array(F.lit(""), title), F.when(F.size(t["headers"]) > 0, F.array(cells(t["headers"]))).otherwise(F.array().cast("array<string>")), F.transform(t["rows"], cells))

    lines = F.concat(head, F.coalesce(F.transform("entities", row), F.array().cast("array<string>")), _numbered(F.col("tables"), section))
    return result.select("doc_id", F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("csv"))


def as_markdown(result: DataFrame) -> DataFrame:
    """doc_id, markdown: sections that have nothing are left out; scores from the highest, ties in the order of types."""
    percent = lambda c, d: F.format_string(f"%.{d}f%%%%", c * 100)
    ordered = F.array_sort(F.transform(F.map_entries("classification.all_scores"), lambda x, i: F.struct((-x["value"]).alias("o"), i.alias("i"), x["key"].alias("k"))))
    scores = F.transform(ordered, lambda x: F.concat(F.lit("| "), x["k"], F.lit(" | "), percent(-x["o"], 1), F.lit(" |")))
    cell = lambda c: F.coalesce(c, F.lit(""))
    entity = lambda e: F.concat(F.lit("| "), F.concat_ws(" | ", e["entity_type"], e["text"], cell(e["normalized"]), cell(e["role"]), percent(e["confidence"], 0)), F.lit(" |"))
    bars = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    section = lambda title, *parts: F.concat_ws("\n", F.lit(f"## {title}"), F.lit(""), *parts, F.lit(""))

    def table(t: Column, i: Column) -> Column:
        headers = F.when(F.size(t["headers"]) > 0, F.array(bars(t["headers"]), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(t["headers"]))))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.format_string("### Table %d (page %d)", i, t["page_num"]), F.lit("")), headers, F.transform(t["rows"], bars), F.array(F.lit("")))

    known = F.filter(F.map_entries("metadata"), lambda m: F.coalesce(m["value"], F.lit("")) != "")
    name = F.coalesce("source_path", F.col("doc_id").cast("string"))
    return result.select(
        "doc_id",
        F.concat_ws(
            "\n", F.concat(F.lit("# Document: "), name), F.lit(""),
            F.concat(F.lit("**Document ID:** `"), F.col("doc_id").cast("string"), F.lit("`  ")), F.concat(F.lit("**File type:** "), F.coalesce("file_type", F.lit("")), F.lit("  ")),
            F.concat(F.lit("**Pages:** "), F.coalesce("page_count", F.lit(0)).cast("string"), F.lit("  ")), F.lit("**Processing time:** 0.0 ms"), F.lit(""),
            F.when(
                F.col("classification").isNotNull(),
                section(
                    "Classification", F.concat(F.lit("**Type:** "), F.col("classification.document_type"), F.lit("  ")),
                    F.concat(F.lit("**Confidence:** "), percent(F.col("classification.confidence"), 1)), F.lit(""),
                    F.lit("| Document Type | Score |"), F.lit("|---|---|"), F.array_join(scores, "\n")
                )
            ),
            F.when(F.col("summary") != "", section("Summary", F.col("summary"))),
            F.when(F.size("keywords") > 0, section("Keywords", F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("`"), k, F.lit("`"))), ", "))),
            F.when(
                F.size("entities") > 0,
                section(
                    "Entities", F.lit("| Type | Text | Normalized | Role | Confidence |"), F.lit("|---|---|---|---|---|"),
                    F.array_join(F.transform("entities", entity), "\n")
                )
            ),
            F.when(F.size("tables") > 0, F.concat_ws("\n", F.lit("## Tables"), F.array_join(_numbered(F.col("tables"), table), "\n"))),
            F.when(F.size(F.map_keys("metadata")) > 0, section("Metadata", F.array_join(F.transform(known, lambda m: F.concat(F.lit("- **"), m["key"], F.lit(":** "), m["value"])), "\n"))),
        ).alias("markdown"),
    )


FORMATS = {"json": as_json, "csv": as_csv, "markdown": as_markdown}


def formatted(result: DataFrame, name: str) -> DataFrame:
    if name not in FORMATS:
        raise ValueError(f"Unsupported format: {name!r}; there are {', '.join(FORMATS)}")
    return FORMATS[name](result)
