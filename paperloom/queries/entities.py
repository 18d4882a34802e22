"""Queries of entity recognition, roles, fields, and of the document plan and store."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fixed_values
from paperloom.operators import classify, entities
from paperloom.plans import documents, fields
from paperloom.plans.store import DocumentStore, chunk_rows
from paperloom.queries.analysis import MERGED_SQL
from paperloom.queries.text import RULE_TYPES_SQL, sql_text, table
from paperloom.shipping import scratch_path
from paperloom.sources import files, render

_O, _C, _G = "chr(57344)", "chr(57345)", "chr(57346)"
COLUMNS = ("doc_id", "ord", "text", "entity_type", "start", "end", "confidence", "normalized", "role")


def _rows(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return entities.entity_rows(render.rendered(spark, sf_dir), **how)


def _of_kind(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(spark, sf_dir, dedup=False, link=False, kinds=(kind,)).select("doc_id", "ord", "text", "start", "end", "normalized")

    return query


def _sql_date(raw: str) -> str:
    v = f"regexp_replace(regexp_replace({raw}, '\\s+', ' ', 'g'), ',$', '')"
    part = lambda p, g: f"regexp_extract({v}, '{p}', {g})"
    real = lambda y, m, d: f"strftime(try_strptime({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d')"
    slash = r"^(\d{1,2})/(\d{1,2})/(\d+)$"
    a, b, y = (part(slash, i) for i in (1, 2, 3))
    named, turned = r"^([A-Za-z]+) (\d{1,2}),? (\d{4})$", r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$"
    month = lambda m: f"CAST((instr('{entities._MONTH_KEY}', lower(substr({m}, 1, 3))) + 2) // 3 AS VARCHAR)"
    iso, dots = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    return f"""CASE WHEN regexp_matches({v}, '{iso}') THEN {real(part(iso, 1), part(iso, 2), part(iso, 3))}
      WHEN regexp_matches({v}, '{slash}') AND length({y}) = 4 THEN coalesce({real(y, a, b)}, {real(y, b, a)})
      WHEN regexp_matches({v}, '{slash}') AND length({y}) = 2 THEN {real(f"(CASE WHEN CAST({y} AS INTEGER) >= 69 THEN '19' ELSE '20' END || {y})", a, b)}
      WHEN regexp_matches({v}, '{dots}') THEN {real(part(dots, 3), part(dots, 2), part(dots, 1))}
      WHEN regexp_matches({v}, '{named}') THEN {real(part(named, 3), month(part(named, 1)), part(named, 2))}
      WHEN regexp_matches({v}, '{turned}') THEN {real(part(turned, 3), month(part(turned, 2)), part(turned, 1))} END"""


def _sql_normal(kind: str) -> str:
    return {
        "email": "lower(text)", "date": _sql_date("text"), "amount": "nullif(regexp_replace(text, '[^\\d.]', '', 'g'), '')", "phone": "regexp_replace(text, '\\D', '', 'g')",
        "reference_number": "upper(text)", "person": "text",
    }.get(kind, "CAST(NULL AS VARCHAR)")


def _spans_sql(pattern: str, group: bool) -> str:
    """doc_id, i, text, start, "end" of all matches in d(doc_id, t)."""
    mark = f"{_O} || '\\0' || {_G} || '\\1' || {_C}" if group else f"{_O} || '\\0' || {_C}"
    whole = f"split_part(p, {_G}, 1)" if group else "p"
    shown = f"split_part(p, {_G}, 2)" if group else "p"
    return f"""SELECT doc_id, i, {shown} AS text, CAST(far - length({shown}) AS INTEGER) AS start, CAST(far AS INTEGER) AS "end" FROM (
      SELECT *, sum(length({whole})) OVER (PARTITION BY doc_id ORDER BY i) AS far FROM (
        SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (
          SELECT doc_id, string_split(replace(regexp_replace(t, {sql_text(pattern)}, {mark}, 'g'), {_C}, {_O}), {_O}) AS parts FROM d))) WHERE i % 2 = 0"""


#: Letters and digits beyond ASCII as underscores, which are word characters too: so word boundaries are where Unicode has them.
_BOUNDED = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{N}]', '_', 'g')"


def recognised_sql(kinds: tuple[str, ...] | None = None, documents: bool = False) -> str:
    """A list of common table expressions that ends in e(doc_id, ord, text, entity_type, start, end, confidence, normalized),
    of the rendered texts or of the documents, whose texts aren't ASCII: they are searched as _BOUNDED and shown as they are."""
    source = f"SELECT doc_id, {_BOUNDED} AS t, text AS o FROM documents" if documents else f"SELECT doc_id, text AS t FROM ({render.RENDERED_SQL})"
    ctes, unions = [f"d AS MATERIALIZED ({source})"], []
    for k, (kind, confidence, patterns, g) in enumerate(fixed_values.RECOGNISERS):
        if kinds and kind not in kinds:
            continue
        union = " UNION ALL ".join(f"SELECT *, {j} AS pat FROM ({_spans_sql(p, g)})" for j, p in enumerate(patterns))
        if documents:
            union = f"""SELECT doc_id, pat, i, substr(o, start + 1, "end" - start) AS text, start, "end" FROM ({union}) JOIN d USING (doc_id)"""
        shown = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')" if kind in entities.TRIMMED else "text"
        ctes.append(f'k{k} AS MATERIALIZED (SELECT doc_id, pat, i, {shown} AS text, start, "end" FROM ({union}))')
        only = {"reference_number": "QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY pat, i) = 1", "organization": "WHERE length(text) >= 5"}.get(kind, "")
        unions.append(f"""SELECT doc_id, {k} AS kind, pat, i, text, '{kind}' AS entity_type, start, "end", CAST({confidence} AS DOUBLE) AS confidence, {_sql_normal(kind)} AS normalized FROM k{k} {only}""")
    ctes.append("u AS MATERIALIZED (" + " UNION ALL ".join(unions) + ")")
    ctes.append("""e AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, pat, i) - 1 AS INTEGER) AS ord, text, entity_type, start, "end", confidence, normalized FROM u)""")
    return ", ".join(ctes)


_DEDUP = """f AS (SELECT * FROM e QUALIFY coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < "end")"""


def _roles_sql() -> str:
    cases = " ".join(f"WHEN entity_type = '{k}' AND ({' OR '.join(f'contains(ctx, {sql_text(p)})' for p in phrases)}) THEN '{role}'" for phrases, k, role in fixed_values.ROLE_RULES)
    return f"""
c AS (SELECT f.*, lower(substr(t, greatest(start - 60, 0) + 1, least(start, 60))) AS ctx,
  regexp_replace(lower(array_to_string(string_split(substr(t, 1, start), chr(10))[-1:], '')), '^\\s+|\\s+$', '', 'g') AS line FROM f JOIN d USING (doc_id)),
g AS (SELECT doc_id, ord, text, entity_type, start, "end", confidence, normalized, CASE {cases}
  WHEN regexp_matches(line, '{fixed_values.ROLE_LABEL}') THEN 'field:' || regexp_replace(regexp_extract(line, '{fixed_values.ROLE_LABEL}', 1), '\\s+$', '') END AS role FROM c)"""


_QUOTED = ", ".join('"end"' if c == "end" else c for c in COLUMNS)
DEDUP_SQL = f"WITH {recognised_sql()}, {_DEDUP} SELECT {_QUOTED.replace(', role', '')} FROM f"
LINKED_CTES = f"{recognised_sql()}, {_DEDUP}, {_roles_sql()}"


def entities_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, link=False).drop("role")


def entities_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


def entity_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("entity_type", "role").agg(F.count("*").alias("n"))


def roles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked entities of rendered documents, counted by document type and role."""
    docs = classify.rule_classified(render.rendered(spark, sf_dir))
    return entities.entity_rows(docs, keep=("document_type",)).groupBy("document_type", "entity_type", "role").agg(F.count("*").alias("n"))


def entities_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus itself, whose texts aren't ASCII: spans follow Unicode word boundaries."""
    return entities.entity_rows(table(spark, sf_dir, "documents"))


def structured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.structured_fields(render.rendered(spark, sf_dir), kind=None).select(
        "doc_id", "field_name", "field_ord", F.size("field_values").cast("bigint").alias("n_values"),
        F.array_join("field_values", " | ").alias("field_values")
    )


def _fields_sql() -> str:
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    values = ", ".join(f"('{t}', '{n}', {i}, {lst(r)}, {lst(k)})" for t, n, i, r, k in fields.field_rows())
    return f"""
WITH {LINKED_CTES}, kinds AS (SELECT doc_id, document_type FROM ({RULE_TYPES_SQL}) WHERE doc_id < 1000000000),
fd(document_type, field_name, field_ord, roles, types) AS (VALUES {values}),
x AS (SELECT k.doc_id, fd.field_name, fd.field_ord, g.start, g.ord, coalesce(nullif(g.normalized, ''), g.text) AS v, list_contains(fd.roles, coalesce(g.role, '')) AS hit
  FROM kinds k JOIN fd USING (document_type) LEFT JOIN g ON g.doc_id = k.doc_id AND list_contains(fd.types, g.entity_type)),
y AS (SELECT *, bool_or(coalesce(hit, false)) OVER (PARTITION BY doc_id, field_name) AS any_hit FROM x)
SELECT doc_id, field_name, CAST(field_ord AS INTEGER) AS field_ord, count(v) FILTER (hit OR NOT any_hit) AS n_values, coalesce(string_agg(v, ' | ' ORDER BY start, ord) FILTER (hit OR NOT any_hit), '') AS field_values
FROM y GROUP BY doc_id, field_name, field_ord
"""


def _rendering(name: str, options: documents.Options = documents.Options()):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents.formatted(documents.run(render.rendered(spark, sf_dir), options), name)

    return query


_CELL = lambda c: f"CASE WHEN regexp_matches(coalesce({c}, ''), '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"
CSV_SQL = f"""
WITH {LINKED_CTES}, lines AS (SELECT doc_id, string_agg(concat_ws(',', {_CELL("entity_type")}, {_CELL("text")}, {_CELL("normalized")}, printf('%.2f', confidence), start, "end", {_CELL("role")}) || chr(13) || chr(10), '' ORDER BY start, "end" DESC, ord) AS l FROM g GROUP BY doc_id)
SELECT d.doc_id, '=== ENTITIES ===' || chr(13) || chr(10) || 'type,text,normalized,confidence,start,end,role' || chr(13) || chr(10) || coalesce(l, '') AS csv FROM d LEFT JOIN lines USING (doc_id)
"""


def document_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.run(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))
    return _shown(out)


def _shown(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        "classification.document_type",
        F.size("entities").cast("bigint").alias("n_entities"),
        F.coalesce(F.size("structured_fields"), F.lit(0)).cast("bigint").alias("n_fields"),
        F.array_join("keywords", "|").alias("keywords"),
        "summary",
    )


def document_plan_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan but for summaries, which SQL can't rank, over rendered documents."""
    out = documents.run(render.rendered(spark, sf_dir), documents.Options(run_summary=False))
    return _shown(out).drop("summary").withColumn("n_fields", F.greatest("n_fields", F.lit(0)))


PLAN_SQL = f"""
SELECT doc_id, document_type, coalesce(n_entities, 0) AS n_entities, coalesce(n_fields, 0) AS n_fields, coalesce(keywords, '') AS keywords
FROM (SELECT doc_id, document_type FROM ({RULE_TYPES_SQL}) WHERE doc_id < 1000000000)
LEFT JOIN (SELECT doc_id, count(*) AS n_entities FROM ({DEDUP_SQL}) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_fields FROM ({_fields_sql()}) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(keyword, '|' ORDER BY rank) AS keywords FROM ({MERGED_SQL}) GROUP BY doc_id) USING (doc_id)
"""


def _stored(spark: SparkSession, sf_dir: str) -> DocumentStore:
    """A store of all labelled documents: those of quality 0 are saved again with another type, the toxic ones deleted."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("document_id"),
        F.lit("text").alias("file_type"),
        F.lit("first").alias("document_type"),
        "text",
        F.timestamp_seconds(F.col("doc_id") % 1000).alias("created_at"),
        "quality",
        "toxic",
    )
    store = DocumentStore(spark, scratch_path(spark, "store"))
    blocks = rows.select("document_id", F.lit(1).alias("page_num"), F.posexplode(F.split("text", "\n")).alias("block_idx", "text"), F.lit("paragraph").alias("block_type"))
    store.save(rows.drop("quality", "toxic"), chunks=chunk_rows(blocks))
    store.save(rows.filter("quality = 0").withColumn("document_type", F.lit("second")).drop("quality", "toxic"))
    store.delete_all(rows.filter("toxic = 1"))
    return store


def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a store after saves, replacements and deletions, with their numbers of chunks."""
    store = _stored(spark, sf_dir)
    chunks = store.table("chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    rows = store.table("documents").join(chunks, "document_id", "left")
    return rows.select("document_id", "document_type", "created_at", F.length("text").cast("bigint").alias("n_chars"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty, the newest first, with the number of all documents."""
    store = _stored(spark, sf_dir)
    return store.page(20, 20).select("document_id", "document_type", "created_at", F.lit(store.count()).cast("bigint").alias("total"))


def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id: the first that the labels name and that isn't toxic; nothing for the first toxic one."""
    store, labels = _stored(spark, sf_dir), table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    some = [r[0] for toxic in (0, 1) for r in labels.filter(F.col("toxic") == toxic).agg(F.min("doc_id")).collect()]  # two numbers
    found = [store.get(str(i).zfill(12)) for i in some if i is not None]
    return functools.reduce(DataFrame.unionByName, found).select("document_id", "document_type", F.length("text").cast("bigint").alias("n_chars"))


_KEPT = """kept AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS document_id, CASE WHEN quality = 0 THEN 'second' ELSE 'first' END AS document_type, quality, text, doc_id,
  make_timestamp(CAST(doc_id % 1000 AS BIGINT) * 1000000) AS created_at FROM documents JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1)"""
STORE_SQL = f"""
WITH {_KEPT} SELECT document_id, document_type, created_at, CAST(least(length(text), 100000) AS BIGINT) AS n_chars,
  CASE WHEN quality = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n_chunks FROM kept
"""
STORE_PAGE_SQL = f"""
WITH {_KEPT} SELECT document_id, document_type, created_at, (SELECT count(*) FROM kept) AS total FROM kept ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 20
"""
STORE_GET_SQL = f"""
WITH {_KEPT} SELECT document_id, document_type, CAST(least(length(text), 100000) AS BIGINT) AS n_chars FROM kept
WHERE doc_id = (SELECT min(doc_id) FROM documents JOIN labels USING (doc_id) WHERE toxic = 0)
"""


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, names and ids of paths: the address of every page, with a suffix by its number."""
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".jpeg", ".txt", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    p = F.concat(F.regexp_replace("url", r"[?#].*$", ""), suffix)
    rows = table(spark, sf_dir, "pages").select("page_id", p.alias("path"))
    return rows.select(
        "page_id", files.file_type(F.col("path")).alias("file_type"), files.mime_type(F.col("path")).alias("mime_type"),
        files.is_supported(F.col("path")).alias("supported"), files.document_id(F.col("path")).alias("document_id"),
        files.clean_name(F.col("path")).alias("name")
    )


PAGES_SQL = """
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['.pdf', '.PNG', '.jpeg', '.txt', ''][page_id % 5 + 1] AS path FROM pages),
s AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([A-Za-z0-9]+)$', 1)) AS x FROM p)
SELECT page_id, CASE WHEN x = 'pdf' THEN 'pdf' WHEN x IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp', 'gif') THEN 'image' ELSE 'scan' END AS file_type,
  CASE x WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' ELSE 'application/octet-stream' END AS mime_type,
  x IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp', 'gif') AS supported, substr(sha1(path), 1, 12) AS document_id,
  regexp_replace(regexp_replace(regexp_replace(path, '[^\\p{L}\\p{N}_\\s.-]', '_', 'g'), '\\s+', '_', 'g'), '^_+|_+$', '', 'g') AS name
FROM s
"""

KINDS = tuple(k for k, *_ in fixed_values.RECOGNISERS)
QUERIES = {f"entities_{k}": _of_kind(k) for k in KINDS} | {
    "entities_dedup": entities_dedup, "entities_linked": entities_linked, "entity_role_counts": entity_role_counts, "roles_by_type": roles_by_type, "entities_in_documents": entities_in_documents, "structured_fields": structured_fields,
    "render_json": _rendering("json"), "render_csv": _rendering("csv", documents.Options(run_summary=False, run_keywords=False)), "render_markdown": _rendering("markdown"),
    "document_plan": document_plan, "document_plan_rendered": document_plan_rendered, "store_listing": store_listing, "store_page": store_page, "store_get": store_get, "page_addresses": page_addresses,
}
ORACLE_SQL = {f"entities_{k}": f'WITH {recognised_sql((k,))} SELECT doc_id, ord, text, start, "end", normalized FROM e' for k in KINDS} | {
    "entities_dedup": DEDUP_SQL, "entities_linked": f"WITH {LINKED_CTES} SELECT {_QUOTED} FROM g", "entity_role_counts": f"WITH {LINKED_CTES} SELECT entity_type, role, count(*) AS n FROM g GROUP BY ALL",
    "roles_by_type": f"WITH {LINKED_CTES} SELECT document_type, entity_type, role, count(*) AS n FROM g JOIN (SELECT doc_id, document_type FROM ({RULE_TYPES_SQL}) WHERE doc_id < 1000000000) USING (doc_id) GROUP BY ALL",
    "structured_fields": _fields_sql(), "render_csv": CSV_SQL, "document_plan_rendered": PLAN_SQL, "store_listing": STORE_SQL, "store_page": STORE_PAGE_SQL, "store_get": STORE_GET_SQL,
    "entities_in_documents": f"WITH {recognised_sql(documents=True)}, {_DEDUP}, {_roles_sql()} SELECT {_QUOTED} FROM g", "page_addresses": PAGES_SQL,
}
