"""Queries of the text functions, classification and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fixed_values
from paperloom.functions import text as T
from paperloom.functions.fixed_values import DOCUMENT_TYPES, OTHER_THRESHOLD, SIGNATURES, THRESHOLDS
from paperloom.operators import boilerplate, classify, keywords
from paperloom.sources import render
from paperloom.sources.tables import read_table, spread

SPACE, INK, RUN, CONTROL = T.SPACE, T.INK, T.RUN, T.CONTROL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda z: z <> '')"


def sql_words(x: str, least: int) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{RUN}'), lambda w: regexp_full_match(w, '[a-z]{{{least},}}'))"


def sql_pieces(marked: str) -> str:
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_sentences(x: str) -> str:
    held = x
    for a in fixed_values.ABBREVIATIONS:
        held = f"replace({held}, '{a}.', '{a}' || chr(1))"
    cut = f"regexp_replace({held}, '([.!?]){SPACE}+([A-Z\"''])', '\\1' || chr(2) || '\\2', 'g')"
    return f"list_transform({sql_pieces(cut)}, lambda s: replace(s, chr(1), '.'))"


def sql_loose_sentences(x: str) -> str:
    return sql_pieces(f"regexp_replace({x}, '([.!?]){SPACE}+', '\\1' || chr(2), 'g')")


def sql_paragraphs(x: str) -> str:
    return sql_pieces(f"regexp_replace({x}, '\\n{SPACE}*\\n', chr(2), 'g')")


def sql_plain_forms(x: str) -> str:
    for a, b in fixed_values.PLAIN_FORMS.items():
        x = f"replace({x}, chr({ord(a)}), {sql_text(b)})"
    return x


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("char_count"), T.ink_count(t).alias("ink_count"), T.tokens(t).alias("w"), F.size(T.sentences(t)).cast("bigint").alias("sentence_count"), F.size(T.paragraphs(t)).cast("bigint").alias("paragraph_count")
    )
    n = F.size("w").cast("bigint")
    total = lambda f: F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + f(x))
    rows = rows.select("*", n.alias("word_count"), total(lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}_]", ""))).alias("letters"), total(T.syllables).alias("syllable_count"))
    return rows.select(
        "doc_id", "char_count", "ink_count", "word_count", "sentence_count", "paragraph_count", "syllable_count",
        F.when(F.col("word_count") > 0, T.round2(F.col("letters") / F.col("word_count"))).otherwise(F.lit(0.0)).alias("avg_word_length"),
        T.round2(F.col("word_count") / F.greatest("sentence_count", F.lit(1))).alias("avg_sentence_length"),
        T.reading_ease(F.col("word_count"), F.col("sentence_count"), F.col("syllable_count")).alias("reading_ease"),
    )


_SYL = "regexp_replace(lower(x), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')"
TEXT_STATISTICS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, {sql_tokens('t')} AS w, len({sql_sentences('t')}) AS s, len({sql_paragraphs('t')}) AS p FROM d),
b AS (SELECT *, len(w) AS n, CAST(coalesce(list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')))), 0) AS BIGINT) AS letters,
  list_transform(w, lambda x: {_SYL}) AS cores FROM a),
c AS (SELECT *, CAST(coalesce(list_sum(list_transform(cores, lambda y: CASE WHEN y = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(y, '[aeiouy]+')) - CASE WHEN y LIKE '%e' AND len(regexp_extract_all(y, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)), 0) AS BIGINT) AS syl FROM b)
SELECT doc_id, CAST(length(t) AS BIGINT) AS char_count, CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS ink_count, CAST(n AS BIGINT) AS word_count, CAST(s AS BIGINT) AS sentence_count, CAST(p AS BIGINT) AS paragraph_count, syl AS syllable_count,
  CASE WHEN n > 0 THEN floor(CAST(letters AS DOUBLE) / n * 100 + 0.5) / 100 ELSE CAST(0 AS DOUBLE) END AS avg_word_length,
  floor(CAST(n AS DOUBLE) / greatest(s, 1) * 100 + 0.5) / 100 AS avg_sentence_length,
  floor(least(CAST(100 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * (CAST(greatest(n, 1) AS DOUBLE) / CAST(greatest(s, 1) AS DOUBLE)) - CAST(84.6 AS DOUBLE) * (CAST(syl AS DOUBLE) / CAST(greatest(n, 1) AS DOUBLE)))) * 100 + 0.5) / 100 AS reading_ease
FROM c
"""


def language_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", T.language(F.coalesce("text", F.lit(""))).alias("language"))
    return rows.groupBy("source", "language").agg(F.count("*").alias("n"))


_MARKERS = ", ".join(f"'{m}'" for m in fixed_values.ENGLISH_MARKERS if len(m) > 1)
LANGUAGE_SQL = f"SELECT source, CASE WHEN len(list_intersect({sql_words('coalesce(text, chr(32))', 2)}, [{_MARKERS}])) >= 3 THEN 'en' ELSE 'unknown' END AS language, count(*) AS n FROM documents GROUP BY ALL"


def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.word_frequencies(read_table(spark, sf_dir, "documents"), 20)


WORD_FREQUENCY_SQL = f"""
WITH w AS (SELECT doc_id, {sql_words('text', 2)} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w),
c AS (SELECT doc_id, term, count(*) AS n, min(i) AS f FROM e GROUP BY ALL)
SELECT doc_id, CAST(r AS INTEGER) AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, term) AS r FROM c) WHERE r <= 20
"""


def word_frequency_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(T.letter_words(F.col("text"), 2)).alias("term"))
    return words.groupBy("lang", "term").agg(F.count("*").alias("n"))


WORD_FREQUENCY_BY_LANG_SQL = f"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({sql_words('text', 2)}) AS term FROM documents) GROUP BY ALL"


def _pieces(name: str, cut):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut(F.col("text"))).alias("i", name))

    return query


def _pieces_sql(name: str, cut) -> str:
    return f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS i, unnest(p) AS {name} FROM (SELECT doc_id, {cut('text')} AS p FROM documents)"


def plain_sentences_sql(x: str) -> str:
    return sql_pieces(f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '([.!?]) +([A-Z])', '\\1' || chr(2) || '\\2', 'g')")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.collapse(t).alias("collapsed"), T.truncate(t, 20).alias("truncated"), T.clean_block(t).alias("block"),
        T.round2(T.average_token_length(t)).alias("avg_token_length")
    )


CLEAN_TEXT_SQL = f"""
SELECT doc_id, {sql_strip(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")} AS collapsed,
  CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(w[1:20], ' ') || '...' END AS truncated,
  {sql_strip(f"regexp_replace(regexp_replace({sql_plain_forms('text')}, '{CONTROL}', '', 'g'), '[ \\t]+', ' ', 'g')")} AS block,
  floor(CASE WHEN len(w) > 0 THEN CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w) ELSE 0 END * 100 + 0.5) / 100 AS avg_token_length
FROM (SELECT doc_id, text, {sql_tokens('text')} AS w FROM documents)
"""


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", boilerplate.cleaned(F.col("text")).alias("cleaned"))


def sql_tidy(x: str) -> str:
    x = f"regexp_replace({x}, '{CONTROL}', '', 'g')"
    for pattern, meant in fixed_values.MISREAD:
        x = f"regexp_replace({x}, '{pattern}', '{meant}', 'g')"
    for pattern, meant in (("\\r\\n?", "chr(10)"), ("[ \\t]*\\n[ \\t]*", "chr(10)"), ("[ \\t]+", "' '"), ("\\n{4,}", "repeat(chr(10), 3)")):
        x = f"regexp_replace({x}, '{pattern}', {meant}, 'g')"
    return sql_strip(x)


#: Letters lose their accents, what then isn't ASCII goes.
CLEAN_PAGES_SQL = f"""
WITH a AS (SELECT doc_id, regexp_replace(strip_accents({sql_plain_forms('text')}), '[^\\x00-\\x7F]', '', 'g') AS t FROM documents)
SELECT doc_id, {sql_tidy('t')} AS cleaned FROM a
"""


def rule_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.rendered(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text"))
    out = classify.rule_classified(docs)
    return out.select(
        "doc_id", "document_type", F.round("confidence", 6).alias("confidence"),
        *(F.round(F.element_at("all_scores", k), 6).alias(f"score_{k}") for k in DOCUMENT_TYPES),
        F.array_join("features_used", " ").alias("features_used")
    )


def _hits(k: str) -> str:
    return "(" + " + ".join(f"CAST(contains(low, {sql_text(p)}) AS INTEGER)" for p in SIGNATURES[k]) + ")"


_BEST = "greatest(" + ", ".join(f"h_{k}" for k in DOCUMENT_TYPES) + ")"
_ALL = "(" + " + ".join(f"h_{k}" for k in DOCUMENT_TYPES) + ")"
RULE_TYPES_SQL = f"""
WITH d AS (SELECT doc_id, text FROM ({render.RENDERED_SQL}) UNION ALL SELECT doc_id + 1000000000, text FROM documents),
l AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM d),
h AS (SELECT doc_id, t, {", ".join(f"{_hits(k)} AS h_{k}" for k in DOCUMENT_TYPES)} FROM l),
s AS (SELECT *, {_BEST} AS best, {_ALL} AS total FROM h)
SELECT doc_id, CASE WHEN total = 0 THEN 'unknown' {" ".join(f"WHEN h_{k} = best THEN CASE WHEN CAST(best AS DOUBLE) / total >= {THRESHOLDS.get(k, OTHER_THRESHOLD)} THEN '{k}' ELSE 'unknown' END" for k in DOCUMENT_TYPES)} END AS document_type,
  CASE WHEN total > 0 THEN round(CAST(best AS DOUBLE) / total, 6) ELSE 0.0 END AS confidence,
  {", ".join(f"CASE WHEN total > 0 THEN round(CAST(h_{k} AS DOUBLE) / total, 6) ELSE 0.0 END AS score_{k}" for k in DOCUMENT_TYPES)},
  CASE WHEN regexp_matches(t, '{INK}') THEN concat_ws(' ', 'rule_based', {", ".join(f"CASE WHEN h_{k} > 0 THEN 'keyword:{k}:' || h_{k} END" for k in DOCUMENT_TYPES)}) ELSE '' END AS features_used
FROM s
"""


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.rule_classified(render.rendered(spark, sf_dir)).groupBy("document_type").agg(F.count("*").alias("n"))


TYPE_COUNTS_SQL = f"SELECT document_type, count(*) AS n FROM ({RULE_TYPES_SQL}) WHERE doc_id < 1000000000 GROUP BY ALL"


def keyword_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return render.rendered(spark, sf_dir).select(
        "doc_id",
        *(
            F.round(c, 6).alias(n) for c,
            n in zip(classify.keyword_features(t), (x for k in DOCUMENT_TYPES for x in (f"keyword_{k}_hits", f"keyword_{k}_density")))
        )
    )


KEYWORD_FEATURES_SQL = f"""
SELECT doc_id, {", ".join(f"round(CAST({_hits(k)} AS DOUBLE), 6) AS keyword_{k}_hits, round(CAST({_hits(k)} AS DOUBLE) / greatest(n, 1), 6) AS keyword_{k}_density" for k in DOCUMENT_TYPES)}
FROM (SELECT doc_id, lower(text) AS low, len({sql_tokens('text')}) AS n FROM ({render.RENDERED_SQL}))
"""


def structure_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(spark, sf_dir).select("doc_id", *classify.text_features(F.col("text")), *classify.metadata_features(F.substring_index("text", "\n", 1), F.lit(None).cast("string")))


def _structure_sql() -> str:
    count = lambda p: f"CAST(len(regexp_extract_all(text, '{p}')) AS DOUBLE)"
    flag = lambda p: f"CAST(regexp_matches(text, '{p}') AS DOUBLE)"
    meta = ", ".join("CAST((" + " OR ".join(f"contains(title, '{w}')" for w in words) + f") AS DOUBLE) AS meta_{k}_title" for k, words in fixed_values.TITLE_HINTS.items())
    return f"""
SELECT doc_id, {flag(fixed_values.FEATURE_AMOUNT)} AS struct_has_numbers, {count(fixed_values.FEATURE_AMOUNT)} AS struct_amount_count, {flag(fixed_values.FEATURE_DATE)} AS struct_has_dates, {count(fixed_values.FEATURE_DATE)} AS struct_date_count,
  {flag(fixed_values.FEATURE_BLANKS)} AS struct_has_blanks, {flag(fixed_values.FEATURE_CHECKBOXES)} AS struct_has_checkboxes, CAST(len({sql_tokens('text')}) AS DOUBLE) AS struct_total_words, {meta}
FROM (SELECT *, lower(split_part(text, chr(10), 1)) AS title FROM ({render.RENDERED_SQL}))
"""


def model_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.model_classified(render.rendered(spark, sf_dir), classify.fit_text_model(spark))


PAGE_LINES = 10


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, text: the documents in pages of ten lines, with a running title above and a number below."""
    lines = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(1), F.ceil(F.size(lines) / PAGE_LINES).cast("int")), lambda p: F.array_join(F.slice(lines, (p - 1) * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    rows = docs.select("doc_id", F.posexplode(cut).alias("i", "t"))
    number = (F.col("i") + 1).cast("int")
    text = F.concat(F.lit(" Report "), F.col("doc_id").cast("string"), F.lit(" \n"), F.col("t"), F.lit("\nPage "), number.cast("string"))
    return rows.select("doc_id", number.alias("page_num"), text.alias("text"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(paged(spark, sf_dir))


def without_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.without_repeated_lines(paged(spark, sf_dir))


_LINES = "CASE WHEN t = '' THEN [] WHEN t LIKE '%' || chr(10) THEN string_split(t, chr(10))[1:-2] ELSE string_split(t, chr(10)) END"
_REPEATED = f"""
s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
n0 AS (SELECT *, unnest(generate_series(1, CAST(ceil(len(l) / {PAGE_LINES}) AS BIGINT))) AS p FROM s),
pg AS (SELECT doc_id, CAST(p AS INTEGER) AS page_num,
  ' Report ' || doc_id || ' ' || chr(10) || array_to_string(l[(p - 1) * {PAGE_LINES} + 1 : p * {PAGE_LINES}], chr(10)) || chr(10) || 'Page ' || p AS text FROM n0),
l AS (SELECT doc_id, page_num, text, {_LINES} AS l FROM (SELECT *, regexp_replace(text, '\\r\\n|\\r', chr(10), 'g') AS t FROM pg)),
e AS (SELECT doc_id, 'top' AS edge, unnest(l[1:2]) AS line FROM l UNION ALL SELECT doc_id, 'bottom', unnest(l[-2:]) FROM l),
r AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, edge, {sql_strip('line')} AS line FROM e) WHERE line <> '' GROUP BY doc_id, edge, line HAVING count(*) >= 3)
"""
REPEATED_LINES_SQL = f"WITH {_REPEATED} SELECT doc_id, line FROM r"
WITHOUT_REPEATED_SQL = f"""
WITH {_REPEATED}, d AS (SELECT doc_id, list(line) AS dr FROM r GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY ALL)
SELECT l.doc_id, l.page_num,
  CASE WHEN n.n < 3 THEN l.text ELSE array_to_string(list_filter(l.l, lambda x: NOT list_contains(coalesce(d.dr, []), {sql_strip('x')})), chr(10)) END AS text
FROM l JOIN n USING (doc_id) LEFT JOIN d USING (doc_id)
"""

QUERIES = {
    "text_statistics": text_statistics, "language_by_source": language_by_source, "word_frequency_topk": word_frequency, "word_frequency_by_lang": word_frequency_by_lang,
    "sentences": _pieces("sentence", T.sentences), "plain_sentences": _pieces("sentence", T.plain_sentences), "paragraphs": _pieces("paragraph", T.paragraphs),
    "clean_text": clean_text, "clean_pages": clean_pages, "rule_types": rule_types, "type_counts": type_counts, "keyword_features": keyword_features, "structure_features": structure_features,
    "model_types": model_types, "repeated_lines": repeated_lines, "without_repeated_lines": without_repeated_lines,
}
ORACLE_SQL = {
    "text_statistics": TEXT_STATISTICS_SQL, "language_by_source": LANGUAGE_SQL, "word_frequency_topk": WORD_FREQUENCY_SQL, "word_frequency_by_lang": WORD_FREQUENCY_BY_LANG_SQL,
    "sentences": _pieces_sql("sentence", sql_sentences), "plain_sentences": _pieces_sql("sentence", plain_sentences_sql), "paragraphs": _pieces_sql("paragraph", sql_paragraphs),
    "clean_text": CLEAN_TEXT_SQL, "clean_pages": CLEAN_PAGES_SQL, "rule_types": RULE_TYPES_SQL, "type_counts": TYPE_COUNTS_SQL, "keyword_features": KEYWORD_FEATURES_SQL, "structure_features": _structure_sql(),
    "repeated_lines": REPEATED_LINES_SQL, "without_repeated_lines": WITHOUT_REPEATED_SQL,
}
