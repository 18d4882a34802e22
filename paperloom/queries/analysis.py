"""Queries of similarity, keywords and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import KEYWORD_STOPWORDS, SIMILARITY_STOPWORDS
from paperloom.operators import keywords, similarity, summary
from paperloom.queries.text import SPACE, sql_loose_sentences, sql_strip, sql_text, sql_tokens, sql_words, table
from paperloom.sources import render
from paperloom.sources.tables import read_table


def _list(words) -> str:
    return "[" + ", ".join(map(sql_text, sorted(words))) + "]"


def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_matrix(table(spark, sf_dir, "benchmark"), "item_id").withColumn("score", F.round("score", 6))


def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.most_similar(table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))
    return out.withColumn("score", F.round("score", 6))


def _terms(name: str, key: str) -> str:
    return f"""SELECT *, sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY id)) AS norm FROM (
      SELECT id, term, count(*) AS n FROM (SELECT {key} AS id, unnest({sql_words('text', 3)}) AS term FROM {name}) WHERE NOT list_contains({_list(SIMILARITY_STOPWORDS)}, term) GROUP BY ALL)"""


MATRIX_SQL = f"""
WITH t AS ({_terms('benchmark', 'item_id')}), p AS (SELECT x.id AS a, y.id AS b, sum(x.n * y.n) / (any_value(x.norm) * any_value(y.norm)) AS score FROM t x JOIN t y USING (term) GROUP BY ALL)
SELECT x.item_id AS a, y.item_id AS b, CASE WHEN x.item_id = y.item_id THEN 1.0 ELSE round(coalesce(score, 0.0), 6) END AS score
FROM benchmark x CROSS JOIN benchmark y LEFT JOIN p ON p.a = x.item_id AND p.b = y.item_id
"""
MOST_SIMILAR_SQL = f"""
WITH q AS ({_terms('benchmark', 'item_id')}), d AS ({_terms('documents', 'doc_id')}),
p AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.n * d.n) / (any_value(q.norm) * any_value(d.norm)) AS score FROM q JOIN d USING (term) GROUP BY ALL),
g AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN p ON p.query_id = b.item_id AND p.doc_id = d.doc_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM g) WHERE r <= 5
"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keywords.sentence_tfidf(read_table(spark, sf_dir, "documents"), 30))


def phrase_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keywords.phrases(render.rendered(spark, sf_dir), 30))


def merged_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keywords.keywords(render.rendered(spark, sf_dir), 15))


def corpus_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged keywords of the corpus itself, whose word boundaries are Unicode's."""
    return _rounded(keywords.keywords(read_table(spark, sf_dir, "documents"), 15))


def _tfidf_ctes(source: str) -> str:
    return f"""
s AS (SELECT doc_id, {sql_loose_sentences('text')} AS s FROM {source}),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS sno FROM s),
w AS (SELECT doc_id, n, sno, list_filter({sql_words('sent', 3)}, lambda w: NOT list_contains({_list(KEYWORD_STOPWORDS)}, w)) AS w FROM e),
x AS (SELECT doc_id, n, sno, len(w) AS len, unnest(w) AS keyword, generate_subscripts(w, 1) - 1 AS i FROM w),
tf AS (SELECT doc_id, n, sno, len, keyword, count(*) AS c, min(i) AS i FROM x GROUP BY ALL),
ti AS (SELECT doc_id, keyword, sum(CAST(c AS DOUBLE) / len) * (ln(CAST(n + 1 AS DOUBLE) / (count(*) + 1)) + 1) AS score, min(sno * 1000000 + i) AS f FROM tf GROUP BY doc_id, n, keyword),
tr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, f) AS rank FROM ti)
"""


_STOP = keywords.STOP_PATTERN


#: Letters beyond ASCII as the second engine's word boundaries need them: in ASCII letters, and back.
_ACCENTED = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]


def _in_ascii(x: str) -> str:
    for c in _ACCENTED:
        x = f"replace({x}, '{c}', 'zq{ord(c):x}qz')"
    return x


def _as_it_was(x: str) -> str:
    for c in _ACCENTED:
        x = f"replace({x}, 'zq{ord(c):x}qz', '{c}')"
    return x


def _rake_ctes(source: str, ascii_: bool = True) -> str:
    """ascii_: the texts are ASCII; if not, their letters are written in it while stopwords are looked for."""
    cut = f"string_split(regexp_replace({'text' if ascii_ else _in_ascii('text')}, {sql_text(_STOP)}, chr(2), 'g'), chr(2))"
    piece = "z" if ascii_ else _as_it_was("z")
    plain = f"regexp_replace({piece}, '[^\\p{{L}}\\p{{N}}_\\-\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]', '', 'g')"
    return f"""
p AS (SELECT doc_id, list_filter(list_transform({cut}, lambda z: {sql_strip(plain)}), lambda z: length(z) >= 3) AS p FROM {source}),
pw AS (SELECT doc_id, list_filter(list_transform(p, lambda z: list_filter({sql_tokens('lower(z)')}, lambda y: length(y) >= 3)), lambda z: len(z) > 0) AS ps FROM p),
pl AS (SELECT doc_id, unnest(ps) AS words, generate_subscripts(ps, 1) - 1 AS f FROM pw),
pe AS (SELECT doc_id, len(words) AS len, unnest(words) AS word FROM pl),
ps AS (SELECT doc_id, word, CAST(sum(len - 1) + count(*) AS DOUBLE) / count(*) AS s FROM pe GROUP BY ALL),
pk AS (SELECT doc_id, array_to_string(words, ' ') AS keyword, min(f) AS f, any_value(words) AS words FROM pl GROUP BY doc_id, keyword),
rk AS (SELECT k.doc_id, k.keyword, k.f, sum(ps.s) AS score FROM (SELECT doc_id, keyword, f, unnest(words) AS word FROM pk) k JOIN ps ON ps.doc_id = k.doc_id AND ps.word = k.word GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, f) AS rank FROM rk)
"""


_OUT = "doc_id, CAST(rank AS INTEGER) AS rank, keyword, round(score, 6) AS score"
TFIDF_SQL = f"WITH {_tfidf_ctes('documents')} SELECT {_OUT} FROM tr WHERE rank <= 30"
_DOCS = f"r AS ({render.RENDERED_SQL})"
RAKE_SQL = f"WITH {_DOCS}, {_rake_ctes('r')} SELECT {_OUT} FROM rr WHERE rank <= 30"


def _merged_sql(first: str, source: str, ascii_: bool) -> str:
    return f"""WITH {first}, {_tfidf_ctes(source)}, {_rake_ctes(source, ascii_)},
both_kinds AS (SELECT doc_id, keyword, score, rank, 0 AS src FROM tr WHERE rank <= 30 UNION ALL SELECT doc_id, keyword, score, rank, 1 FROM rr WHERE rank <= 30),
u AS (SELECT doc_id, keyword, sum(score) AS score, min(src * 1000 + rank) AS f FROM both_kinds GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, f) AS rank FROM u) SELECT {_OUT} FROM m WHERE rank <= 15"""


MERGED_SQL = _merged_sql(_DOCS, "r", True)
CORPUS_SQL = _merged_sql("r AS (SELECT doc_id, text FROM documents)", "r", False)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summaries(table(spark, sf_dir, "documents"))


QUERIES = {
    "similarity_matrix": similarity_matrix, "most_similar": most_similar, "tfidf_keywords": tfidf_keywords, "phrase_keywords": phrase_keywords, "merged_keywords": merged_keywords,
    "corpus_keywords": corpus_keywords, "summaries": summaries,
}
ORACLE_SQL = {"similarity_matrix": MATRIX_SQL, "most_similar": MOST_SIMILAR_SQL, "tfidf_keywords": TFIDF_SQL, "phrase_keywords": RAKE_SQL, "merged_keywords": MERGED_SQL, "corpus_keywords": CORPUS_SQL}
