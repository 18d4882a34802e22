"""Queries of geometry, layout and tables, over pages made from the corpus by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fixed_values
from paperloom.functions import geometry as G
from paperloom.operators import classify, layout, tables
from paperloom.queries.text import INK, SPACE, sql_strip, sql_tokens, table

PER_PAGE, WIDTH, HEIGHT = 24, 612.0, 792.0


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, 24 a page, in one or two columns, with sizes and places by their numbers."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    k, n = F.col("i") % PER_PAGE, F.length("text")
    two = F.col("doc_id") % 3 == 0
    x0 = F.when(two & (k % 2 == 1), 320).otherwise(40 + k % 3) + F.col("doc_id") % 7
    y0 = F.when(two, F.floor(k / 2) * 62).otherwise(k * 31) + 4
    size = F.when(k == 0, 18).when(k % 9 == 4, 13).when(k % 11 == 7, 0).otherwise(10 + F.col("doc_id") % 2)
    box = G.box(x0, y0, x0 + F.least(n * 5, F.lit(240)), y0 + 12)
    return lines.select(
        "doc_id", (F.floor(F.col("i") / PER_PAGE) + 1).cast("int").alias("page_num"), k.cast("int").alias("block_idx"), "text",
        F.when(k % 13 != 11, box).alias("bbox"), size.cast("double").alias("font_size"), F.lit("paragraph").alias("block_type")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


BLOCKS = f"""
lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
k AS (SELECT *, i % {PER_PAGE} AS k, length(text) AS n FROM lines),
g AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND k % 2 = 1 THEN 320 ELSE 40 + k % 3 END + doc_id % 7 AS xi, CASE WHEN doc_id % 3 = 0 THEN (k // 2) * 62 ELSE k * 31 END + 4 AS yi FROM k),
b AS (SELECT doc_id, CAST(i // {PER_PAGE} + 1 AS INTEGER) AS page_num, CAST(k AS INTEGER) AS block_idx, text,
  CASE WHEN k % 13 <> 11 THEN CAST(xi AS DOUBLE) END AS x0, CASE WHEN k % 13 <> 11 THEN CAST(yi AS DOUBLE) END AS y0, CASE WHEN k % 13 <> 11 THEN CAST(xi + least(n * 5, 240) AS DOUBLE) END AS x1, CASE WHEN k % 13 <> 11 THEN CAST(yi + 12 AS DOUBLE) END AS y1,
  CAST(CASE WHEN k = 0 THEN 18 WHEN k % 9 = 4 THEN 13 WHEN k % 11 = 7 THEN 0 ELSE 10 + doc_id % 2 END AS DOUBLE) AS size FROM g),
pg AS (SELECT DISTINCT doc_id, page_num FROM b)
"""
FONTS = """
fs AS (SELECT doc_id, page_num, size, sum(length(text)) AS chars, min(block_idx) AS f FROM b WHERE size > 0 GROUP BY ALL),
fo AS (SELECT pg.*, coalesce(size, 11.0) AS dominant_font FROM pg LEFT JOIN (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY chars DESC, f) = 1) USING (doc_id, page_num))
"""
COLS = f"""
gp AS (SELECT doc_id, page_num, (x0 + x1) / 2 - lag((x0 + x1) / 2) OVER (PARTITION BY doc_id, page_num ORDER BY (x0 + x1) / 2) AS gap FROM b WHERE x0 IS NOT NULL),
gm AS (SELECT *, avg(gap) OVER (PARTITION BY doc_id, page_num) AS m FROM gp),
co AS (SELECT pg.*, CAST(least(coalesce(k, 0) + 1, 3) AS INTEGER) AS columns FROM pg LEFT JOIN (SELECT doc_id, page_num, count(*) FILTER (gap > m * 3 AND gap > {WIDTH} * 0.05::DOUBLE) AS k FROM gm GROUP BY ALL) USING (doc_id, page_num))
"""


def dominant_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dominant_fonts(blocks(spark, sf_dir))


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_counts(blocks(spark, sf_dir), pages(spark, sf_dir))


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.analysed(blocks(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", "page_num", "block_idx", "zone", "block_type", "column", "reading_order")


_T = sql_strip("text")
_TOK = sql_tokens("t")
LAYOUT = f"""{BLOCKS}, {FONTS}, {COLS},
z AS (SELECT b.*, dominant_font, columns, CASE WHEN y0 IS NULL THEN 'body' WHEN (y0 + y1) / 2 <= {HEIGHT} * 0.1::DOUBLE THEN 'header' WHEN (y0 + y1) / 2 >= {HEIGHT} * 0.9::DOUBLE THEN 'footer' ELSE 'body' END AS zone,
  {_T} AS t FROM b JOIN fo USING (doc_id, page_num) JOIN co USING (doc_id, page_num)),
y AS (SELECT *, len({_TOK}) AS words FROM z),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{INK}') THEN 'paragraph' WHEN zone = 'footer' OR regexp_matches(t, '{fixed_values.FOOTER}') THEN 'footer'
  WHEN regexp_matches(t, '{fixed_values.BULLET}') OR regexp_matches(t, '{fixed_values.NUMBERED}') THEN 'list_item' WHEN regexp_matches(t, '{fixed_values.CAPTION}') THEN 'caption'
  WHEN size >= 16 AND words <= 15 THEN CASE WHEN size > dominant_font * 1.5::DOUBLE THEN 'title' ELSE 'header' END WHEN size >= 12 AND words <= 15 THEN 'header' WHEN zone = 'header' AND words <= 15 THEN 'header'
  WHEN words <= 8 AND upper(t) = t AND lower(t) <> t THEN 'header' ELSE 'paragraph' END AS block_type,
  CASE WHEN columns <= 1 THEN 0 ELSE coalesce(least(CAST(floor((x0 + x1) / 2 / ({WIDTH} / columns)) AS INTEGER), columns - 1), 0) END AS col FROM y)"""
LAYOUT_SQL = f"""
WITH {LAYOUT}
SELECT doc_id, page_num, block_idx, zone, block_type, CAST(col AS INTEGER) AS "column", CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY col, coalesce(y0, 0), block_idx) - 1 AS INTEGER) AS reading_order FROM r
"""


def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = layout.margins(blocks(spark, sf_dir), pages(spark, sf_dir))
    return m.select("doc_id", "page_num", *(F.round(c, 6).alias(c) for c in ("left", "right", "top", "bottom")))


MARGINS_SQL = f"""
WITH {BLOCKS} SELECT doc_id, page_num, coalesce(round(min(x0) / {WIDTH}, 6), 0.0) AS "left", coalesce(round(1 - max(x1) / {WIDTH}, 6), 0.0) AS "right", coalesce(round(min(y0) / {HEIGHT}, 6), 0.0) AS top, coalesce(round(1 - max(y1) / {HEIGHT}, 6), 0.0) AS bottom FROM b GROUP BY ALL
"""


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box with the next one of its page."""
    b = blocks(spark, sf_dir).filter(F.col("bbox").isNotNull()).select("doc_id", "page_num", "block_idx", "bbox")
    nxt = b.select("doc_id", "page_num", (F.col("block_idx") - 1).alias("block_idx"), F.col("bbox").alias("other"))
    a, o = F.col("bbox"), F.col("other")
    r = lambda c: F.round(c, 6)
    return b.join(nxt, ["doc_id", "page_num", "block_idx"]).select(
        "doc_id", "page_num", "block_idx", G.area(a).alias("area"), G.overlap(a, o).alias("overlap"), r(G.iou(a, o)).alias("iou"), G.contains(a, o).alias("contains"), G.merge(a, o)["x1"].alias("merged_x1"), r(G.distance(a, o)).alias("distance"),
        r(G.horizontal_overlap(a, o)).alias("h_overlap"), G.vertical_gap(a, o).alias("v_gap"), G.relative_position(a, o).alias("position"), r(G.aspect_ratio(a)).alias("aspect"), G.grid_position(a, F.lit(WIDTH), F.lit(HEIGHT))["col"].alias("grid_col"), G.grid_position(a, F.lit(WIDTH), F.lit(HEIGHT))["row"].alias("grid_row"),
        G.has_point(a, F.lit(100.0), G.center_y(a)).alias("has_point"),
    )


BOXES_SQL = f"""
WITH {BLOCKS}, p AS (SELECT a.*, o.x0 AS u0, o.y0 AS v0, o.x1 AS u1, o.y1 AS v1 FROM b a JOIN b o ON a.doc_id = o.doc_id AND a.page_num = o.page_num AND a.block_idx + 1 = o.block_idx WHERE a.x0 IS NOT NULL AND o.x0 IS NOT NULL),
q AS (SELECT *, greatest(0.0::DOUBLE, x1 - x0) AS w, greatest(0.0::DOUBLE, y1 - y0) AS h, greatest(0.0::DOUBLE, u1 - u0) AS w2, greatest(0.0::DOUBLE, v1 - v0) AS h2, least(x1, u1) - greatest(x0, u0) AS iw, least(y1, v1) - greatest(y0, v0) AS ih,
  (x0 + x1) / 2 - (u0 + u1) / 2 AS dx, (y0 + y1) / 2 - (v0 + v1) / 2 AS dy FROM p),
s AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih ELSE 0 END AS ov FROM q)
SELECT doc_id, page_num, block_idx, w * h AS area, CAST(ov AS DOUBLE) AS overlap, CASE WHEN ov > 0 THEN round(ov / (w * h + w2 * h2 - ov), 6) ELSE 0.0 END AS iou, x0 <= u0 AND y0 <= v0 AND x1 >= u1 AND y1 >= v1 AS contains, greatest(x1, u1) AS merged_x1, round(sqrt(dx * dx + dy * dy), 6) AS distance,
  CASE WHEN least(w, w2) > 0 THEN round(greatest(0.0::DOUBLE, iw) / least(w, w2), 6) ELSE 0.0 END AS h_overlap, v0 - y1 AS v_gap, CASE WHEN ov > 0 THEN 'overlapping' WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy < 0 THEN 'above' ELSE 'below' END WHEN dx < 0 THEN 'left' ELSE 'right' END AS position,
  CASE WHEN h > 0 THEN round(w / h, 6) ELSE 0.0 END AS aspect, ['left', 'center', 'right'][least(2, CAST(floor((x0 + x1) / 2 / {WIDTH} * 3) AS INTEGER)) + 1] AS grid_col, ['top', 'middle', 'bottom'][least(2, CAST(floor((y0 + y1) / 2 / {HEIGHT} * 3) AS INTEGER)) + 1] AS grid_row,
  x0 <= 100 AND x1 >= 100 AS has_point
FROM s
"""


def kept_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.kept_boxes(blocks(spark, sf_dir), 0.1)


_BOX = "struct_pack(i := block_idx, x0 := x0, y0 := y0, x1 := x1, y1 := y1)"
_W = "(least(q.x1, bs[k + 1].x1) - greatest(q.x0, bs[k + 1].x0))"
_H = "(least(q.y1, bs[k + 1].y1) - greatest(q.y0, bs[k + 1].y0))"
_AREAS = "((q.x1 - q.x0) * (q.y1 - q.y0) + (bs[k + 1].x1 - bs[k + 1].x0) * (bs[k + 1].y1 - bs[k + 1].y0))"
#: One box after another, the largest first: it stays if no kept one overlaps it too much.
KEPT_SQL = f"""
WITH RECURSIVE {BLOCKS},
o AS (SELECT doc_id, page_num, list({_BOX} ORDER BY (x1 - x0) * (y1 - y0) DESC, block_idx) AS bs FROM b WHERE x0 IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, page_num, 0 AS k, bs[1:0] AS kept, bs FROM o
  UNION ALL
  SELECT doc_id, page_num, k + 1, CASE WHEN len(list_filter(kept, lambda q: {_W} > 0 AND {_H} > 0 AND {_W} * {_H} / ({_AREAS} - {_W} * {_H}) >= 0.1::DOUBLE)) > 0
    THEN kept ELSE list_append(kept, bs[k + 1]) END, bs FROM s WHERE k < len(bs))
SELECT doc_id, page_num, CAST(x.i AS INTEGER) AS block_idx FROM (SELECT doc_id, page_num, unnest(kept) AS x FROM s WHERE k = len(bs))
"""
#: Sweep after sweep: c is the sweep's cluster, i the next box, m the cluster's members so far, made the clusters of the boxes.
CLUSTERS_SQL = f"""
WITH RECURSIVE {BLOCKS},
o AS (SELECT doc_id, page_num, list(struct_pack(i := block_idx, x := (x0 + x1) / 2, y := (y0 + y1) / 2) ORDER BY block_idx) AS bs FROM b WHERE x0 IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, page_num, bs, 0 AS c, 1 AS i, bs[1:0] AS m, list_transform(bs, lambda z: -1) AS made FROM o
  UNION ALL
  SELECT doc_id, page_num, bs, CASE WHEN i > len(bs) THEN c + 1 ELSE c END, CASE WHEN i > len(bs) THEN 1 ELSE i + 1 END,
    CASE WHEN i > len(bs) THEN bs[1:0] WHEN joins THEN list_append(m, bs[i]) ELSE m END,
    CASE WHEN joins THEN list_transform(made, lambda z, j: CASE WHEN j = i THEN c ELSE z END) ELSE made END
  FROM (SELECT *, i <= len(bs) AND made[i] = -1 AND (len(m) = 0 OR len(list_filter(m, lambda q: (q.x - bs[i].x) * (q.x - bs[i].x) + (q.y - bs[i].y) * (q.y - bs[i].y) <= 3600)) > 0) AS joins
    FROM s WHERE list_contains(made, -1)))
SELECT doc_id, page_num, CAST(bs[n].i AS INTEGER) AS block_idx, CAST(made[n] AS INTEGER) AS cluster
FROM (SELECT *, unnest(generate_series(1, len(bs))) AS n FROM s WHERE NOT list_contains(made, -1))
"""


def proximity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.proximity_clusters(blocks(spark, sf_dir), 60.0)


def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, p = blocks(spark, sf_dir), pages(spark, sf_dir)
    out = classify.block_features(layout.analysed(b, p), p)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in sorted(out.columns) if c != "doc_id"))


_N = lambda c: f"CAST(count(*) FILTER ({c}) AS DOUBLE)"
_YES = lambda c: f"CAST({c} > 0 AS DOUBLE)"
FEATURES_SQL = f"""
WITH {LAYOUT}, f AS (SELECT doc_id, round(avg(len({sql_tokens('text')})), 6) AS words, {_N("block_type IN ('header', 'title')")} AS heads, {_N("block_type = 'list_item'")} AS items,
  {_N("block_type = 'paragraph'")} AS paragraphs, CAST(count(DISTINCT page_num) AS DOUBLE) AS n FROM r GROUP BY doc_id)
SELECT doc_id, words AS struct_avg_block_words, {_YES('items')} AS struct_has_bullet_lists, {_YES('heads')} AS struct_has_headers, 0.0::DOUBLE AS struct_has_tables,
  heads AS struct_header_count, items AS struct_list_item_count, CAST(n > 1 AS DOUBLE) AS struct_multi_page, n AS struct_page_count, paragraphs AS struct_paragraph_count,
  CAST(n = 1 AS DOUBLE) AS struct_single_page, 0.0::DOUBLE AS struct_table_count
FROM f
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on pages: those of each conversation turn, three to a row, a few rows shorter."""
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_num"), F.posexplode(F.split("text", " ")).alias("word_idx", "word"))
    i = F.col("word_idx")
    kept = w.filter((i % 3 != 2) | (F.floor(i / 3) % 4 != 3))
    x0 = (40 + (i % 3) * 150).cast("double")
    y0 = (50 + F.floor(i / 3) * 15 + i % 2).cast("double")
    return kept.select("doc_id", "page_num", "word_idx", "word", x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 10).alias("y1"))


WORDS = """
w0 AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_num, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM (SELECT *, string_split(text, ' ') AS l FROM conversations)),
w AS (SELECT doc_id, page_num, i, word, 40 + (i % 3) * 150 AS x0, 50 + (i // 3) * 15 + i % 2 AS y0 FROM w0 WHERE i % 3 <> 2 OR (i // 3) % 4 <> 3)
"""


def whitespace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.whitespace_tables(words(spark, sf_dir))
    return t.select(
        "doc_id", "page_num", F.size("rows").cast("bigint").alias("n_rows"), F.array_join("headers", "|").alias("headers"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("cells"), "method"
    )


def _whitespace(source: str) -> str:
    """Tables a(doc_id, page_num, all_rows) of the words of a source."""
    return f"""
ro AS (SELECT doc_id, page_num, CAST(round_even(y0 / 5.0, 0) * 5 AS INTEGER) AS row, list(word ORDER BY x0, i) AS cells FROM {source} GROUP BY ALL),
c AS (SELECT *, count(*) OVER p AS buckets, len(cells) AS n FROM ro WINDOW p AS (PARTITION BY doc_id, page_num)),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_num) AS wide FROM c WHERE n >= 2),
u AS (SELECT * FROM (SELECT doc_id, page_num, n, count(*) AS k FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY k DESC, n) = 1),
a AS (SELECT d.doc_id, d.page_num, list(array_to_string(cells, '|') ORDER BY row) AS all_rows FROM d JOIN u USING (doc_id, page_num, n)
  WHERE buckets >= 3 AND wide >= 3 AND k >= 3 GROUP BY ALL)"""


WHITESPACE_SQL = f"""
WITH {WORDS}, {_whitespace("w")}
SELECT doc_id, page_num, CAST(len(all_rows) - 1 AS BIGINT) AS n_rows, all_rows[1] AS headers, array_to_string(all_rows[2:], '/') AS cells, 'whitespace_columns' AS method FROM a
"""
RULED_SQL = f"""
WITH {WORDS}, p AS (SELECT doc_id, page_num, max(y0 + 10) AS low FROM w WHERE page_num % 2 = 0 GROUP BY ALL),
h AS (SELECT doc_id, page_num, unnest(generate_series(45, CAST(low AS BIGINT) + 30, 30)) AS y FROM p),
hb AS (SELECT *, lead(y) OVER (PARTITION BY doc_id, page_num ORDER BY y) AS far FROM h),
cells AS (SELECT doc_id, page_num, y, far, v.* FROM hb, (VALUES (0, 30, 180), (1, 180, 330), (2, 330, 480)) AS v(col, x, wide) WHERE far IS NOT NULL),
enough AS (SELECT doc_id, page_num FROM cells GROUP BY ALL HAVING count(*) >= 4),
ct AS (SELECT cells.doc_id, cells.page_num, y, col, {sql_strip("regexp_replace(coalesce(string_agg(word, ' ' ORDER BY i), ''), '" + SPACE + "+', ' ', 'g')")} AS text
  FROM cells JOIN enough USING (doc_id, page_num)
  LEFT JOIN w ON w.doc_id = cells.doc_id AND w.page_num = cells.page_num AND w.x0 + 20 >= x AND w.x0 + 20 < wide AND w.y0 + 5 >= y AND w.y0 + 5 < far GROUP BY ALL),
rt AS (SELECT doc_id, page_num, y, string_agg(text, '|' ORDER BY col) AS line FROM ct GROUP BY ALL),
t AS (SELECT doc_id, page_num, list(line ORDER BY y) AS all_rows FROM rt GROUP BY ALL),
rest AS (SELECT * FROM w ANTI JOIN t USING (doc_id, page_num)), {_whitespace("rest")}
SELECT doc_id, page_num, 'ruled_lines' AS method, CAST(greatest(len(all_rows) - 1, 1) AS BIGINT) AS n_rows, all_rows[least(2, len(all_rows))] AS first_row FROM t
UNION ALL SELECT doc_id, page_num, 'whitespace_columns', CAST(len(all_rows) - 1 AS BIGINT), all_rows[2] FROM a
"""


def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around every third column and every second row of pages whose number is even; the others have whitespace tables."""
    w = words(spark, sf_dir)
    p = w.filter("page_num % 2 = 0").groupBy("doc_id", "page_num").agg(F.max("y1").alias("low"))
    h = p.select("doc_id", "page_num", F.explode(F.sequence(F.lit(45), F.col("low").cast("int") + 30, F.lit(30))).alias("y")).select(
        "doc_id", "page_num", F.lit(30.0).alias("x1"), F.col("y").cast("double").alias("y1"), F.lit(480.0).alias("x2"),
        F.col("y").cast("double").alias("y2")
    )
    v = p.select("doc_id", "page_num", F.explode(F.array(*map(F.lit, (30.0, 180.0, 330.0, 480.0)))).alias("x"), "low").select(
        "doc_id", "page_num", F.col("x").alias("x1"), F.lit(40.0).alias("y1"), F.col("x").alias("x2"), (F.col("low") + 20).alias("y2")
    )
    t = tables.page_tables(h.unionByName(v), w)
    return t.select("doc_id", "page_num", "method", F.size("rows").cast("bigint").alias("n_rows"), F.array_join(F.element_at("rows", 1), "|").alias("first_row"))


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("word_idx")
    w = words(spark, sf_dir).select(
        "doc_id", "page_num", "word_idx", F.floor(i / 20).cast("int").alias("block_num"), (F.floor(i / 7) % 2).cast("int").alias("par_num"),
        F.col("x0").cast("int").alias("left"), F.col("y0").cast("int").alias("top"), F.lit(40).alias("width"), F.lit(10).alias("height"),
        F.when(i % 17 == 5, -1).otherwise(60 + i % 40).cast("int").alias("conf"), F.col("word").alias("text")
    )
    b = tables.ocr_blocks(w)
    return b.select("doc_id", "page_num", "block_idx", "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", F.round("confidence", 6).alias("confidence"))


OCR_SQL = f"""
WITH {WORDS}, o AS (SELECT doc_id, page_num, i, i // 20 AS block_num, (i // 7) % 2 AS par_num, x0, y0, CASE WHEN i % 17 = 5 THEN -1 ELSE 60 + i % 40 END AS conf, {sql_strip('word')} AS word FROM w),
g AS (SELECT doc_id, page_num, block_num, par_num, string_agg(word, ' ' ORDER BY i) AS text, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x0 + 40) AS DOUBLE) AS x1, CAST(max(y0 + 10) AS DOUBLE) AS y1, round(avg(conf) / 100, 6) AS confidence, min(i) AS f FROM o WHERE conf >= 0 AND word <> '' GROUP BY ALL)
SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY f) - 1 AS INTEGER) AS block_idx, text, x0, y0, x1, y1, confidence FROM g
"""


def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pixels: one image per user, grey values from the event values."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.pmod(F.floor(F.col("value") * 10).cast("bigint"), F.lit(256)).cast("int").alias("value"))
    return tables.otsu_thresholds(p)


OTSU_SQL = """
WITH p AS (SELECT user_id AS image_id, CAST(((CAST(floor(value * 10) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS v FROM events), h AS (SELECT image_id, v, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT image_id, v, CAST(sum(n) OVER u AS DOUBLE) AS wb, CAST(sum(n * v) OVER u AS DOUBLE) AS sb, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum(n * v) OVER a AS DOUBLE) AS s FROM h WINDOW u AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id)),
d AS (SELECT *, CASE WHEN w > wb THEN wb * (w - wb) * pow(sb / wb - (s - sb) / (w - wb), 2) END AS var FROM c)
SELECT image_id, CAST(coalesce(max_by(v, var * 1 - v * 0) FILTER (var > 0), 128) AS INTEGER) AS threshold FROM d GROUP BY image_id
"""

QUERIES = {
    "dominant_fonts": dominant_fonts, "column_counts": column_counts, "page_layout": page_layout, "page_margins": page_margins, "box_pairs": box_pairs, "kept_boxes": kept_boxes,
    "proximity_clusters": proximity_clusters, "block_features": block_features, "whitespace_tables": whitespace_tables, "ruled_tables": ruled_tables, "ocr_blocks": ocr_blocks, "otsu_thresholds": otsu_thresholds,
}
ORACLE_SQL = {
    "dominant_fonts": f"WITH {BLOCKS}, {FONTS} SELECT * FROM fo", "column_counts": f"WITH {BLOCKS}, {COLS} SELECT * FROM co", "page_layout": LAYOUT_SQL, "page_margins": MARGINS_SQL, "box_pairs": BOXES_SQL,
    "kept_boxes": KEPT_SQL, "proximity_clusters": CLUSTERS_SQL, "block_features": FEATURES_SQL, "ruled_tables": RULED_SQL,
    "whitespace_tables": WHITESPACE_SQL, "ocr_blocks": OCR_SQL, "otsu_thresholds": OTSU_SQL,
}
