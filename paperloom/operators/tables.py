"""Tables and text blocks from words and lines with places on a page, and Otsu's threshold.

words: doc_id, page_num, x0, y0, x1, y1, word, word_idx; drawings: doc_id, page_num, x1, y1, x2, y2;
ocr words: doc_id, page_num, word_idx, block_num, par_num, left, top, width, height, conf, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions.text import collapse, strip

PAGE = ("doc_id", "page_num")
SNAP, LEAST_LENGTH, LEAST_CELLS, ROW_STEP, LEAST_ROWS = 3.0, 10.0, 4, 5, 3


def _texts(sorted_: Column) -> Column:
    return F.transform(sorted_, lambda x: x["word"])


def ocr_blocks(words: DataFrame) -> DataFrame:
    """One paragraph block per (block_num, par_num) in the order of first words; blank and unrecognised words don't count."""
    w = words.withColumn("text", strip(F.col("text"))).filter((F.col("conf") >= 0) & (F.col("text") != ""))
    box = G.box(F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height")))
    blocks = w.groupBy(*PAGE, "block_num", "par_num").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " "
        ).alias("text"), box.alias("bbox"), (F.avg("conf") / 100.0).alias("confidence"), F.min("word_idx").alias("first"),
    )
    order = Window.partitionBy(*PAGE).orderBy("first")
    return blocks.select(*PAGE, (F.row_number().over(order) - 1).alias("block_idx"), "text", "bbox", F.lit("paragraph").alias("block_type"), "confidence")


def ruling_lines(drawings: DataFrame) -> DataFrame:
    """doc_id, page_num, direction (h or v), place: near-horizontal and near-vertical segments, snapped; each once."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    h, v = (dy < SNAP) & (dx > LEAST_LENGTH), (dx < SNAP) & (dy > LEAST_LENGTH)
    place = F.when(h, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
    return drawings.filter(h | v).select(*PAGE, F.when(h, "h").otherwise("v").alias("direction"), (F.rint(place / SNAP) * SNAP).alias("place")).distinct()


def ruled_cells(drawings: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page_num, row, col, text, bbox: a grid cell per pair of neighbouring lines; a word belongs where its centre lies."""
    lines = ruling_lines(drawings)
    w = Window.partitionBy(*PAGE, "direction").orderBy("place")
    bands = lines.select(*PAGE, "direction", F.col("place").alias("a"), F.lead("place").over(w).alias("b"), (F.row_number().over(w) - 1).alias("k")).filter(F.col("b").isNotNull())
    rows = bands.filter("direction = 'h'").select(*PAGE, F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("k").alias("row"))
    cols = bands.filter("direction = 'v'").select(*PAGE, F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("k").alias("col"))
    cells = rows.join(cols, list(PAGE)).withColumn("n", F.count("*").over(Window.partitionBy(*PAGE))).filter(F.col("n") >= LEAST_CELLS).drop("n")
    at = words.select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("wx"), ((F.col("y0") + F.col("y1")) / 2).alias("wy"), F.struct("word_idx", "word").alias("w"))
    inside = (F.col("wx") >= F.col("x0")) & (F.col("wx") < F.col("x1")) & (F.col("wy") >= F.col("y0")) & (F.col("wy") < F.col("y1"))
    c, a = cells.alias("c"), at.alias("a")
    joined = c.join(
        a, (F.col("c.doc_id") == F.col("a.doc_id")) & (F.col("c.page_num") == F.col("a.page_num")) & inside, "left"
    ).select(*(F.col(f"c.{k}") for k in (*PAGE, "row", "col", "x0", "y0", "x1", "y1")), "w")
    text = collapse(F.array_join(_texts(F.array_sort(F.collect_list("w"))), " "))
    return joined.groupBy(*PAGE, "row", "col", "x0", "y0", "x1", "y1").agg(text.alias("text")).select(*PAGE, "row", "col", "text", G.box(*(F.col(k) for k in ("x0", "y0", "x1", "y1"))).alias("bbox"))


def _as_table(rows: DataFrame, method: str) -> DataFrame:
    """From doc_id, page_num, row, cells: the first row as headers if there are others."""
    t = rows.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("all"))
    many = F.size("all") > 1
    return t.select(*PAGE, F.when(many, F.slice("all", 2, F.size("all"))).otherwise(F.col("all")).alias("rows"), F.when(many, F.element_at("all", 1)).alias("headers"), F.lit(method).alias("method"))


def ruled_tables(drawings: DataFrame, words: DataFrame) -> DataFrame:
    cells = ruled_cells(drawings, words)
    rows = cells.groupBy(*PAGE, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))
    return _as_table(rows, "ruled_lines")


def whitespace_tables(words: DataFrame) -> DataFrame:
    """Rows of words at about one height; those with the page's usual number of words (ties: the smaller), at least three, are a table."""
    rows = words.withColumn(
        "row", (F.rint(F.col("y0") / ROW_STEP) * ROW_STEP).cast("int")
    ).groupBy(*PAGE, "row").agg(_texts(F.array_sort(F.collect_list(F.struct("x0", "word_idx", "word")))).alias("cells"))
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumn("buckets", F.count("*").over(page)).filter(F.size("cells") >= 2).withColumn("n", F.size("cells")).withColumn("wide", F.count("*").over(page))
    usual = rows.groupBy(*PAGE, "n").agg(F.count("*").alias("k"))
    usual = usual.groupBy(*PAGE).agg(F.max_by("n", F.struct("k", -F.col("n"))).alias("n"), F.max("k").alias("k")).filter(F.col("k") >= LEAST_ROWS).drop("k")
    kept = rows.filter((F.col("buckets") >= LEAST_ROWS) & (F.col("wide") >= LEAST_ROWS)).join(usual, [*PAGE, "n"])
    return _as_table(kept, "whitespace_columns")


def page_tables(drawings: DataFrame, words: DataFrame) -> DataFrame:
    """Ruled tables, and for pages without one whitespace tables."""
    ruled = ruled_tables(drawings, words)
    return ruled.unionByName(whitespace_tables(words.join(ruled.select(*PAGE).distinct(), list(PAGE), "left_anti")))


def otsu_thresholds(pixels: DataFrame, image: str = "image_id", value: str = "value") -> DataFrame:
    """image, threshold: the grey value below which (inclusive) the between-class variance is largest; 128 for one-coloured images."""
    hist = pixels.groupBy(F.col(image).alias("image"), F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    upto, all_ = Window.partitionBy("image").orderBy("v"), Window.partitionBy("image")
    h = hist.select(
        "image", "v", F.sum("n").over(upto).alias("wb"), F.sum(F.col("n") * F.col("v")).over(upto).alias("sb"),
        F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("v")).over(all_).alias("s")
    )
    wf = F.col("w") - F.col("wb")
    var = F.when(wf > 0, F.col("wb").cast("double") * wf * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf, F.lit(2.0)))
    best = h.withColumn("var", var).groupBy("image").agg(F.max_by("v", F.when(F.col("var") > 0, F.struct("var", -F.col("v")))).alias("t"))
    return best.select(F.col("image").alias(image), F.coalesce("t", F.lit(128)).alias("threshold"))
