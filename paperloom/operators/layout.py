"""Page layout: dominant fonts, columns, zones, block roles, reading order, margins.

blocks: doc_id, page_num, block_idx, text, bbox, font_size, block_type; pages: doc_id, page_num, width, height.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions.fixed_values import BULLET, CAPITAL_WORDS, CAPTION, FOOTER, HEADER_SIZE, HEADING_WORDS, NUMBERED, TITLE_SIZE, USUAL_SIZE
from paperloom.functions.text import is_blank, strip, token_count
from paperloom.shipping import ship_package

PAGE = ("doc_id", "page_num")



def dominant_fonts(blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, dominant_font: the size, to a tenth, with the most characters; ties go to the size seen first."""
    sized = blocks.withColumn("size", F.when(F.col("font_size") > 0, F.bround("font_size", 1)))
    sums = sized.groupBy(*PAGE, "size").agg(F.sum(F.length("text")).alias("chars"), F.min("block_idx").alias("first"))
    best = F.max_by("size", F.when(F.col("size").isNotNull(), F.struct("chars", -F.col("first"))))
    return sums.groupBy(*PAGE).agg(F.coalesce(best, F.lit(USUAL_SIZE)).alias("dominant_font"))


def column_counts(blocks: DataFrame, pages: DataFrame, gap_share: float = 0.05, most: int = 3) -> DataFrame:
    """doc_id, page_num, columns: breaks are gaps between centres above three times the mean gap and the share of the width."""
    centres = blocks.filter(F.col("bbox").isNotNull()).select(*PAGE, G.center_x(F.col("bbox")).alias("cx"))
    w = Window.partitionBy(*PAGE).orderBy("cx")
    gaps = centres.withColumn("gap", F.col("cx") - F.lag("cx").over(w)).withColumn("mean", F.avg("gap").over(Window.partitionBy(*PAGE)))
    breaks = gaps.join(pages.select(*PAGE, "width"), list(PAGE)).groupBy(*PAGE).agg(F.count_if((F.col("gap") > F.col("mean") * 3) & (F.col("gap") > F.col("width") * gap_share)).alias("k"))
    return pages.select(*PAGE).join(breaks, list(PAGE), "left").select(*PAGE, F.least(F.coalesce("k", F.lit(0)) + 1, F.lit(most)).cast("int").alias("columns"))


def zone(bbox: Column, height: Column, header_share: float = 0.1, footer_share: float = 0.1) -> Column:
    y = G.center_y(bbox)
    return F.when(bbox.isNull(), "body").when(y <= height * header_share, "header").when(y >= height * (1 - footer_share), "footer").otherwise("body")


def block_role(text: Column, font_size: Column, dominant: Column, zone_: Column | None = None, before: Column | None = None) -> Column:
    """The first rule that holds; blank blocks keep what they were."""
    t = strip(text)
    words = token_count(t)
    heading = words <= HEADING_WORDS
    zone_ = F.lit("body") if zone_ is None else zone_
    return (
        F.when(is_blank(text), F.lit("paragraph") if before is None else before)
        .when((zone_ == "footer") | t.rlike(FOOTER), "footer")
        .when(t.rlike(BULLET) | t.rlike(NUMBERED), "list_item")
        .when(t.rlike(CAPTION), "caption")
        .when((font_size >= TITLE_SIZE) & heading, F.when(font_size > dominant * 1.5, "title").otherwise("header"))
        .when((font_size >= HEADER_SIZE) & heading, "header")
        .when((zone_ == "header") & heading, "header")
        .when((words <= CAPITAL_WORDS) & (F.upper(t) == t) & (F.lower(t) != t), "header")
        .otherwise("paragraph")
    )


def analysed(
    blocks: DataFrame, pages: DataFrame, gap_share: float = 0.05, header_share: float = 0.1, footer_share: float = 0.1, most_columns: int = 3
) -> DataFrame:
    """The blocks with zone, new block_type, columns, column and reading_order (from 0).

    gap_share: of the page's width, that a gap between columns has at least; header_share and footer_share: of its height.
    """
    columns = column_counts(blocks, pages, gap_share, most_columns)
    rows = blocks.join(pages.select(*PAGE, "width", "height"), list(PAGE)).join(dominant_fonts(blocks), list(PAGE)).join(columns, list(PAGE))
    rows = rows.withColumn("zone", zone(F.col("bbox"), F.col("height"), header_share, footer_share))
    rows = rows.withColumn("block_type", block_role(F.col("text"), F.col("font_size"), F.col("dominant_font"), F.col("zone"), F.col("block_type")))
    at = F.least(F.floor(G.center_x(F.col("bbox")) / (F.col("width") / F.col("columns"))).cast("int"), F.col("columns") - 1)
    rows = rows.withColumn("column", F.when(F.col("columns") <= 1, 0).otherwise(F.coalesce(at, F.lit(0))))
    order = Window.partitionBy(*PAGE).orderBy("column", F.coalesce(F.col("bbox.y0"), F.lit(0.0)), "block_idx")
    return rows.withColumn("reading_order", F.row_number().over(order) - 1).drop("width", "height")


def margins(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_num, left, right, top, bottom as shares of the page; zeros without boxes."""
    b = blocks.filter(F.col("bbox").isNotNull()).groupBy(*PAGE).agg(G.envelope(F.col("bbox")).alias("e"))
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return pages.join(b, list(PAGE), "left").select(
        *PAGE, part(F.col("e.x0") / F.col("width")).alias("left"), part(1 - F.col("e.x1") / F.col("width")).alias("right"), part(F.col("e.y0") / F.col("height")).alias("top"), part(1 - F.col("e.y1") / F.col("height")).alias("bottom")
    )


def kept_boxes(blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, page_num, block_idx of the boxes that non-maximum suppression keeps, page by page."""
    pages = blocks.filter(F.col("bbox").isNotNull()).groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("block_idx").alias("idx"), "bbox")).alias("b"))
    return pages.select(*PAGE, F.explode(G.non_maximum_suppression(F.col("b"), threshold)).alias("k")).select(*PAGE, F.col("k.idx").alias("block_idx"))


def proximity_clusters(blocks: DataFrame, threshold: float) -> DataFrame:
    """doc_id, page_num, block_idx, cluster: greedy, in block order. A sweep adds each box near any member so far, and what it
    passed over isn't looked at again in that sweep; the order decides, so it runs page by page."""
    spark = blocks.sparkSession
    ship_package(spark)
    rows = blocks.filter(F.col("bbox").isNotNull()).select(*PAGE, "block_idx", G.center_x(F.col("bbox")).alias("x"), G.center_y(F.col("bbox")).alias("y"))

    def run(group: pa.Table) -> pa.Table:
        order = sorted(zip(*(group.column(k).to_pylist() for k in ("block_idx", "x", "y"))))
        made, left, number = {}, order, 0
        while left:
            members, passed = [left[0]], []
            for b in left[1:]:
                if any((m[1] - b[1]) ** 2 + (m[2] - b[2]) ** 2 <= threshold**2 for m in members):
                    members.append(b)
                else:
                    passed.append(b)
            for m in members:
                made[m[0]] = number
            left, number = passed, number + 1
        out = group.select([*PAGE, "block_idx"])
        return out.append_column("cluster", pa.array([made[i] for i in out.column("block_idx").to_pylist()], pa.int32()))

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (*PAGE, "block_idx"))
    return rows.groupBy(*PAGE).applyInArrow(run, types + ", cluster int")
