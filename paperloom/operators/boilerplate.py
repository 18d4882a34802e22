"""Lines that repeat at the top or the bottom of pages, and text cleaning that needs Unicode decomposition."""

from __future__ import annotations

import unicodedata
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.text import plain_forms, strip, tidy_lines
from paperloom.shipping import ship_package

EDGE_LINES = 2


def lines_of(text: Column) -> Column:
    """Lines as splitlines gives them for line feeds and carriage returns; a final line end makes no line."""
    t = F.regexp_replace(text, "\r\n|\r", "\n")
    parts = F.split(t, "\n")
    return F.when(t == "", F.slice(parts, 1, 0)).when(t.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def repeated_lines(pages: DataFrame, least: int = 3, doc_id: str = "doc_id", page_num: str = "page_num", text: str = "text") -> DataFrame:
    """doc_id, line: lines that the first two lines of pages hold at least so many times, or the last two."""
    rows = pages.select(F.col(doc_id).alias("doc_id"), lines_of(F.col(text)).alias("l"))
    top, bottom = F.slice("l", 1, EDGE_LINES), F.reverse(F.slice(F.reverse("l"), 1, EDGE_LINES))
    edges = rows.select(
        "doc_id",
        F.explode(F.concat(
            F.transform(top, lambda x: F.struct(F.lit("top").alias("edge"), strip(x).alias("line"))),
            F.transform(bottom, lambda x: F.struct(F.lit("bottom").alias("edge"), strip(x).alias("line")))
        )).alias("e")
    )
    counts = edges.filter(F.col("e.line") != "").groupBy("doc_id", "e.edge", "e.line").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least).select("doc_id", "line").distinct()


def without_repeated_lines(pages: DataFrame, least: int = 3, doc_id: str = "doc_id", page_num: str = "page_num", text: str = "text") -> DataFrame:
    """doc_id, page_num, text: documents with fewer pages than that stay as they are."""
    counted = pages.select(F.col(doc_id).alias("doc_id"), F.col(page_num).alias("page_num"), F.col(text).alias("text"))
    sizes = counted.groupBy("doc_id").agg(F.count("*").alias("n"))
    drop = repeated_lines(pages, least, doc_id, page_num, text).groupBy("doc_id").agg(F.collect_set("line").alias("drop"))
    rows = counted.join(sizes, "doc_id").join(drop, "doc_id", "left")
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda x: ~F.array_contains(F.col("drop"), strip(x))), "\n")
    whole = F.array_join(lines_of(F.col("text")), "\n")
    return rows.select("doc_id", "page_num", F.when(F.col("n") < least, F.col("text")).when(F.col("drop").isNull(), whole).otherwise(kept).alias("text"))


def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


def cleaned(text: Column, fix_ocr: bool = True, to_ascii: bool = True) -> Column:
    """Plain forms, ASCII by decomposition, control characters, misread signs, lines and empty lines; empty stays empty."""
    ship_package(SparkSession.active())
    plain = plain_forms(text)
    return tidy_lines(F.pandas_udf(_ascii, StringType())(plain) if to_ascii else plain, fix_ocr)
