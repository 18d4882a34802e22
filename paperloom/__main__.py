"""Command line: python -m paperloom extract|classify|pipeline, over a table of documents or a folder of files.

A path to Parquet is read as documents (doc_id, text); any other folder is read as files. Results are written as a dataset of
(doc_id, json | csv | markdown), one row per document, or shown where no output folder is given.
"""

from __future__ import annotations

import argparse
import functools
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import classify, tables
from paperloom.plans import documents
from paperloom.shipping import written
from paperloom.sources import files, ocr

#: Rows that are shown where no output folder is given; everything is written where there is one.
SHOWN = 20


def _pdfs(found: DataFrame, **decoders) -> DataFrame:
    pages = files.pdf_pages(found, decoders.get("open_book"))
    return found.drop("content").join(files.pdf_documents(pages), "path")


def _scans(found: DataFrame, **decoders) -> DataFrame:
    scanned = written(ocr.scanned_files(found, read=decoders.get("read"), draw=decoders.get("draw")), "scanned")
    texts = documents.texts_of_blocks(tables.ocr_blocks(ocr.words_of(scanned))).select("doc_id", "text")
    about = scanned.select("doc_id", "page_count", "error").join(texts, "doc_id", "left")
    size = F.create_map(F.lit("size_mb"), F.round("size_mb", 3).cast("string")).alias("metadata")
    rows = found.drop("content").join(about, found["document_id"] == about["doc_id"])
    return rows.select("*", size)


def read_documents(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None, **decoders) -> tuple[DataFrame, DataFrame | None]:
    """Documents, and of files those that couldn't be read (path, error): PDF files by their text, images and other files by
    recognition. Where a decoder isn't installed, the files that need it are errors.

    decoders: open_book, read and draw, as in sources.files and sources.ocr.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path), None
    found = files.read_files(spark, path, recursive, pattern)
    able = files.capabilities()
    parts, errors = [], []
    for kind, decode, here in (
        (F.col("file_type") == "pdf", _pdfs, "open_book" in decoders or able["pdf"]),
        (F.col("file_type") != "pdf", _scans, {"read", "draw"} <= set(decoders) or (able["ocr"] and able["images"])),
    ):
        some = found.filter(kind)
        if not here:
            errors.append(some.select("path", F.concat("file_type", F.lit(": its decoder isn't installed")).alias("error")))
            continue
        made = written(decode(some, **decoders).select("path", "document_id", "file_type", "text", "page_count", "metadata", "error"), "decoded")
        errors.append(made.filter(F.col("error").isNotNull()).select("path", "error"))
        # a scan with a page that can't be read has the text of the others
        parts.append(made.filter(F.col("error").isNull() | (F.coalesce("page_count", F.lit(0)) > 0)))
    columns = "doc_id string, source_path string, file_type string, text string, page_count int, metadata map<string,string>"
    none = spark.createDataFrame([], columns)
    shaped = [p.select(F.col("document_id").alias("doc_id"), F.col("path").alias("source_path"), "file_type", F.coalesce("text", F.lit("")).alias("text"), "page_count", "metadata") for p in parts]
    return functools.reduce(DataFrame.unionByName, shaped, none), functools.reduce(DataFrame.unionByName, errors)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("extract", "analyze", "pipeline", "classify"):
        command = commands.add_parser(name)
        command.add_argument("path")
        command.add_argument("--config")
        command.add_argument("--out")
        command.add_argument("--recursive", action="store_true")
        command.add_argument("--pattern")
        if name != "classify":
            command.add_argument("--output", choices=list(documents.FORMATS), default="json")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    docs, errors = read_documents(spark, given.path, given.recursive, given.pattern)
    if given.command == "classify":
        rounded = F.transform_values("all_scores", lambda _, v: F.round(v, 4))
        out = classify.rule_classified(docs.select("doc_id", "text")).select("doc_id", "document_type", F.round("confidence", 4).alias("confidence"), rounded.alias("all_scores"))
    else:
        out = documents.formatted(documents.run(docs, documents.Options.load(given.config) if given.config else documents.Options()), given.output)
    if given.out:
        out.write.mode("errorifexists").parquet(given.out)
        if errors is not None:
            errors.write.mode("errorifexists").parquet(given.out.rstrip("/") + "-errors")
    else:
        out.show(SHOWN, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
