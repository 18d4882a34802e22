"""Files as rows: kinds by signature or suffix, listings, names and sizes; decoders where their libraries are installed."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import MAGIC_BYTES, SUFFIXES
from paperloom.shipping import ship_package

MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "gif": "image/gif", "webp": "image/webp",
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "text/xml", "md": "text/markdown", "zip": "application/zip", "doc": "application/msword",
}
OTHER_MIME = "application/octet-stream"
LARGEST_UPLOAD, LONGEST_ID = 50 << 20, 128


def suffix(path: Column) -> Column:
    """Lower-case letters and digits after the last dot of the file's name, or nothing."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def file_type(path: Column, content: Column | None = None) -> Column:
    """pdf, image or scan: by the first bytes, else by the suffix."""
    by_name = F.coalesce(_lookup(suffix(path), SUFFIXES), F.lit("scan"))
    if content is None:
        return by_name
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for mark, kind in MAGIC_BYTES:
        hit = head.startswith(mark.hex().upper())
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(by_name)


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(suffix(path), MIME), F.lit(OTHER_MIME))


def is_supported(path: Column, content: Column | None = None) -> Column:
    return file_type(path, content).isin("pdf", "image")


def document_id(path: Column) -> Column:
    """Twelve hexadecimal digits of the path's SHA-1."""
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def random_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def size_mb(length: Column) -> Column:
    return length / F.lit(1048576.0)


def clean_name(name: Column, mark: str = "_") -> Column:
    """A file name of letters, digits, dots, hyphens and the mark, which doesn't stand at its ends."""
    plain = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s.-]", mark), r"(?U)\s+", mark)
    return F.btrim(plain, F.lit(mark))


def valid_upload(doc_id: Column, length: Column) -> Column:
    return (F.length(doc_id) <= LONGEST_ID) & doc_id.rlike(r"^[A-Za-z0-9_.-]+$") & (length <= LARGEST_UPLOAD)


def read_files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """path, name, file_type, mime_type, document_id, size_mb, length, modificationTime and content of a folder's documents.

    Content is read only where a query uses it or where the type needs its first bytes. Files without any bytes aren't listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder)
    wanted = [s.lower().lstrip(".") for s in suffixes] if suffixes else None if pattern else list(SUFFIXES)
    if wanted:
        files = files.filter(suffix(F.col("path")).isin(wanted))
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), file_type(F.col("path"), F.col("content")).alias("file_type"), mime_type(F.col("path")).alias("mime_type"),
        document_id(F.col("path")).alias("document_id"), size_mb(F.col("length")).alias("size_mb"), "length", "modificationTime", "content",
    )


def capabilities() -> dict[str, bool]:
    """Which decoders and readers this installation has."""
    has = lambda name: importlib.util.find_spec(name) is not None
    return {
        "pdf": has("fitz"), "images": has("PIL"), "ocr": has("pytesseract"), "opencv": has("cv2"), "yaml": has("yaml"), "entities": True,
        "classification": True, "summaries": True, "storage": True
    }


#: What a PDF file says about itself: our names and its.
PDF_METADATA = {
    "title": "title",
    "author": "author",
    "subject": "subject",
    "keywords": "keywords",
    "creator": "creator",
    "producer": "producer",
    "creation_date": "creationDate",
    "modification_date": "modDate",
}
BLOCK = "struct<block_idx:int,text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,font_name:string>"
IMAGE = "struct<x0:double,y0:double,x1:double,y1:double>"
PDF_PAGES = (
    "path string, page_num int, width double, height double, page_count int, metadata map<string,string>, "
    f"blocks array<{BLOCK}>, images array<{IMAGE}>, error string"
)
_PAGE_COLUMNS = ("path", "page_num", "width", "height", "page_count", "metadata", "blocks", "images", "error")
EXTRACTED = (
    "path string, page_num int, width double, height double, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, "
    "font_size double, font_name string, error string"
)


def _metadata(book) -> dict[str, str]:
    known = book.metadata or {}
    made = {name: str(known.get(key) or "") for name, key in PDF_METADATA.items()}
    return made | {"page_count": str(book.page_count), "is_encrypted": "true" if book.is_encrypted else ""}


def _text_block(block: dict, k: int) -> tuple | None:
    """Its lines, and size and font of its longest span; None if it has no text."""
    lines = ["".join(s["text"] for s in line["spans"]) for line in block["lines"]]
    text = "\n".join(lines).strip()
    if not text:
        return None
    main = max((s for line in block["lines"] for s in line["spans"]), key=lambda s: len(s["text"]))
    return (k, text, *map(float, block["bbox"]), float(main["size"]), main["font"])


def book_rows(path: str, book) -> list[tuple]:
    """One row of PDF_PAGES per page, those without any text too; a book without pages is one row without a number."""
    about, rows = _metadata(book), []
    for number, page in enumerate(book, 1):
        blocks, images = [], []
        for block in page.get_text("dict")["blocks"]:
            if block.get("type") == 0:
                made = _text_block(block, len(blocks))
                blocks += [made] if made else []
            elif block.get("type") == 1:
                images.append(tuple(map(float, block["bbox"])))
        rows.append((path, number, float(page.rect.width), float(page.rect.height), book.page_count, about, blocks, images, None))
    return rows or [(path, None, None, None, 0, about, [], [], None)]


def _open_pdf(content: bytes):
    import fitz

    return fitz.open(stream=content, filetype="pdf")


def pdf_pages(files: DataFrame, open_book: Callable[[bytes], object] | None = None) -> DataFrame:
    """PDF_PAGES of the PDF files that read_files lists; a file that can't be read is a row with its error.

    open_book: another decoder in place of the usual one, whose books have metadata, page_count, is_encrypted and pages.
    """
    if open_book is None and not capabilities()["pdf"]:
        raise RuntimeError("PDF decoding needs a library that isn't installed; tables of blocks can be given instead")
    ship_package(files.sparkSession)
    opened = open_book or _open_pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with opened(bytes(content)) as book:
                        rows = book_rows(path, book)
                except Exception as error:  # one bad file doesn't end the job
                    rows = [(path, None, None, None, None, None, None, None, str(error) or type(error).__name__)]
                yield pd.DataFrame(rows, columns=list(_PAGE_COLUMNS)).astype({"page_num": "Int32", "page_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, PDF_PAGES)


def pdf_blocks(files: DataFrame, open_book: Callable[[bytes], object] | None = None) -> DataFrame:
    """One row per text block of PDF files; a file that can't be read is a row with its error."""
    pages = pdf_pages(files, open_book).filter(F.col("error").isNotNull() | (F.size("blocks") > 0))
    rows = pages.select("path", "page_num", "width", "height", F.explode_outer("blocks").alias("b"), "error")
    return rows.select("path", "page_num", "width", "height", "b.*", "error")


def pdf_documents(pages: DataFrame) -> DataFrame:
    """path, text, page_count, metadata and error, one row per file of PDF_PAGES; pages without text count, and part the text too."""
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    in_order = F.array_sort(F.collect_list(F.struct("page_num", text.alias("t"))))
    return pages.groupBy("path").agg(
        F.array_join(F.transform(in_order, lambda p: p["t"]), "\n\n").alias("text"),
        F.max("page_count").alias("page_count"),
        F.first("metadata", ignorenulls=True).alias("metadata"),
        F.max("error").alias("error"),
    )
