"""Words on scanned pages and images. Decoding and recognition need libraries; what they give is the table that ocr_blocks groups."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.shipping import ship_package
from paperloom.sources import files, pixels

WORD_FIELDS = ("block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
WORDS = "doc_id string, page_num int, word_idx int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf int, text string"
COLUMNS = [c.split()[0] for c in WORDS.split(", ")]


def page_images(content: bytes, is_pdf: bool, dpi: int) -> Iterator[np.ndarray]:
    """The pages of a file as grey arrays."""
    from PIL import Image

    if not is_pdf:
        from PIL import ImageSequence

        for frame in ImageSequence.Iterator(Image.open(io.BytesIO(content))):  # of several pages in one file, each
            yield np.asarray(frame.convert("L"))
        return
    import fitz

    with fitz.open(stream=content, filetype="pdf") as book:
        for page in book:
            drawn = page.get_pixmap(dpi=dpi, colorspace=fitz.csGRAY, alpha=False)
            yield np.frombuffer(drawn.samples, np.uint8).reshape(drawn.height, drawn.stride)[:, : drawn.width]


def tesseract(language: str, mode: int) -> Callable[[np.ndarray], dict[str, list]]:
    """A recogniser: from a grey page to lists of WORD_FIELDS."""

    def read(page: np.ndarray) -> dict[str, list]:
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_data(Image.fromarray(page), lang=language, config=f"--psm {mode}", output_type=pytesseract.Output.DICT)

    return read


Reader = Callable[[np.ndarray], dict[str, list]]


def word_rows(doc_id: str, pages: Iterator[np.ndarray], read: Reader, prepare: bool) -> tuple[list[tuple], int, str | None]:
    """Rows of WORDS, how many pages there are, and the first error, if any.

    A page that can't be read has no words, and a file that can't be decoded has no further pages.
    """
    rows: list[tuple] = []
    number, problem = 0, None
    while True:
        try:
            page = next(pages, None)
        except ImportError:
            raise
        except Exception as error:
            return rows, number, problem or str(error) or type(error).__name__
        if page is None:
            return rows, number, problem
        number += 1
        try:
            found = read(pixels.prepared(page) if prepare else page)
        except ImportError:
            raise
        except Exception as error:
            problem = problem or f"page {number}: {error}"
            continue
        for i, word in enumerate(zip(*(found[k] for k in WORD_FIELDS))):
            rows.append((doc_id, number, i, *(int(float(x)) for x in word[:-1]), str(word[-1])))


SCANNED = f"doc_id string, page_count int, words array<struct<{', '.join(c.strip().replace(' ', ':') for c in WORDS.split(', '))}>>, error string"


def scanned_files(
    scans: DataFrame,
    language: str = "eng",
    dpi: int = 300,
    mode: int = 3,
    prepare: bool | None = None,
    read: Reader | None = None,
    draw: Callable[[bytes, bool, int], Iterator[np.ndarray]] | None = None,
) -> DataFrame:
    """doc_id, page_count, words and the first error of each file that read_files lists.

    prepare: straighten, clean and binarise pages first; by default images, as photographs need it, and not drawn pages.
    read, draw: another recogniser, and another decoder of pages, in place of the usual ones.
    """
    able = files.capabilities()
    if (read is None and not able["ocr"]) or (draw is None and not able["images"]):
        raise RuntimeError("recognition needs libraries that aren't installed; tables of words can be given instead")
    ship_package(scans.sparkSession)
    recogniser, drawn = read or tesseract(language, mode), draw or page_images

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, kind, content in zip(batch["document_id"], batch["file_type"], batch["content"]):
                first = kind == "image" if prepare is None else prepare
                words, pages, error = word_rows(doc_id, iter(drawn(bytes(content), kind == "pdf", dpi)), recogniser, first)
                yield pd.DataFrame([(doc_id, pages, words, error)], columns=["doc_id", "page_count", "words", "error"])

    return scans.select("document_id", "file_type", "content").mapInPandas(run, SCANNED)


def ocr_words(scans: DataFrame, language: str = "eng", dpi: int = 300, mode: int = 3, prepare: bool = False, read: Reader | None = None, draw=None) -> DataFrame:
    """One row per word of the files that read_files lists."""
    return words_of(scanned_files(scans, language, dpi, mode, prepare, read, draw))


def words_of(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.explode("words").alias("w")).select("w.*")
