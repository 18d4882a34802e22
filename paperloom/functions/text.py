"""Text columns: white space, words, sentences, paragraphs, readability, cleaning.

Patterns are written so that Java's engine and RE2 read them alike. White space is Unicode's, with the separators U+001C to
U+001F and U+0085. A word of letters is a maximal run of letters, digits and underscores that is all letters a-z.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import ABBREVIATIONS, ENGLISH_MARKERS, MISREAD, PLAIN_FORMS

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
INK = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
RUN = r"[\p{L}\p{N}_]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DOT = "\u0001"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(INK)


def tokens(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{INK}+")).cast("bigint")


def letter_words(text: Column, least: int = 1) -> Column:
    """Lower-case words of at least so many letters a-z, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({RUN})"), F.lit(1)), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences by closing punctuation before a capital letter or a quotation mark; abbreviations don't end them."""
    held = text
    for a in ABBREVIATIONS:
        held = F.replace(held, F.lit(f"{a}."), F.lit(f"{a}{DOT}"))
    return F.transform(_pieces(held, rf"(?<=[.!?]){SPACE}+(?=[A-Z\"'])"), lambda s: F.replace(s, F.lit(DOT), F.lit(".")))


def plain_sentences(text: Column) -> Column:
    """Sentences by closing punctuation before a capital letter, after white space is collapsed."""
    return _pieces(F.regexp_replace(text, f"{SPACE}+", " "), r"(?<=[.!?]) +(?=[A-Z])")


def loose_sentences(text: Column) -> Column:
    """Parts after every closing punctuation that white space follows."""
    return _pieces(text, rf"(?<=[.!?]){SPACE}+")


def paragraphs(text: Column) -> Column:
    return _pieces(text, rf"\n{SPACE}*\n")


def language(text: Column) -> Column:
    """en if three English function words of two letters or more occur, else unknown."""
    markers = F.array(*(F.lit(m) for m in ENGLISH_MARKERS if len(m) > 1))
    return F.when(F.size(F.array_intersect(letter_words(text, 2), markers)) >= 3, "en").otherwise("unknown")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e; at least one, none for punctuation alone."""
    w = F.regexp_replace(F.lower(word), "^[.,!?;:]+|[.,!?;:]+$", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0), F.lit(1)))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch's score from 0 to 100, to two decimals."""
    w, s = F.greatest(n_words, F.lit(1)).cast("double"), F.greatest(n_sentences, F.lit(1)).cast("double")
    return round2(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (n_syllables.cast("double") / w))))


def truncate(text: Column, most: int = 200, mark: str = "...") -> Column:
    t = tokens(text)
    return F.when(F.size(t) <= most, text).otherwise(F.concat(F.array_join(F.slice(t, 1, most), " "), F.lit(mark)))


def plain_forms(text: Column) -> Column:
    for a, b in PLAIN_FORMS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean_block(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(plain_forms(text), CONTROL, ""), r"[ \t]+", " "))


def tidy_lines(text: Column, fix_ocr: bool = True) -> Column:
    """Control characters go, two misread signs are mended, lines are trimmed, and no more than two stay empty in a row."""
    text = F.regexp_replace(text, CONTROL, "")
    if fix_ocr:
        for pattern, meant in MISREAD:
            text = F.regexp_replace(text, pattern, meant)
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]*\n[ \t]*", "\n")
    lines = F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), "\n{4,}", "\n\n\n")
    return strip(lines)


def average_token_length(text: Column) -> Column:
    t = tokens(text)
    return F.when(F.size(t) > 0, F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x)).cast("double") / F.size(t)).otherwise(F.lit(0.0))


def ink_count(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("bigint")
