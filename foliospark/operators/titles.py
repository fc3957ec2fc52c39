"""Which texts are headings, and which way a text takes through translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T

# Heading words, lengths.
HEADING_WORDS = (
    "abstract", "introduction", "conclusion", "references",
    "acknowledgments", "acknowledgements", "contents", "summary",
    "appendix", "related works", "background", "methodology",
    "discussion", "future work", "limitations", "preface", "foreword",
)
SHORT_HEADING, LONG_HEADING, HEADING_WORD_COUNT = 40, 100, 8
#: What \s is in SQL.
ASCII_SPACE = r"[\t\n\f\r ]"
SHORT_TEXT, CHUNK_SIZE, UNVERIFIED = 200, 500, 40


def is_pseudo_title(text: Column, short: int = SHORT_HEADING, long: int = LONG_HEADING, ascii_only: bool = False) -> Column:
    r"""ascii_only: \d, \s and \w are those of SQL's regular expressions, ASCII without \v, and of what is around the text its trim drops space separators (\p{Zs}) only."""
    flag, space = ("", ASCII_SPACE) if ascii_only else ("(?U)", T.SPACE)
    own = F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "") if ascii_only else T.strip(text)
    size, parts = F.length(own), F.filter(F.split(own, rf"{flag}{space}+"), lambda w: w != "")
    lettered = F.filter(parts, T.starts_letter)
    capitals = (F.size(lettered) > 0) & F.forall(lettered, lambda w: w.rlike(r"^\p{IsUppercase}"))
    ends = F.regexp_replace(own, rf"{ASCII_SPACE}+\z", "").rlike(T.ENDS) if ascii_only else T.ends_sentence(own)
    # SQL lowers each character to one.
    low = F.lower(F.translate(own, "İ", "i") if ascii_only else own)
    return (
        (size < short)
        | F.regexp_replace(low, r"\.+\z", "").isin(*HEADING_WORDS)
        | (own.rlike(rf"{flag}^\d+(\.\d+)*\.?{space}+\w") & (size < long))
        | ((size < long) & (F.size(parts) <= HEADING_WORD_COUNT) & capitals & ~ends)
    )


def is_skipped(kind: Column, text: Column, ascii_only: bool = False) -> Column:
    """Titles, and text blocks that look like titles, are not translated."""
    return (kind == "title") | ((kind == "text") & is_pseudo_title(text, ascii_only=ascii_only))


def route(text: Column, short: int = SHORT_TEXT, chunk_size: int = CHUNK_SIZE) -> Column:
    size = F.length(text)
    return F.when(size < short, "short").when(size > chunk_size, "long").otherwise("normal")


def needs_no_check(text: Column, verify: bool = True) -> Column:
    return (F.length(text) <= UNVERIFIED) | F.lit(not verify)
