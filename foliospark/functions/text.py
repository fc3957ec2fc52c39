"""String functions with Python's Unicode semantics, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it: Java's Unicode class lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: A sentence ends in one of . ? ! ." .)
ENDS = r"(?:\.|\?|!|\.\"|\.\))\z"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U){SPACE}+\z", "")


def lstrip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^{SPACE}+", "")


def without_space(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U){SPACE}+", "")


def words(s: Column) -> Column:
    return F.filter(F.split(s, rf"(?U){SPACE}+"), lambda w: w != "")


def ends_sentence(s: Column) -> Column:
    return rstrip(s).rlike(ENDS)


def starts_upper(s: Column) -> Column:
    return lstrip(s).rlike(r"^\p{IsUppercase}")


def starts_letter(s: Column) -> Column:
    return s.rlike(r"^\p{L}")


def is_blank(s: Column) -> Column:
    return strip(s) == ""


def characters(s: Column) -> Column:
    """The code points of a string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def ngrams(s: Column, n: int) -> Column:
    """Distinct character n-grams; none of a shorter string."""

    def cut(own: Column) -> Column:
        # The string is taken apart once; a substring at each place would count from the start every time.
        every = F.transform(F.slice(own, F.lit(1), F.size(own) - n + 1), lambda _, i: F.concat(*(F.get(own, i + k) for k in range(n))))
        return F.when(F.size(own) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bind(characters(s), cut)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over the size of the larger set; 0 if both are empty."""

    def share(sets: Column) -> Column:
        x, y = sets["a"], sets["b"]
        larger = F.greatest(F.size(x), F.size(y))
        return F.when(larger > 0, F.size(F.array_intersect(x, y)) / F.greatest(larger, F.lit(1))).otherwise(F.lit(0.0))

    return bind(F.struct(a.alias("a"), b.alias("b")), share)


def han_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"[㐀-鿿]"))


def half_up(x: Column) -> Column:
    """JavaScript's Math.round."""
    return F.floor(x + F.lit(0.5))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, 0 if there is nothing to do."""
    return F.when(total > 0, half_up(done * 100.0 / F.greatest(total, F.lit(1)))).otherwise(F.lit(0)).cast("long")


def _byte_of_character() -> dict[str, int]:
    """The byte that a character of byte-level token text stands for: printable ones themselves, the others in order from U+0100."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in itself)}


def from_byte_characters(s: Column) -> Column:
    """Text whose characters stand for bytes (tokens of a byte-level BPE) as the text that the bytes spell.

    Other characters are their own UTF-8 bytes. Bytes that are no UTF-8 become U+FFFD, one for each broken sequence.
    """
    table = _byte_of_character()
    # Each character as Latin-1 of its bytes: one replaced map lookup a character, and one decode of the whole.
    codes = F.create_map(*(x for c, b in table.items() for x in (F.lit(c), F.lit(f"{b:02X}"))))
    spelled = F.transform(characters(s), lambda c: F.coalesce(F.try_element_at(codes, c), F.hex(F.encode(c, "UTF-8"))))
    return F.when(s.isNotNull(), bind(F.unhex(F.array_join(spelled, "")), _decoded))


def _decoded(raw: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.make_valid_utf8(raw.cast("string")))
