"""Pages as they arrive, in any order: cleaned rows at once, paragraphs over a page break as soon as both pages are there.

The end of page n and the start of page n + 1 meet in a stream-stream join on (document, page); a page whose neighbour
is missing waits in the join's state, for `wait` of event time at most, so that the state does not grow for ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators import blocks, pairs


def ends(rows: Column) -> Column:
    """struct(first, last) of the text blocks of a page's rows (array of structs with type and en): seq is the place in the array. Null without any."""
    numbered = F.transform(rows, lambda r, i: F.struct(i.cast("int").alias("seq"), r["type"].alias("type"), r["en"].alias("en")))
    at = lambda own, i: F.struct(F.element_at(own, i)["seq"].alias("seq"), F.element_at(own, i)["en"].alias("en"))
    return F.get(
        F.transform(F.array(F.filter(numbered, lambda r: r["type"] == "text")), lambda own: F.when(F.size(own) > 0, F.struct(at(own, 1).alias("first"), at(own, -1).alias("last")))), 0
    )


def arriving_pairs(pages: DataFrame, wait: str = "1 hour") -> DataFrame:
    """pairs.cross_page_pairs of a stream of pages (doc_id, page, r, arrived): r are the page's rows, arrived a timestamp.

    Pages that arrive more than `wait` after the latest are dropped, as are repeats of a page within that time.
    """
    own = pages.withWatermark("arrived", wait).dropDuplicatesWithinWatermark(["doc_id", "page"])
    seen = own.select("doc_id", "page", "arrived", ends(F.col("r")).alias("e")).where("e is not null")
    a = seen.select("doc_id", F.col("page").alias("page_a"), (F.col("page") + 1).alias("page_b"), F.col("e.last").alias("x"), F.col("arrived").alias("arrived_a"))
    b = seen.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("e.first").alias("y"), F.col("arrived").alias("arrived_b"))
    near = f"arrived_b between arrived_a - interval {wait} and arrived_a + interval {wait}"
    met = a.join(b, (F.col("doc_id") == F.col("_doc")) & (F.col("page_b") == F.col("_page")) & F.expr(near))
    return met.where(pairs.goes_on(F.col("x.en"), F.col("y.en"))).select(
        "doc_id", "page_a", F.col("x.seq").alias("seq_a"), "page_b", F.col("y.seq").alias("seq_b"), F.col("x.en").alias("en_a"), F.col("y.en").alias("en_b")
    )


def arriving_rows(page_ocr: DataFrame, reference_mode: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, pages) of a stream (doc_id, page, ocr_text, arrived): the rows of clean_pages, and what arriving_pairs takes."""
    cleaned = blocks.page_rows(page_ocr, reference_mode, "arrived")
    return blocks.exploded(cleaned), cleaned
