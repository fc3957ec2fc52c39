"""Paragraphs that go on over a page break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T


def goes_on(x: Column, y: Column) -> Column:
    """Whether the text y at the start of a page goes on with x at the end of the page before."""
    marked = lambda c: F.lower(c).rlike(r"\[non[- ]text\]")
    return ~T.is_blank(x) & ~T.is_blank(y) & ~marked(x) & ~marked(y) & ~T.ends_sentence(x) & ~T.starts_upper(y)


def cross_page_pairs(rows: DataFrame) -> DataFrame:
    """(doc_id, page_a, seq_a, page_b, seq_b, en_a, en_b): the last text block of a page and the first of the next, if the sentence goes on.

    One row a page carries both ends, so the neighbour is found by an equi-join on (doc_id, page); no page is skipped.
    """
    at = F.struct("seq", "en")
    ends = rows.where("type = 'text'").groupBy("doc_id", "page").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    a = ends.select("doc_id", F.col("page").alias("page_a"), (F.col("page") + 1).alias("page_b"), "last")
    b = ends.select("doc_id", F.col("page").alias("page_b"), "first")
    x, y = F.col("last.en"), F.col("first.en")
    return a.join(b, ["doc_id", "page_b"]).where(goes_on(x, y)).select(
        "doc_id", "page_a", F.col("last.seq").alias("seq_a"), "page_b", F.col("first.seq").alias("seq_b"), x.alias("en_a"), y.alias("en_b")
    )


def without_consumed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The blocks that are not the second of a pair."""
    used = pairs.select("doc_id", F.col("page_b").alias("page"), F.col("seq_b").alias("seq"))
    return rows.join(used, ["doc_id", "page", "seq"], "left_anti")


def chains(pairs: DataFrame) -> DataFrame:
    """Pairs with their chain: pairs that share a block, over as many pages as the paragraph takes. chain: its first page."""
    order = Window.partitionBy("doc_id").orderBy("page_a")
    linked = (F.lag("page_b").over(order) == F.col("page_a")) & (F.lag("seq_b").over(order) == F.col("seq_a"))
    start = F.when(F.coalesce(linked, F.lit(False)), None).otherwise(F.col("page_a"))
    return pairs.withColumn("chain", F.last(start, ignorenulls=True).over(order))


def joined(pairs: DataFrame) -> DataFrame:
    """Pairs with the text that is translated in one go."""
    return pairs.withColumn("en", F.concat(T.rstrip(F.col("en_a")), F.lit(" "), T.lstrip(F.col("en_b"))))


def merged(pairs: DataFrame, reference_mode: bool = False) -> DataFrame:
    """(doc_id, page, seq, parts, en): what is translated in one go, with its blocks (page, seq, en) in order; page and seq are the first block's.

    These are whole chains. In reference mode they are single pairs.
    """
    linked = pairs.withColumn("chain", F.col("page_a")) if reference_mode else chains(pairs)
    both = F.struct("page_a", "seq_a", "en_a", "page_b", "seq_b", "en_b")
    grouped = linked.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(both)).alias("l"))
    block = lambda x, end: F.struct(x[f"page_{end}"].alias("page"), x[f"seq_{end}"].alias("seq"), x[f"en_{end}"].alias("en"))
    parts = F.concat(F.array(block(F.col("l")[0], "a")), F.transform("l", lambda x: block(x, "b")))
    first = F.col("parts")[0]
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    en = F.aggregate(rest, first["en"], lambda acc, x: F.concat(T.rstrip(acc), F.lit(" "), T.lstrip(x["en"])))
    return grouped.select("doc_id", parts.alias("parts")).select("doc_id", first["page"].alias("page"), first["seq"].alias("seq"), "parts", en.alias("en"))
