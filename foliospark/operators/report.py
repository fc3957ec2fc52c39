"""Counts, summaries and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.translate import ERROR


def census(rows: DataFrame, doc: str, kind: str) -> DataFrame:
    """(doc, type, n): counts by document and type, by document, by type, and of all, in one pass; null where summed over."""
    own = rows.select(F.col(doc).cast("string").alias("doc"), F.col(kind).alias("type"))
    d, t = F.col("doc"), F.col("type")
    return own.groupingSets([[d, t], [d], [t], []], d, t).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("doc", "type", "n", "level")


def most_common(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """(type, n, rank): types by count, equal ones in the order they first appear."""
    counted = rows.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return counted.select("type", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long").alias("rank"))


def running_census(rows: DataFrame, doc: str, page: str, kind: str) -> DataFrame:
    """(doc, page, type, n, total): counts of each page and up to it, also for pages that lack a type the document has had."""
    per_page = rows.groupBy(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(kind).alias("type")).agg(F.count("*").alias("n"))
    pages, kinds = per_page.select("doc", "page").distinct(), per_page.select("doc", "type").distinct()
    full = pages.join(kinds, "doc").join(per_page, ["doc", "page", "type"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("doc", "type").orderBy("page"))
    full = full.select("doc", "page", "type", F.coalesce("n", F.lit(0)).alias("n"), total.alias("total"))
    return full.where("total > 0")


def pass_rate(verified: Column, blocks: Column) -> Column:
    share = F.bround(verified * 100.0 / F.greatest(blocks, F.lit(1)), 0).cast("long")
    return F.concat(verified.cast("string"), F.lit("/"), blocks.cast("string"), F.lit(" ("), share.cast("string"), F.lit("%)"))


def run_summary(pages: DataFrame) -> DataFrame:
    """One row over pages (blocks, verified, retried, ocr_time, trans_time)."""
    total = pages.agg(
        F.count("*").alias("pages"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("blocks", "total_blocks"), ("verified", "verified"), ("retried", "retried"))),
        *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("ocr_time", "trans_time")),
    )
    return total.withColumns({"pass_rate": pass_rate(F.col("verified"), F.col("total_blocks")), "total_time": F.col("ocr_time") + F.col("trans_time")})


def verifier_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counters of verify.outcome, a unit a row (column `o`)."""
    o = F.col("o")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(o["outcome"].isin("passed", "fast_accepted")).alias("passed"), F.count_if(o["outcome"] == "retried").alias("retried"),
        F.count_if(o["outcome"] == "failed").alias("failed"), *(F.count_if(o[c]).alias(c) for c in ("fast_accepted", "fast_audited", "fast_rejected")),
        F.sum(o["back_verified"]).cast("long").alias("back_verified"),
    )


def block_markdown(kind: Column, en: Column, zh: Column) -> Column:
    shown = F.when(zh.startswith(ERROR), F.concat(F.lit("*"), zh, F.lit("*"))).otherwise(zh)
    return F.concat(F.lit("**["), kind, F.lit("]**\n\n> "), en, F.lit("\n\n"), shown, F.lit("\n\n---\n\n"))


def pieces(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, page, seq, piece) of rows (doc, page, seq, type, en, zh): the Markdown of each block, with a heading wherever the page changes."""
    order = Window.partitionBy(doc).orderBy("page", "seq")
    turns = F.coalesce(F.lag("page").over(order) != F.col("page"), F.lit(True))
    head = F.when(turns, F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.select(doc, "page", "seq", F.concat(head, block_markdown(F.col("type"), F.col("en"), F.coalesce("zh", F.lit("")))).alias("piece"))


def top(title: Column, summary: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n> "), summary, F.lit("\n\n"))


def markdown(rows: DataFrame, doc: str, title: Column, summary: Column) -> DataFrame:
    """(doc, markdown): a document's pieces under its title."""
    body = pieces(rows, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "seq", "piece"))).alias("m"))
    return body.select(doc, F.concat(top(title, summary), F.array_join(F.transform("m", lambda x: x["piece"]), "")).alias("markdown"))


def quality_table(values: dict[str, str]) -> str:
    """The report's table, keys in title case."""
    lines = ["| Metric | Value |", "|---|---|", *(f"| {k.replace('_', ' ').title()} | {v} |" for k, v in values.items())]
    return "\n".join(lines) + "\n"
