"""File sources and sinks: PDFs as binary rows, recorded page text, page ranges, Markdown and ZIP bundles."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_DPI, MOST_DPI = 36, 300


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, filename, path, content) of the files whose name ends in .pdf, by path. task_id is from the content, so that it is the same again."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return found.select(
        F.left(F.sha2("content", 256), F.lit(12)).alias("task_id"), F.regexp_extract("path", r"[^/]+\z", 0).alias("filename"), "path", "content"
    ).orderBy("path")


def pages(tasks: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """A row for each page from 0 of tasks (task_id, page_count); start and end, if given, bound the pages."""
    last = F.col("page_count") if end is None else F.least(F.col("page_count"), F.lit(end))
    every = F.when(last > start, F.sequence(F.lit(start), last - 1)).otherwise(F.array().cast("array<int>"))
    return tasks.select("*", F.explode(every).alias("page"))


def dpi(asked: Column) -> Column:
    return F.least(F.greatest(asked, F.lit(LEAST_DPI)), F.lit(MOST_DPI))


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page text from Parquet: doc_id, page, ocr_text."""
    return spark.read.parquet(path).select("doc_id", "page", "ocr_text")


def zip_bundles(documents: DataFrame) -> DataFrame:
    """(doc_id, zip) of documents (doc_id, markdown, figures array<struct<name, png>>)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for text, figures in zip(batch["markdown"], batch["figures"], strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("translation.md", text)
                    for f in figures if figures is not None else ():
                        z.writestr(f["name"], bytes(f["png"]))
                out.append(buffer.getvalue())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "zip": out})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "markdown", "figures").mapInPandas(run, f"doc_id {kind}, zip binary")
