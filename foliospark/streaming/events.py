"""The event stream of a run: events from result tables, the state that they add up to, live and in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T

SCHEMA = "doc_id string, seq bigint, type string, page int, idx int, total_pages int, phase string, total_blocks int, block_type string, en string, zh string, verified boolean, figure_id string, done int, total int, blocks int, error string"

#: The events that are known once pages are recognised, and those that follow from their translation. `phase` is in both.
RECOGNITION = ("start", "phase", "figure", "ocr_progress")
TRANSLATION = ("phase", "page_start", "block_done", "translate_progress", "page_done", "complete")


def from_results(rows: DataFrame) -> DataFrame:
    """Events of finished rows (doc_id, page, seq, idx, type, en, zh[, figure_id, verified]).

    First start, the phase ocr with the figures (figure) and progress (ocr_progress) of each page, then the phase translate with
    page_start, block_done, translate_progress and page_done, and complete. verified is the outcome of the checks where rows
    have it (null: not checked), else true.

    seq orders a document's events; it follows from (page, block, kind), so that a rerun gives the same numbers.
    """
    extra = {"figure_id": F.lit(None).cast("string"), "verified": F.lit(True)}
    rows = rows.withColumns({k: v for k, v in extra.items() if k not in rows.columns})
    order = Window.partitionBy("doc_id").orderBy("page", "seq")
    numbered = rows.withColumn("done", F.row_number().over(order))
    totals = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"), F.max("page").cast("int").alias("total_pages"))
    kinds = ["page", "idx", "total_pages", "phase", "total_blocks", "block_type", "en", "zh", "verified", "figure_id", "done", "total", "blocks", "error"]
    types = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}

    def event(df: DataFrame, kind: str, place: list, **values) -> DataFrame:
        filled = [(values[k] if k in values else F.lit(None)).cast(types[k]).alias(k) for k in kinds]
        return df.select("doc_id", F.lit(kind).alias("type"), F.struct(*(p.cast("int").alias(f"p{i}") for i, p in enumerate(place))).alias("_p"), *filled)

    page, at, zero, last = F.col("page"), F.col("seq"), F.lit(0), F.lit(2**31 - 1)
    pages = rows.groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("n"))
    counted = numbered.join(totals, "doc_id")
    every = [
        event(totals, "start", [F.lit(-3), zero, zero], total_pages=F.col("total_pages")),
        event(totals, "phase", [F.lit(-2), zero, zero], phase=F.lit("ocr")),
        event(rows.where("figure_id is not null"), "figure", [F.lit(-1), page, at], page=page, idx=F.col("idx"), figure_id=F.col("figure_id")),
        event(pages.join(totals, "doc_id"), "ocr_progress", [F.lit(-1), page, last], page=page, total_pages=F.col("total_pages")),
        event(totals, "phase", [zero, zero, F.lit(1)], phase=F.lit("translate"), total_blocks=F.col("total")),
        event(pages, "page_start", [page, F.lit(-1), zero], page=page),
        event(numbered, "block_done", [page, at, zero], page=page, idx=F.col("idx"), block_type=F.col("type"), en=F.col("en"), zh=F.col("zh"), verified=F.col("verified"), figure_id=F.col("figure_id")),
        event(counted, "translate_progress", [page, at, F.lit(1)], done=F.col("done"), total=F.col("total")),
        event(pages, "page_done", [page, last, zero], page=page, blocks=F.col("n")),
        event(totals, "complete", [last, last, zero]),
    ]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("_p")).cast("long")).select(*(c.split()[0] for c in SCHEMA.split(", ")))


def state(events: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """What a viewer shows of each document: the last value of each field, the finished blocks, whether it is over."""
    last = lambda field, kind: F.max_by(F.when(F.col("type") == kind, F.col(field)), F.when(F.col("type") == kind, F.col(order)))
    out = events.groupBy(doc).agg(
        last("phase", "phase").alias("phase"), last("total_pages", "start").alias("total_pages"), last("page", "page_start").alias("current_page"), last("page", "ocr_progress").alias("ocr_page"),
        last("done", "translate_progress").alias("done"), last("total", "translate_progress").alias("total"), F.count_if(F.col("type") == "block_done").alias("blocks"),
        F.count_if(F.col("type") == "page_done").alias("pages_done"), F.count_if(F.col("type") == "ocr_progress").alias("ocr_pages"),
        F.max(F.col("type").isin("complete", "error")).alias("over"),
    )
    return out.withColumn("percent", T.percent(F.coalesce("done", F.lit(0)), F.coalesce("total", F.lit(0))))


def from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON text; text that is no event is dropped."""
    return lines.select(F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where("type is not null")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as they are appended to a Parquet folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def follow(events: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds"):
    """A running query that keeps the state of documents as folders of Parquet under `path`, a folder for each batch with what it changed.

    `latest` reads them. Without `every` it takes what is there and ends. Nothing is kept on the driver.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return state(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """The last state of each document that `follow` has kept."""
    rows = spark.read.parquet(path)
    whole = F.struct(*(c for c in rows.columns if c != "batch"))
    return rows.groupBy(doc).agg(F.max_by(whole, "batch").alias("s")).select("s.*")
