"""The driver tables in the shapes that the operators take.

There is no recognised page text among the driver tables, so shapes are bound by position: a document's lines are
blocks, fixed-width slices of its text are pages, consecutive turns of a conversation are a text and its
back-translation. These bindings exercise the operators, not their domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("text", "title", "text", "equation", "text", "page_number", "image", "text", "sidebar_x", "text", "image_caption")
SLICE, PER_PAGE = 300, 4
#: Letters and what stands for them in a made-up Chinese text.
LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 37 * i) for i in range(26))
REPEATED = "这段话重复了三次哦"
#: What is put behind a turn, so that it has spans that a translation must keep.
SPANS = " See GPU-4 and 42%."


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, line) of the documents."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))


def line_kind() -> F.Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col("doc_id") + F.col("seq"), F.lit(len(TYPES))) + 1).cast("int"))


def page_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, ocr_text): PER_PAGE lines a page, each a marked-up block."""
    seq = F.col("seq")
    block = F.format_string("<|det|>%s [%d, %d,%d, %d]<|/det|>%s\n", line_kind(), seq * 37 % 500, seq % PER_PAGE * 50, seq * 37 % 500 + 300, seq % PER_PAGE * 50 + 20, F.col("line"))
    every = lines(spark, sf_dir).select("doc_id", (F.floor(seq / PER_PAGE) + 1).cast("int").alias("page"), "seq", block.alias("b"))
    found = every.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("m"))
    return found.select("doc_id", "page", F.concat(F.lit("noise "), F.array_join("m.b", "")).alias("ocr_text"))


def text_slices(spark: SparkSession, sf_dir: str, width: int = SLICE) -> DataFrame:
    """(doc_id, seq, text): the text cut every `width` characters; nothing is trimmed."""
    n = F.ceil(F.length("text") / width).cast("int")
    docs = read(spark, sf_dir, "documents").where("length(text) > 0")
    return docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * width + 1, F.lit(width)))).alias("seq", "text"))


def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices as text blocks, two a page: (doc_id, page, seq, type, en)."""
    return text_slices(spark, sf_dir).select("doc_id", (F.floor(F.col("seq") / 2) + 1).cast("int").alias("page"), "seq", F.lit("text").alias("type"), F.col("text").alias("en"))


def turn_pairs(spark: SparkSession, sf_dir: str, following: int = 1) -> DataFrame:
    """Turns with the texts of the turns after them: t0, t1, ..."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations")
    found = turns.select("conv_id", "turn", "role", F.col("text").alias("t0"), *(F.lead("text", k).over(order).alias(f"t{k}") for k in range(1, following + 1)))
    # What follows costs far more than the few bytes of a turn suggest, so turns are spread over all tasks again.
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "conv_id", "turn")


def translated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that end in spans to be kept, with made-up translations zh: Han characters for letters, six of eight with a fault."""
    turns = read(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.lit(SPANS)))
    z, k = F.translate("text", LETTERS, HAN), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    faults = {2: F.translate(z, "0123456789", ""), 3: F.concat(z, F.lit(REPEATED * 3)), 4: F.concat(F.lit("Translation: "), z), 5: F.left(z, F.lit(10)), 6: F.col("text"), 7: F.lit(" ")}
    zh = z
    for i, fault in faults.items():
        zh = F.when(k == i, fault).otherwise(zh)
    return turns.withColumn("zh", zh)
