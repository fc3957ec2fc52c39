"""Document state on streams: any order of arrival, restarts, timers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import blocks, pairs
from foliospark.streaming import ordered, pages, runs

SCHEMA = "doc_id string, " + ordered.BLOCK


def made(n_docs=6, seed=1):
    rng, rows = random.Random(seed), []
    for d in range(n_docs):
        n = rng.choice([1, 2, 7, 40])
        for at in range(n):
            zh = rng.choice([f"译{at}", None, "", "[ERROR: x]"])
            rows.append((f"d{d}", at, f"text {at}", zh, rng.choice(["passed", "fast_accepted", "retried", "failed", None]), n if at == n // 2 else None))
    return rows


def tuples(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_and_a_restart(spark, tmp_path, seed):
    rows = made(seed=seed)
    whole = spark.createDataFrame(rows, SCHEMA)
    random.Random(seed).shuffle(rows)
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third] + rows[:5], rows[2 * third :]]  # some come twice
    source = f"{tmp_path}/source"
    for part in parts:  # each part is a run of its own from the same checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ordered.in_order(spark.readStream.schema(SCHEMA).parquet(source))
        runs.write(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = runs.written(spark, f"{tmp_path}/out", stream)
    assert tuples(got.where("kind = 'block'")) == tuples(ordered.in_order_batch(whole))
    ends = got.where("kind <> 'block'").select("doc_id", "kind", "at", "passed", "retried", "failed")
    count = lambda *x: F.count_if(F.col("outcome").isin(*x)).cast("int")
    assert tuples(ends) == tuples(whole.groupBy("doc_id").agg(F.lit("complete"), F.count("*").cast("int"), count(*ordered.PASSED), count("retried"), count("failed")))


def test_a_document_that_falls_silent_ends_incomplete_and_starts_anew(spark, tmp_path):
    source = f"{tmp_path}/source"

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ordered.in_order(spark.readStream.schema(SCHEMA).parquet(source), keep=1, idle=1)
        runs.write(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        time.sleep(0.1)
        return runs.written(spark, f"{tmp_path}/out", stream).select("doc_id", "kind", "at")

    feed([("a", 0, "x", "译", "passed", 3), ("a", 2, "z", "译", "passed", None), ("b", 0, "x", None, None, 1)])
    feed([("c", 0, "x", "译", "passed", 2)])
    got = feed([("a", 1, "y", "译", "passed", None)])
    # The gap in a was never filled in time; what comes after has no state to meet.
    assert tuples(got) == tuples(spark.createDataFrame([("a", "block", 0), ("b", "block", 0), ("b", "complete", 1), ("a", "incomplete", 1), ("c", "block", 0), ("c", "incomplete", 1)], "doc_id string, kind string, at int"))


def page_table(spark, seed):
    rng, rows = random.Random(seed), []
    words = ["The first", "and then", "it ends.", "Upper case", "lower case", "[non-text]", "", "goes on (see"]
    for d in range(12):
        for p in rng.sample(range(1, 9), rng.choice([2, 5, 8])):  # pages may be missing
            kinds = [rng.choice(["text", "text", "title", "image"]) for _ in range(rng.randrange(4))]
            text = "".join(f"<|det|>{k} [0, {300 * i}, 100, {300 * i + 20}]<|/det|>{rng.choice(words)}\n" for i, k in enumerate(kinds))
            rows.append((f"d{d}", p, text, 1_700_000_000 + rng.randrange(1800)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows + rows[:3], "doc_id string, page int, ocr_text string, s long").selectExpr("doc_id", "page", "ocr_text", "timestamp_seconds(s) as arrived")


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_in_any_order_give_the_rows_and_pairs_of_the_batch(spark, tmp_path, seed):
    table = page_table(spark, seed)
    rows, cleaned = pages.arriving_rows(runs.replayed(table, str(tmp_path), "rows", 3, F.hash("page")))
    runs.write(rows, f"{tmp_path}/rows-out", f"{tmp_path}/rows-check").awaitTermination()
    whole = blocks.clean_pages(table.dropDuplicates(["doc_id", "page"]))
    assert set(tuples(runs.written(spark, f"{tmp_path}/rows-out", rows))) == set(tuples(whole))
    met = pages.arriving_pairs(cleaned)
    runs.write(met, f"{tmp_path}/pairs-out", f"{tmp_path}/pairs-check").awaitTermination()
    want = tuples(pairs.cross_page_pairs(whole))
    assert tuples(runs.written(spark, f"{tmp_path}/pairs-out", met)) == want and want


def test_a_replayed_table_has_files_of_a_bounded_size(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        # One page a document, as most have: the page alone would put all rows into one file.
        stream = runs.replayed(spark.range(6000).select("id", F.lit(1).alias("page")), str(tmp_path), "t", 3, F.col("id"), F.col("page"))
        runs.write(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in got) == 6000 and max(r["count"] for r in got) < 6000 / 12
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("id").distinct().count() == 6000 and out.select("batch").distinct().count() == 3
