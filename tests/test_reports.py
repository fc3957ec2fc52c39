"""Reports, events, sources and settings."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import report
from foliospark.sources import files, settings
from foliospark.streaming import events


def test_summary(spark):
    pages = spark.createDataFrame([(3, 2, 0, 1.0, 2.0), (1, 1, 1, 0.5, 0.5)], "blocks int, verified int, retried int, ocr_time double, trans_time double")
    r = report.run_summary(pages).first()
    assert (r["pages"], r["total_blocks"], r["pass_rate"], r["total_time"]) == (2, 4, "3/4 (75%)", 4.0)
    assert report.run_summary(pages.limit(0)).first()["pass_rate"] == "0/0 (0%)"
    assert report.quality_table({"pass_rate": "1/1"}).splitlines()[-1] == "| Pass Rate | 1/1 |"


def test_census(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "y")], "d string, p int, k string")
    got = {(r["doc"], r["page"], r["type"]): (r["n"], r["total"]) for r in report.running_census(rows, "d", "p", "k").collect()}
    assert got[("a", 2, "x")] == (0, 1) and got[("a", 3, "x")] == (1, 2) and ("a", 1, "y") not in got
    assert [(r["type"], r["n"]) for r in report.most_common(rows, "k", ["d", "p"]).orderBy("rank").collect()] == [("x", 2), ("y", 2)]


def log(spark):
    e = lambda seq, kind, **v: ("d", seq, kind, *(v.get(c) for c in ("page", "total_pages", "phase", "done", "total")))
    rows = [
        e(1, "start", total_pages=2), e(2, "phase", phase="ocr"), e(3, "ocr_progress", page=1), e(4, "ocr_progress", page=2), e(5, "phase", phase="translate"), e(6, "page_start", page=1),
        e(7, "block_done", page=1), e(8, "block_done", page=1), e(9, "translate_progress", done=2, total=3), e(10, "page_done", page=1),
    ]
    return spark.createDataFrame(rows, "doc_id string, seq long, type string, page int, total_pages int, phase string, done int, total int")


def test_state(spark):
    r = events.state(log(spark)).first()
    assert (r["phase"], r["ocr_page"], r["total_pages"], r["current_page"], r["done"], r["total"], r["percent"], r["blocks"], r["over"]) == ("translate", 2, 2, 1, 2, 3, 67, 2, False)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 0, 0, "text", "a", "b"), ("d", 2, 0, 0, "text", "c", "e")], "doc_id string, page int, seq int, idx int, type string, en string, zh string")
    made = events.from_results(rows)
    assert [r["type"] for r in made.orderBy("seq").collect()] == ["start", "phase", "ocr_progress", "ocr_progress", "phase", "page_start", "block_done", "translate_progress", "page_done", "page_start", "block_done", "translate_progress", "page_done", "complete"]
    made.write.parquet(str(tmp_path / "events"))
    for expected in ((2, 2, 100, True), (1, 2, 50, False)):
        running = events.follow(events.read_stream(spark, str(tmp_path / "events")), str(tmp_path / "states"), str(tmp_path / "checkpoint"), every=None)
        assert running.awaitTermination(60)
        r = events.latest(spark, str(tmp_path / "states")).where("doc_id = 'd'" if expected[2] == 100 else "doc_id = 'e'").first()
        assert (r["done"], r["total"], r["percent"], r["over"]) == expected
        # A second document, not yet finished, arrives while the state is kept.
        half = made.where("seq <= 8").withColumn("doc_id", F.lit("e"))
        half.write.mode("append").parquet(str(tmp_path / "events"))
    real = rows.withColumns({"verified": F.col("page") == 1, "figure_id": F.when(F.col("page") == 2, "p1_f0.png")})
    made = events.from_results(real)
    assert [r["verified"] for r in made.where("type = 'block_done'").orderBy("seq").collect()] == [True, False]
    assert [(r["page"], r["figure_id"]) for r in made.where("type = 'figure'").collect()] == [(2, "p1_f0.png")]
    lines = spark.createDataFrame([('{"type": "phase", "phase": "ocr"}',), ("no json",), ("{}",)], "value string")
    assert [r["phase"] for r in events.from_json(lines).collect()] == ["ocr"]


def test_sources(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.PDF", "d.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.pdf_files(spark, str(tmp_path)).collect()
    assert [r["filename"] for r in found] == ["a.pdf", "b.pdf"] and len(found[0]["task_id"]) == 12
    tasks = spark.createDataFrame([("t", 3), ("u", 0)], "task_id string, page_count int")
    assert [(r["task_id"], r["page"]) for r in files.pages(tasks, 1).collect()] == [("t", 1), ("t", 2)]
    assert [r["x"] for r in spark.createDataFrame([(10,), (144,), (900,)], "d int").select(files.dpi(F.col("d")).alias("x")).collect()] == [36, 144, 300]
    docs = spark.createDataFrame([("d", "# t", [("p0_f0.png", bytearray(b"x"))])], "doc_id string, markdown string, figures array<struct<name:string,png:binary>>")
    with zipfile.ZipFile(io.BytesIO(bytes(files.zip_bundles(docs).first()["zip"]))) as z:
        assert sorted(z.namelist()) == ["p0_f0.png", "translation.md"]


def test_settings():
    assert settings.lookup({"a": {"b": 1}}, "a", "b") == 1 and settings.lookup({"a": 3}, "a", "b", default=7) == 7 and settings.lookup({"a": None}, "a", default=2) == 2
    with pytest.raises(ValueError):
        settings.TranslatorOptions(verify_strategy="none")
