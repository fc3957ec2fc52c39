"""The job facade, from a PDF file to a bundle."""

import io
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators.translate import CallableProvider
from foliospark.plans.jobs import JobError, Jobs
from foliospark.plans.pipeline import Pipeline
from foliospark.sources import bundles, files, pdf, png

LONG = "This is a paragraph of some length that certainly is no heading and it goes on."


def test_jobs(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, f"<|det|>text [0,0,10,5]<|/det|>{LONG} {p}") for p in (1, 2, 3)], "doc_id string, page int, ocr_text string")
    jobs = Jobs(spark, Pipeline(CallableProvider(lambda: lambda texts: ["甲乙" for _ in texts]), str(tmp_path)))
    with pytest.raises(JobError) as e:
        jobs.create("a.PDF", pages)
    assert e.value.status == 400
    with pytest.raises(JobError) as e:
        jobs.get("none")
    assert e.value.status == 404
    task = jobs.create("a.pdf", pages, start_page=1)
    for call in (jobs.download, jobs.cancel, jobs.bundle, jobs.figures):
        with pytest.raises(JobError):
            call(task)
    assert jobs.events(task).count() == 0
    jobs.start(task, wait=True)
    view = jobs.status(task)
    assert (view["status"], view["progress"], view["error"]) == ("completed", {"current": 2, "total": 3}, None) and '"filename": "a.pdf"' in jobs.get(task).to_json()
    assert jobs.download(task).first()["markdown"].count("## Page") == 2
    assert jobs.events(task).where("type = 'block_done'").count() == 2
    want = jobs.pipeline.events(jobs.get(task).rows)
    # What was appended in two steps is what the finished rows give in one.
    assert sorted(map(str, jobs.events(task).collect())) == sorted(map(str, want.collect()))
    broken = jobs.create("b.pdf", pages.selectExpr("doc_id", "page", "raise_error('bad page') AS ocr_text"))
    jobs.start(broken, wait=True)
    assert jobs.status(broken)["status"] == "failed" and [r["type"] for r in jobs.events(broken).collect()] == ["error"]


def test_from_a_file_to_a_bundle(spark, tmp_path):
    from test_pdf import streamed

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "paper.pdf").write_bytes(streamed(2))
    task_row = pdf.with_page_count(files.pdf_files(spark, str(tmp_path / "in"))).first()
    pixels = np.random.default_rng(2).integers(0, 256, (100, 80, 3)).astype(np.uint8)
    image = png.encode(png.Image(80, 100, 8, 2, pixels))
    block = "<|det|>text [0,0,10,5]<|/det|>{}<|det|>image [0,512,512,1024]<|/det|>"
    pages = spark.createDataFrame([("d", p, block.format(f"{LONG} {p}")) for p in (1, 2, 3)], "doc_id string, page int, ocr_text string")
    images = spark.createDataFrame([("d", p, bytearray(image)) for p in (1, 2)], "doc_id string, page int, png binary")
    (tmp_path / "work").mkdir()
    gate = tmp_path / "gate"

    def load():
        import time

        def ask(texts):
            while not gate.exists():
                time.sleep(0.05)
            return ["甲乙" for _ in texts]

        return ask

    jobs = Jobs(spark, Pipeline(CallableProvider(load), str(tmp_path / "work")))
    task = jobs.create(task_row["filename"], pages, page_images=images, page_count=task_row["page_count"])
    jobs.start(task)
    waited = threading.Event()
    for _ in range(600):  # while the model is asked: pages and figures are known, blocks are not done
        view = jobs.status(task)
        if view["ocr_pages"]:
            break
        waited.wait(0.1)
    assert (view["status"], view["ocr_pages"], view["blocks"], view["progress"], view["phase"]) == ("translating", 2, 0, {"current": 0, "total": 2}, "ocr")
    gate.touch()
    jobs.get(task).worker.join(120)
    view = jobs.status(task)
    assert (view["status"], view["progress"], view["blocks"], view["phase"]) == ("completed", {"current": 2, "total": 2}, 4, "translate")
    chunks = jobs.bundle(task)
    bundles.save(chunks, "d", f"file://{tmp_path}/out.zip")
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.testzip() is None and z.namelist() == ["translation.md", "p0_f0.png", "p1_f1.png"]
        text = z.read("translation.md").decode()
        assert text.startswith("# paper.pdf\n\n> 4 blocks | Pass rate: ") and text.count("## Page") == 2 and text.count("甲乙") == 2
        assert (png.decode(z.read("p1_f1.png")).pixels == pixels[50:, :40]).all()
    assert b"".join(bundles.read(chunks, "d")) == (tmp_path / "out.zip").read_bytes() and list(bundles.read(chunks, "none")) == []


def test_bundles_in_small_chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(d, place, name, part, bytearray(rng.bytes(n))) for d in (1, 2, 3) for place, name, part, n in ((0, "a.md", 0, 10), (0, "a.md", 1, 5000), (0, "a.md", 2, 0), (1, "é.png", 0, 3000))]
    rows += [(2, 1, "none.png", 0, None), (4, 1, "none.png", 0, None)]
    entries = spark.createDataFrame(rows, "doc_id long, place int, name string, part long, content binary").orderBy(F.rand(1))
    chunks = bundles.bundles(entries, chunk=1000)
    assert sorted({r["doc_id"] for r in chunks.collect()}) == [1, 2, 3] and chunks.where("doc_id = 1").count() > 1
    for d in (1, 2, 3):
        with zipfile.ZipFile(io.BytesIO(b"".join(bundles.read(chunks, d)))) as z:
            assert z.testzip() is None
            assert {n: z.read(n) for n in z.namelist()} == {"a.md": b"".join(bytes(r[4]) for r in rows if r[0] == d and r[2] == "a.md"), "é.png": b"".join(bytes(r[4]) for r in rows if r[0] == d and r[2] == "é.png")}
