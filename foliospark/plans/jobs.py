"""Jobs: what is to be run, how far it is, and its results. The facade that an application talks to."""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import report
from foliospark.plans.pipeline import Pipeline
from foliospark.sources import bundles, png
from foliospark.streaming import events

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "translating", "completed", "failed", "cancelled"


class JobError(Exception):
    """A request that the job's state doesn't allow; `status` is its HTTP counterpart."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class Job:
    task_id: str
    filename: str
    page_ocr: DataFrame
    page_count: int
    start_page: int = 0
    end_page: int | None = None
    page_images: DataFrame | None = None
    work_dir: str = ""
    status: str = PENDING
    created_at: float = field(default_factory=time.time)
    rows: DataFrame | None = None
    error: str | None = None
    worker: threading.Thread | None = None

    def told(self) -> DataFrame | None:
        """The events so far, from the table that the job appends to; None before the first."""
        spark = self.page_ocr.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.work_dir}/events")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return spark.read.schema(events.SCHEMA).parquet(f"{self.work_dir}/events")

    def view(self) -> dict:
        """The job as its users see it; progress is what its events add up to, also while it runs."""
        told = self.told()
        found = events.state(told.where("type <> 'error'")).agg(F.sum("pages_done").alias("pages"), F.sum("ocr_pages").alias("ocr_pages"), F.sum("blocks").alias("blocks"), F.max("phase").alias("phase")).first() if told is not None else None
        got = (found["pages"] or 0, found["ocr_pages"] or 0, found["blocks"] or 0, found["phase"]) if found else (0, 0, 0, None)
        return {
            "task_id": self.task_id, "filename": self.filename, "status": self.status, "page_count": self.page_count, "phase": got[3],
            "progress": {"current": got[0], "total": self.page_count}, "ocr_pages": got[1], "blocks": got[2], "error": self.error,
            "output_path": f"{self.work_dir}/result" if self.status == COMPLETED else None,
        }

    def to_json(self) -> str:
        return json.dumps(self.view(), ensure_ascii=False)


class Jobs:
    """Runs pipelines by task id; a job's Spark work carries its id as a tag, by which it can be cancelled."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline) -> None:
        self.spark, self.pipeline, self.jobs, self.lock = spark, pipeline, {}, threading.Lock()

    def create(self, filename: str, page_ocr: DataFrame, start_page: int = 0, end_page: int | None = None, page_images: DataFrame | None = None, page_count: int | None = None) -> str:
        """page_ocr (doc_id, page, ocr_text) with pages from 1; start_page and end_page bound them, counted from 0.

        page_images (doc_id, page, png): what figures are cut out of. page_count: that of the file (sources.pdf); pages beyond it are left out.
        """
        if not filename.endswith(".pdf"):
            raise JobError(400, "only .pdf files")
        if page_count is not None:
            page_ocr = page_ocr.where(F.col("page") <= page_count)
        task_id = uuid.uuid4().hex[:12]
        own = page_count if page_count is not None else page_ocr.select("page").distinct().count()
        job = Job(task_id, filename, page_ocr, own, start_page, end_page, page_images, f"{self.pipeline.work_dir}/{task_id}")
        with self.lock:
            self.jobs[job.task_id] = job
        return job.task_id

    def get(self, task_id: str) -> Job:
        if task_id not in self.jobs:
            raise JobError(404, "no such task")
        return self.jobs[task_id]

    def start(self, task_id: str, wait: bool = False) -> None:
        job = self.get(task_id)
        with self.lock:
            if job.status == RUNNING:
                raise JobError(400, "already running")
            job.status, job.error = RUNNING, None
        job.worker = threading.Thread(target=self._run, args=(job,), daemon=True)
        job.worker.start()
        if wait:
            job.worker.join()

    def _run(self, job: Job) -> None:
        self.spark.addTag(job.task_id)
        try:
            last = job.end_page if job.end_page is not None else 2**31 - 1
            pages = job.page_ocr.where((F.col("page") > job.start_page) & (F.col("page") <= last))
            own = Pipeline(self.pipeline.provider, job.work_dir, self.pipeline.options, self.pipeline.templates, self.pipeline.reference_mode)
            self._tell(job, None)
            rows = own.run(pages, lambda found: self._tell(job, events.from_results(found), events.RECOGNITION))
            rows.write.mode("overwrite").parquet(f"{own.work_dir}/result")
            job.rows = self.spark.read.schema(rows.schema).parquet(f"{own.work_dir}/result")
            self._tell(job, events.from_results(job.rows), events.TRANSLATION)
            job.status = COMPLETED if job.status == RUNNING else job.status
        except Exception as e:  # the job keeps what went wrong
            job.error = str(e).splitlines()[0] if str(e) else type(e).__name__
            job.status = FAILED if job.status == RUNNING else job.status
            if job.status == FAILED:
                self._tell(job, self._error(job))
        finally:
            self.spark.removeTag(job.task_id)

    def cancel(self, task_id: str) -> None:
        job = self.get(task_id)
        if job.status != RUNNING:
            raise JobError(400, "not running")
        job.status = CANCELLED
        self.spark.interruptTag(task_id)

    def status(self, task_id: str) -> dict:
        return self.get(task_id).view()

    def download(self, task_id: str) -> DataFrame:
        """(doc_id, markdown) of a finished job."""
        job = self.get(task_id)
        if job.status != COMPLETED:
            raise JobError(400, "not completed")
        return self.pipeline.markdown(job.rows)

    def bundle(self, task_id: str) -> DataFrame:
        """(doc_id, chunk, bytes): ZIP files of a finished job's documents, with their Markdown and, where there are page images, every figure."""
        job = self.get(task_id)
        if job.status != COMPLETED:
            raise JobError(400, "not completed")
        sums = job.rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("good"), F.count("verified").alias("checked"))
        rate = F.when(F.col("checked") > 0, F.format_string("%d/%d", "good", "checked")).otherwise("N/A")
        head = report.top(F.lit(job.filename), F.concat(F.col("n").cast("string"), F.lit(" blocks | Pass rate: "), rate))
        pieces = report.pieces(job.rows, "doc_id").unionByName(sums.select("doc_id", F.lit(0).alias("page"), F.lit(-1).alias("seq"), head.alias("piece")))
        own = self.figures(task_id) if job.page_images is not None else None
        path = f"{job.work_dir}/bundle"
        bundles.bundles(bundles.entries_of(pieces, own)).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def figures(self, task_id: str) -> DataFrame:
        """(doc_id, page, figure_id, png, error) of a finished job's figures."""
        job = self.get(task_id)
        if job.status != COMPLETED or job.page_images is None:
            raise JobError(400, "no figures")
        return png.figure_images(job.rows.where("figure_id is not null"), job.page_images)

    def events(self, task_id: str) -> DataFrame:
        """The progress events of a job so far; of a failed one the last is an error event."""
        told = self.get(task_id).told()
        return told if told is not None else self.spark.createDataFrame([], events.SCHEMA)

    def _tell(self, job: Job, found: DataFrame | None, kinds: tuple[str, ...] | None = None) -> None:
        """Appends events to the job's table; with None the table begins anew, empty."""
        mode = "append" if found is not None else "overwrite"
        found = found if found is not None else self.spark.createDataFrame([], events.SCHEMA)
        found = found.withColumn("doc_id", F.col("doc_id").cast("string"))
        phase = F.coalesce(F.col("phase") == "ocr", F.lit(False)) == F.lit(kinds == events.RECOGNITION)
        (found.where(F.col("type").isin(*kinds) & (phase | (F.col("type") != "phase"))) if kinds else found).write.mode(mode).parquet(f"{job.work_dir}/events")

    def _error(self, job: Job) -> DataFrame:
        blank = {c.split()[0]: None for c in events.SCHEMA.split(", ")}
        return self.spark.createDataFrame([blank | {"doc_id": job.task_id, "seq": 2**62, "type": "error", "error": job.error}], events.SCHEMA)
