"""Running streaming queries to the end of what is there: the shared folder, sinks that a restart does not double."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: State of transformWithState has to be kept by this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"

_fallback: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on one machine, under a folder of its own."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="foliospark-"))
        own = _fallback[0]
    return f"{own.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts a query that keeps each batch as a folder of Parquet under `path`; a batch that runs again replaces its folder.

    Without `every` it takes what is there and ends. `written` reads the result.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    # Timers of processing time would ask for one more batch for ever; a query that ends runs batches with data only.
    own = {_PROVIDER: ROCKSDB} | ({} if every else {_NO_DATA: "false"})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All batches that `write` has kept, with the columns of the stream."""
    return spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(path)


def replayed(table: DataFrame, folder: str, name: str, batches: int, *by) -> DataFrame:
    """A table as a stream: dealt by the columns `by` to one file a shuffle partition, `batches` at least, which arrive in `batches` micro-batches.

    A file is one task's work, so `by` should spread the rows.
    """
    spark, path = table.sparkSession, f"{folder}/{name}"
    table.repartition(max(batches, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by).write.parquet(path)
    files = len(spark.read.schema(table.schema).parquet(path).inputFiles())
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", str(max(1, -(-files // batches)))).parquet(path)
