"""What the operators share: table access, durable intermediate tables, vectorised words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_fallback: list[str] = []
#: Workspaces whose tables are still there.
_live: list[Workspace] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Text bytes that one vectorised step works on; bounds the memory of a Python worker whatever the batch.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests, one machine) a folder of its own."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="foliospark-"))
    return _fallback[0]


class Workspace:
    """Intermediate tables of one operator run, written to the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _live.append(self)

    def save(self, df: DataFrame, name: str, alone: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
        """Writes a table and reads it back, in folders by the columns `by`. alone: nothing else reads the plan's shuffles, so Spark deletes their files at once."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        if alone:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        finally:
            if alone:
                self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._foliospark_path = path
        return back

    def drop(self, df: DataFrame, folder: str = "") -> None:
        """Deletes a saved table that no later step reads, or one of its folders."""
        self._delete(f"{df._foliospark_path}/{folder}".rstrip("/"))

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(keep: Workspace) -> None:
    """Deletes the intermediate tables of all operators but `keep`; only once their results have been written."""
    for ws in [w for w in _live if w is not keep]:
        ws._delete(ws.root)
        _live.remove(ws)


def numbered(ws: Workspace, rows: DataFrame, by: list[Column], within: list[str] = []) -> DataFrame:
    """Rows with `rank` (long, from 0) in the order of `by` among those of equal `within`, and `of`, their number. Nulls form a group.

    `rows` is read twice, so it should be a saved table. Rows are dealt to tasks by ranges of the whole order, equal ones
    too, so no group has to fit a task. Only a count for each task and group is summed up: one task has all counts
    of a group, at most as many as there are tasks.
    """
    order = [*(F.col(c) for c in within), *by, F.monotonically_increasing_id()]
    keys = {f"_k{i}": k for i, k in enumerate(order)}
    dealt = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    # The upper bits of this id are the task, the lower ones the place within it.
    dealt = ws.save(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    task = F.shiftright("_at", 33).alias("_task")
    counts = dealt.groupBy(*within, task).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(within)), F.col("_task").alias("_t"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("of"))
    same = F.shiftright("_at", 33) == F.col("_t")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return dealt.join(counts, same).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_t", *(f"_w{i}" for i in range(len(within))))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the strings of a column take at most `limit` bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
    # A worker that waits for its next task would keep what Arrow has freed.
    pa.default_memory_pool().release_unused()


def space_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: (code of each word, first word of each text with the end, distinct words). Null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return _coded(pc.ascii_lower(texts) if lower else texts)


def alnum_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same for words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the texts with A-Z in lower case."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return _coded(texts)
    raw = np.frombuffer(data, np.uint8)
    return _coded(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(_ALNUM[raw].tobytes()), None, 0, texts.offset))


def _alnum_table() -> np.ndarray:
    keep = np.full(256, 32, np.uint8)
    keep[48:58] = np.arange(48, 58)
    keep[65:91] = np.arange(97, 123)
    keep[97:123] = np.arange(97, 123)
    keep[128:] = np.arange(128, 256)
    return keep


_ALNUM = _alnum_table()


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    ends = ends - ends[0]
    if empty >= 0:
        keep = codes != empty
        count = np.concatenate(([0], np.cumsum(keep)))
        ends, codes = count[ends], codes[keep]
    return codes.astype(np.int64), ends, words


def hashed_words(words: pa.Array) -> np.ndarray:
    """XXH64 of each distinct word."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def byte_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, worked out over all bytes at once: a polynomial of the bytes, mixed. For features and for routing text, not for telling words apart."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    ends, data = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset), words.buffers()[2]
    size = np.diff(ends)
    if data is None or not size.sum():
        return np.zeros(len(words), np.uint64)
    place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size)
    power = np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15), np.uint64)
    power[0] = 1
    value = (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power)[place]
    some = np.flatnonzero(size)
    out = np.zeros(len(words), np.uint64)
    out[some] = np.add.reduceat(value, ends[:-1][some] - ends[0])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected `edges` (u long, v long); component: the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until only stars are left; each round is written
    to the shared folder. A hub's neighbours stay separate rows: they meet only in a partial minimum and in equi-joins
    on one row per node, which adaptive execution can split.
    """
    edges = ws.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = ws.save(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        parents = after.groupBy("u").agg(F.count("*").alias("n"))
        inner = after.select(F.col("v").alias("u")).distinct().join(parents.select("u"), "u", "left_semi")
        open_ = parents.where("n > 1").select("u").unionByName(inner).limit(1).count()
        ws.drop(edges)
        edges = after
        if not open_:
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
