"""Benchmark decontamination: a broadcast hash set of the test items' word windows, scanned over every document.

A window is `width` consecutive words of an item, or the whole item if it is shorter (an item without words has none).
A hash hit is verified word by word. The benchmark is broadcast in blocks of about BLOCK_BYTES of text, of which the
driver holds one at a time; more blocks are scanned one after the other, each adding to the spans found so far. Null and empty texts have no words; an empty
benchmark hits nothing; repeated items and equal item_ids count once; items without item_id are matched but not named.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, alnum_words, slices, table

#: Most text of test items in one broadcast.
BLOCK_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of word numbers."""
    key = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        key = (key ^ (ids[:, j].astype(np.uint64) + np.uint64(1))) * _MIX
        key ^= key >> np.uint64(29)
    return key


class Windows:
    """The windows of some items: by length, sorted keys, the word numbers, and which items each is from."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        codes, ends, self.words = alnum_words(pa.array([t for _, t in items], pa.string()))
        found: dict[int, dict[tuple, set]] = {}
        for i, (name, _) in enumerate(items):
            own = codes[ends[i] : ends[i + 1]].tolist()
            n = min(width, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(own[k : k + n]), set()).add(name)
        self.by_length = {}
        for n, windows in sorted(found.items()):
            ids = np.array(list(windows), np.int64)
            keys = _keys(ids)
            order = np.argsort(keys, kind="stable")
            names = [sorted(x for x in s if x is not None) for s in windows.values()]
            self.by_length[n] = (keys[order], ids[order], [names[i] for i in order])

    def find(self, codes: np.ndarray, ends: np.ndarray, words: pa.Array) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Of the words given: which are hit, and (text, item) of the items that occur."""
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = known[codes]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        run = np.concatenate(([0], np.cumsum(ids >= 0)))
        change, seen = np.zeros(len(ids) + 1, np.int64), set()
        for n, (keys, windows, names) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero((run[n:] - run[:-n] == n) & (text[n - 1 :] == text[: len(text) - n + 1]))
            found = _keys(ids[at[:, None] + np.arange(n)]) if len(at) else np.zeros(0, np.uint64)
            # Windows of one key lie next to each other; each is compared word by word.
            place = np.searchsorted(keys, found)
            size = np.searchsorted(keys, found, side="right") - place
            at, place = np.repeat(at, size), np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())
            same = (ids[at[:, None] + np.arange(n)] == windows[place]).all(axis=1)
            at, place = at[same], place[same]
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            for t, w in np.unique(np.stack([text[at], place], 1), axis=0).tolist() if len(at) else ():
                seen.update((t, name) for name in names[w])
        return np.cumsum(change[:-1]) > 0, sorted(seen)


def _blocks(benchmark: DataFrame, width: int) -> Iterator[tuple[Windows, bool]]:
    """The benchmark's windows in blocks, one at a time, and whether a block is the last."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // BLOCK_BYTES) or 1
    if n == 1:
        yield Windows([tuple(r) for r in items.collect()], width), True
        return
    parts = items.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)))
    for b in range(2 * n):
        yield Windows([(r["item_id"], r["text"]) for r in parts.where(F.col("b") == b).collect()], width), b == 2 * n - 1


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items[, text]) of every document: spans [first, end, first, end, ...] of the words that are hit."""
    spark = docs.sparkSession
    schema = "doc_id long, text string, n_words long, spans array<long>, items array<string>"
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    ws = Workspace(spark, "decontaminate")
    for block, last in _blocks(benchmark, width):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, bare: bool = last and not texts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    codes, ends, words = alnum_words(part.column("text"))
                    hit, pairs = sent.value.find(codes, ends, words)
                    old_spans, old_items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                    items = [set(x) for x in old_items]
                    for t, name in pairs:
                        items[t].add(name)
                    for t, old in enumerate(old_spans):
                        for a, b in zip(old[::2], old[1::2], strict=True):
                            hit[ends[t] + a : ends[t] + b] = True
                    # A span starts or ends where the mark changes, and at the ends of a text.
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    first, end = edge[::2], edge[1::2]
                    spans: list[list[int]] = [[] for _ in old_spans]
                    for a, b in zip(first.tolist(), end.tolist(), strict=True):
                        t = int(np.searchsorted(ends, a, side="right")) - 1
                        while a < b:
                            stop = min(b, int(ends[t + 1]))
                            if stop > a:
                                spans[t] += [a - int(ends[t]), stop - int(ends[t])]
                            a, t = max(a, stop), t + 1
                    yield pa.record_batch(
                        {
                            "doc_id": part.column("doc_id"), "text": pa.nulls(part.num_rows, pa.string()) if bare else part.column("text").cast(pa.string()),
                            "n_words": pa.array(np.diff(ends)), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        }
                    )

        found = found.mapInArrow(run, schema)
        if not last:
            found = ws.save(found, "block")
            sent.destroy()
    return found.select("doc_id", "n_words", "spans", "items", *(["text"] if texts else []))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows without a hit, whatever their doc_id; columns as they were."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminated")
    for block, last in _blocks(benchmark, width):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    codes, ends, words = alnum_words(part.column("text"))
                    hits = np.concatenate(([0], np.cumsum(sent.value.find(codes, ends, words)[0])))
                    yield part.filter(pa.array(np.diff(hits[ends]) == 0))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = ws.save(docs, "block")
            sent.destroy()
    return docs


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, text) of every document, its words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` that are hit taken out."""
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for t, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    gone = {k for a, b in zip(spans[::2], spans[1::2], strict=True) for k in range(a, b)}
                    at = itertools.count()
                    texts[t] = word.sub(lambda m, gone=gone, at=at: b"" if next(at) in gone else m[0], texts[t].encode()).decode()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return scan(docs, benchmark, width, texts=True).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


#: The same rows in SQL: windows as joined words, one length after another.
ORACLE = r"""
WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS rx),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), rx) AS w FROM benchmark, word WHERE text IS NOT NULL),
iw AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM iw),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), rx) AS w FROM documents, word),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
m AS MATERIALIZED (SELECT p.r, p.k, p.n, g.item FROM p JOIN g ON g.n = p.n AND g.s = array_to_string(p.w[p.k:p.k + p.n - 1], ' ')),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM m) GROUP BY 1),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m WHERE item IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
