"""Substring deduplication by suffix automata of reference shards.

A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id. Documents are
streamed against suffix automata for matching statistics (the longest match that ends at each word); where the length
reaches `width`, a window has occurred before. Automata of all the corpus would make the work quadratic, so references
are sharded by content and a stretch of text is sent only to the shard that can hold it:

1. Texts are written in blocks of about BLOCK_BYTES, compressed, and each block names its anchors: the 64-bit hashes of
   ANCHOR words that are the smallest among those of some window. Equal windows have equal anchors.
2. Anchors meet by hash; a block says at most once that it has one, however often, so a hot passage costs a row a block.
   Blocks hear which of their anchors another document has as well.
3. Blocks send the stretches around those anchors to the anchor's shard, each distinct stretch of a block once, with the
   smallest doc_id that has it; further documents with the same stretch in the block are covered by that one already.
4. A shard reads its stretches by ascending doc_id. Those of one document are matched against the automaton of all
   smaller doc_ids, then what is new in them is added. It answers with the windows that occurred before.
5. Blocks put the answers together and remove the words.

Anchor hashes only route text; matching compares the words themselves. There are at least as many shards as blocks, and
each step has at least as many tasks, so that a task's share does not grow with the corpus. Shards are worked off one by
one. Memory is one block or one shard's distinct repeated text. Null texts have no words. Rows that share a doc_id do not
remove each other's windows. A row without doc_id is kept whole and removes nothing. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, byte_hashes, slices, space_words, table

WIDTH, ANCHOR = 13, 6
BLOCK_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Online suffix automaton of word sequences; a state's transitions are a dictionary."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, words: list[bytes]) -> None:
        """Adds a sequence, apart from those before it."""
        self.last = 0
        for w in words:
            self._extend(w)

    def _clone(self, p: int, q: int, w: bytes) -> int:
        new = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, w: bytes) -> None:
        p = self.last
        q = self.next[p].get(w)
        if q is not None:
            self.last = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            return
        cur = len(self.length)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        self.last = cur

    def matches(self, words: list[bytes]) -> list[int]:
        """At each word, the length of the longest stretch up to it that the automaton has."""
        state, size, out = 0, 0, []
        step, link, length = self.next, self.link, self.length
        for w in words:
            to = step[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def _windows(word: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * _ODD + word[k : k + count]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Block:
    """Words of a block's documents, and which windows each anchor stands for."""

    def __init__(self, texts: pa.Array, doc_ids: np.ndarray, width: int) -> None:
        self.doc_ids, self.width = doc_ids, width
        codes, self.ends, self.words = space_words(texts, lower=False)
        self.codes = codes
        hashed = byte_hashes(self.words)[codes]
        n = len(codes) - width + 1
        doc = np.repeat(np.arange(len(doc_ids)), np.diff(self.ends))
        if n <= 0:
            self.anchor = self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        gram = _windows(hashed, ANCHOR)
        # The leftmost smallest anchor of each window.
        best, at = gram[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, width - ANCHOR + 1):
            less = gram[k : k + n] < best
            best[less], at[less] = gram[k : k + n][less], k
        place = np.arange(n) + at
        inside = doc[:n] == doc[width - 1 :]
        window = np.flatnonzero(inside)
        place, owner = place[window], doc[window]
        # Runs of windows with the same anchor place are one stretch.
        fresh = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(window) != 1) | (np.diff(owner) != 0)))) if len(window) else np.zeros(0, np.int64)
        stop = np.append(fresh[1:], len(window)) - 1 if len(fresh) else fresh
        self.hash, self.doc = gram[place[fresh]], owner[fresh]
        #: First window of each stretch, and the end of its last word.
        self.start, self.end = window[fresh], window[stop] + width

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct anchor with the smallest and the largest doc_id that has it here."""
        ids = self.doc_ids[self.doc]
        order = np.lexsort((ids, self.hash))
        h, ids = self.hash[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h)) - 1 if len(first) else first
        return h[first], ids[first], ids[last]


def _texts(texts: list[str | None]) -> bytes:
    table_ = pa.table({"t": pa.array(texts, pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table_)
    return sink.getvalue().to_pybytes()


def _back(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all()["t"].combine_chunks().cast(pa.string())


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _blocks(ws: Workspace, docs: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(block, ids, texts) of all documents, written; and how many blocks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                ids = part.column("doc_id")
                yield pa.record_batch({"block": pa.array([number]), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "texts": pa.array([_texts(part.column("text").to_pylist())], pa.binary())})
                number += 1

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = ws.save(plain.mapInArrow(run, "block long, ids array<long>, texts binary"), "blocks")
    return blocks, blocks.count()


def _block_of(ids: list, texts: bytes, width: int) -> tuple[Block, np.ndarray]:
    """The block's words; rows without doc_id have none."""
    known = np.array([i is not None for i in ids], bool)
    text = _back(texts)
    return Block(pc.if_else(pa.array(known), text, pa.scalar("")), np.array([-1 if i is None else i for i in ids], np.int64), width), known


def _by_shard(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """(shard, its rows) of rows sorted by shard, one shard at a time."""
    current, rows = None, []
    for batch in batches:
        for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", *columns)), strict=True):
            if shard != current:
                if rows:
                    yield current, rows
                current, rows = shard, []
            rows.append(tuple(row))
    if rows:
        yield current, rows


def removals(ws: Workspace, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(block, ids, texts, answers) of every block: answers are compressed runs of windows that occurred before."""
    spark = ws.spark
    blocks, n = _blocks(ws, docs, width)
    shards = max(n, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, texts in zip(*(batch.column(c) for c in ("block", "ids", "texts")), strict=True):
                own, _ = _block_of(ids.as_py(), texts.as_py(), width)
                h, low, high = own.anchors()
                shard = (h % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                parts = [p for p in np.split(order, cuts) if len(p)]
                if parts:
                    yield pa.record_batch(
                        {
                            "shard": pa.array([int(shard[p[0]]) for p in parts], pa.int64()), "block": pa.array([block.as_py()] * len(parts), pa.int64()),
                            "n": pa.array([len(p) for p in parts], pa.int64()), "data": pa.array([_pack(h[p], low[p], low[p] != high[p]) for p in parts], pa.binary()),
                        }
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tells blocks which of their anchors at least two documents have."""
        for _, rows in _by_shard(batches, "block", "n", "data"):
            raw = [zlib.decompress(data) for _, _, data in rows]
            size = [n_ for _, n_, _ in rows]
            h = np.concatenate([np.frombuffer(r, np.uint64, k) for r, k in zip(raw, size, strict=True)])
            low = np.concatenate([np.frombuffer(r, np.int64, k, 8 * k) for r, k in zip(raw, size, strict=True)])
            many = np.concatenate([np.frombuffer(r, bool, k, 16 * k) for r, k in zip(raw, size, strict=True)])
            block = np.repeat([b for b, _, _ in rows], size)
            order = np.argsort(h, kind="stable")
            block, h, low, many = block[order], h[order], low[order], many[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            twice = np.logical_or.reduceat(many, first) | (np.minimum.reduceat(low, first) != np.maximum.reduceat(low, first))
            keep = np.repeat(twice, np.diff(np.append(first, len(h))))
            block, h = block[keep], h[keep]
            order = np.argsort(block, kind="stable")
            block, h = block[order], h[order]
            own = [p for p in np.split(np.arange(len(h)), np.flatnonzero(np.diff(block)) + 1) if len(p)]
            if own:
                yield pa.record_batch({"block": pa.array([int(block[p[0]]) for p in own], pa.int64()), "anchors": pa.array([_pack(h[p]) for p in own], pa.binary())})

    def gathered(rows: DataFrame, column: str) -> DataFrame:
        """One row a block; rows of a block meet in as many tasks as there are shards."""
        return rows.repartition(shards, "block").groupBy("block").agg(F.collect_list(column).alias(column))

    named = blocks.mapInArrow(name, "shard long, block long, n long, data binary")
    heard = named.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(meet, "block long, anchors binary")
    heard = ws.save(gathered(heard, "anchors"), "anchors")

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of a block for each shard: doc_id, number of the stretch here, bytes of its text; the texts."""
        for batch in batches:
            for block, ids, texts, anchors in zip(*(batch.column(c) for c in ("block", "ids", "texts", "anchors")), strict=True):
                own, _ = _block_of(ids.as_py(), texts.as_py(), width)
                known = np.unique(np.concatenate([np.frombuffer(zlib.decompress(a), np.uint64) for a in anchors.as_py()]))
                sent = _distinct(own, known)
                if not len(sent):
                    continue
                shard = (own.hash[sent] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                sent, shard = sent[order], shard[order]
                size = own.end[sent] - own.start[sent]
                stop = np.cumsum(size)
                flat = np.repeat(own.start[sent] - (stop - size), size) + np.arange(size.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), own.words.take(pa.array(own.codes[flat])))
                joined = pc.binary_join(lists, " ").cast(pa.large_string())
                at, text = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1), joined.buffers()[2].to_pybytes()
                rows = {"shard": [], "block": [], "n": [], "data": []}
                for p in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(shard)) + 1):
                    a, b = p[0], p[-1] + 1
                    rows["shard"].append(int(shard[a]))
                    rows["block"].append(block.as_py())
                    rows["n"].append(len(p))
                    rows["data"].append(_pack(own.doc_ids[own.doc[sent[a:b]]], sent[a:b].astype(np.int64), np.diff(at[a : b + 1]), np.frombuffer(text, np.uint8, int(at[b] - at[a]), int(at[a]))))
                yield pa.record_batch({k: pa.array(v, pa.binary() if k == "data" else pa.int64()) for k, v in rows.items()})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches, "block", "n", "data"):
            found = _answer(rows, width)
            if found:
                yield pa.record_batch({"block": pa.array(list(found), pa.int64()), "answers": pa.array([_pack(np.array(runs, np.int64)) for runs in found.values()], pa.binary())})

    placed = blocks.repartition(shards, "block")
    spoken = placed.join(heard.repartition(shards, "block"), "block").mapInArrow(stretch, "shard long, block long, n long, data binary")
    answers = spoken.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(match, "block long, answers binary")
    answers = ws.save(gathered(answers, "answers"), "answers")
    both = placed.join(heard.repartition(shards, "block"), "block", "left").join(answers.repartition(shards, "block"), "block", "left")
    return both.select("block", "ids", "texts", "anchors", "answers")


def _distinct(own: Block, known: np.ndarray) -> np.ndarray:
    """Numbers of the stretches with a known anchor, each distinct text once: that of the smallest doc_id."""
    mine = np.flatnonzero(np.isin(own.hash, known))
    first: dict[bytes, int] = {}
    for i in mine[np.lexsort((mine, own.doc_ids[own.doc[mine]]))].tolist():
        first.setdefault(own.codes[own.start[i] : own.end[i]].tobytes(), i)
    return np.array(list(first.values()), np.int64)


def _answer(rows: list[tuple[int, int, bytes]], width: int) -> dict[int, list[tuple[int, int, int]]]:
    """Matches a shard's stretches by ascending doc_id; of each block (stretch, first window, end of windows) that occurred before."""
    every, found = [], {}
    for b, n, data in rows:
        raw = zlib.decompress(data)
        doc, no, size = (np.frombuffer(raw, np.int64, n, 8 * n * k).tolist() for k in range(3))
        at = 24 * n
        for d, k, s in zip(doc, no, size, strict=True):
            every.append((d, b, k, raw[at : at + s]))
            at += s
    every.sort(key=lambda x: x[0])
    automaton, seen, pending, current = Automaton(), {}, [], None
    for d, b, k, text in every:
        if d != current:
            for new in pending:
                automaton.add(new)
            pending, current = [], d
        if seen.setdefault(text, d) < d:
            found.setdefault(b, []).append((k, 0, text.count(b" ") + 2 - width))
            continue
        own = text.split(b" ")
        size = len(own)
        ends = [n >= width for n in automaton.matches(own)]
        runs = []
        for i in range(width - 1, size):
            if ends[i]:
                w = i - width + 1
                if runs and runs[-1][1] == w:
                    runs[-1][1] = w + 1
                else:
                    runs.append([w, w + 1])
        if runs:
            found.setdefault(b, []).extend((k, x, y) for x, y in runs)
        # What is new: the stretches between the matches, with the words that windows share with them.
        new_from = 0
        for x, y in [*runs, [size - width + 1, 0]]:
            if x > new_from:
                pending.append(own[new_from : x + width - 1])
            new_from = y
    return found


def _finished(ids: list, texts: bytes, anchors: list | None, answers: list | None, width: int) -> Iterator[tuple[int | None, int, np.ndarray, Block, int, int]]:
    """Of each document of a block: doc_id, its words' mask of those that go, and where they are."""
    own, known = _block_of(ids, texts, width)
    gone = np.zeros(len(own.codes) + 1, np.int64)
    if anchors:
        heard = np.unique(np.concatenate([np.frombuffer(zlib.decompress(a), np.uint64) for a in anchors]))
        sent = _distinct(own, heard)
        runs: dict[int, list] = {}
        for a in answers or ():
            for k, x, y in np.frombuffer(zlib.decompress(a), np.int64).reshape(-1, 3).tolist():
                runs.setdefault(k, []).append((x, y))
        text = {own.codes[own.start[i] : own.end[i]].tobytes(): i for i in sent.tolist()}
        for i in np.flatnonzero(np.isin(own.hash, heard)).tolist():
            k = text[own.codes[own.start[i] : own.end[i]].tobytes()]
            if own.doc_ids[own.doc[k]] < own.doc_ids[own.doc[i]]:
                gone[own.start[i]] += 1
                gone[own.end[i]] -= 1
                continue
            for x, y in runs.get(k, ()):
                gone[own.start[i] + x] += 1
                gone[own.start[i] + y - 1 + width] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    whole = None
    for t, i in enumerate(ids):
        if known[t]:
            yield i, own.words, own.codes[own.ends[t] : own.ends[t + 1]], gone[own.ends[t] : own.ends[t + 1]]
        else:
            whole = whole or _back(texts)
            codes, _, words = space_words(whole.slice(t, 1), lower=False)
            yield i, words, codes, np.zeros(len(codes), bool)


def deduplicated(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): kept holds the words left, joined by one space."""
    ws = Workspace(docs.sparkSession, "substrings")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("ids", "texts", "anchors", "answers")), strict=True):
                out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
                words = None
                for i, dictionary, codes, gone in _finished(*(x.as_py() for x in row), width):
                    if words is None or words[0] is not dictionary:
                        words = (dictionary, np.array(dictionary.cast(pa.binary()).to_pylist(), object))
                    kept = b" ".join(words[1][codes[~gone]])
                    for name, value in zip(out, (i, len(codes), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=True):
                        out[name].append(value)
                yield pa.record_batch({k: pa.array(v, pa.int64() if k in ("doc_id", "n_words", "n_removed") else pa.string()) for k, v in out.items()})

    done = removals(ws, docs, width).select("ids", "texts", "anchors", "answers").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if texts else done.drop("kept")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)


#: The same rows in SQL: all windows with the smallest doc_id that has them.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH} AND doc_id IS NOT NULL),
g AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY 1),
x AS (SELECT DISTINCT g.r, unnest(range(g.i, g.i + {WIDTH})) AS i FROM g JOIN m USING (h) WHERE m.low < g.doc_id),
gone AS (SELECT r, count(*) AS n, list(i) AS taken FROM x GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(taken, z[2])), lambda z: z[1]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
