"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by vantage-point shards.

Distinct fingerprints are dealt to the leaves of a vantage-point tree. The tree is built on a bounded sample; it only
decides where work is done, never what is found: at a node with vantage v and radius m, a fingerprint at distance d goes
inside if d <= m + r and outside if d > m. By the triangle inequality two fingerprints within r of each other then
share a leaf. A leaf is searched by a local tree of the same kind and, at its ends, by comparing exact distances.
Each leaf emits a spanning forest of its links, never pairs, so a group of k copies costs at most k rows a leaf.

Empty and null texts have fingerprint zero and are linked like any other. Rows with the same fingerprint are always in
one component. A null doc_id gets a fingerprint and the component of its fingerprint (null where no doc_id is known).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, connected_components, slices, table

SEED = 42
#: Fingerprints that the tree is built on (a quarter of them, this many at most, on average), the least size its leaves aim at,
#: and how many leaves it has: a leaf aims at so many times less than all fingerprints, and splits itself within its task.
SAMPLE, LEAF, LEAVES = 1 << 20, 1000, 1 << 16


def shingle_hashes(texts: list[str | None], shingle: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts, one text after the other, and how many each text has."""
    import xxhash

    one, join = xxhash.xxh64_intdigest, b" ".join
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if len(words) >= shingle:
            hashes.extend(map(one, map(join, zip(*(words[k:] for k in range(shingle)), strict=False)), repeat(SEED)))
            sizes[i] = len(words) - shingle + 1
        elif words:
            hashes.append(one(join(words), SEED))
            sizes[i] = 1
    return np.array(hashes, np.uint64), sizes


def fingerprints_of(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints: bit i is set if over half of the shingles' hash values have it."""
    return fingerprints(*shingle_hashes(texts, shingle))


def fingerprints(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    if not len(h):
        return out
    first = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    # One byte counts a bit of up to 255 shingles, eight bytes to a word of 64 bits.
    pieces = (sizes[full] + 254) // 255
    piece = np.repeat(first[full] - 255 * (np.cumsum(pieces) - pieces), pieces) + 255 * np.arange(pieces.sum())
    counts = np.empty((len(piece), 64), np.uint8)
    step = 1 << 12
    for at in range(0, len(piece), step):
        lo, hi = piece[at], piece[at + step] if at + step < len(piece) else len(h)
        bits = np.unpackbits(h[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        counts[at : at + step] = np.add.reduceat(bits, piece[at : at + step] - lo, axis=0).view(np.uint8)
    votes = np.add.reduceat(counts.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[full] = np.packbits(votes * 2 > sizes[full, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def distances(a: np.uint64, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def _cut(points: np.ndarray, vantage: np.uint64, radius: int) -> tuple[int, float]:
    """The distance that splits the points most evenly for the least overlap, and the share of the larger side with its overlap."""
    d = np.bincount(distances(vantage, points), minlength=66 + radius)
    below = np.cumsum(d)
    sides = [(max(below[m + radius], len(points) - below[m]) / len(points), m) for m in range(64) if 0 < below[m] < len(points)]
    share, m = min(sides, default=(1.0, 0))
    return m, share


def build_tree(sample: np.ndarray, leaf: int, radius: int, leaves: list[int]) -> tuple | int:
    """A node is (vantage, m, inside, outside); a leaf is its number."""
    if len(sample) > leaf:
        tries = ((*_cut(sample, v, radius), v) for v in sample[:: max(1, len(sample) // 5)][:5])
        m, share, vantage = min(tries, key=lambda x: x[1])
        if share <= 0.85:
            d = distances(vantage, sample)
            return (vantage, m, build_tree(sample[d <= m + radius], leaf, radius, leaves), build_tree(sample[d > m], leaf, radius, leaves))
    leaves.append(len(leaves))
    return leaves[-1]


def route(tree: tuple | int, points: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of the points that reach it)."""
    if not len(at):
        return
    if not isinstance(tree, tuple):
        yield tree, at
        return
    vantage, m, inside, outside = tree
    d = distances(vantage, points[at])
    yield from route(inside, points, at[d <= m + radius], radius)
    yield from route(outside, points, at[d > m], radius)


def forest(points: np.ndarray, ids: np.ndarray, radius: int, leaf: int = 4096, direct: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (smaller id, id) that join all points within the radius, given those that meet in one leaf. direct: edges from a point within the radius."""
    if len(points) > leaf:
        tree = build_tree(points[:: max(1, len(points) // 4096)], 512, radius, [])
        if isinstance(tree, tuple):
            for _, at in route(tree, points, np.arange(len(points)), radius):
                if len(at) < len(points):
                    yield from forest(points[at], ids[at], radius, max(leaf, len(at) // 2), direct)
                else:
                    yield from forest(points, ids, radius, len(points), direct)
            return
    order = np.argsort(ids)
    points, ids = points[order], ids[order]
    left, left_ids = points, ids
    while len(left):
        root, todo = left_ids[0], [(left[0], left_ids[0])]
        left, left_ids = left[1:], left_ids[1:]
        by, found = [], []
        while todo and len(left):
            point, own = todo.pop()
            near = distances(point, left) <= radius
            if near.any():
                todo.extend(zip(left[near], left_ids[near], strict=True))
                found.append(left_ids[near])
                by.append(np.full(len(found[-1]), own if direct else root))
                left, left_ids = left[~near], left_ids[~near]
        if found:
            yield np.concatenate(by), np.concatenate(found)


def fingerprint_table(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(fingerprints_of(part.column("text").to_pylist(), shingle).view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_links(ws: Workspace, fps: DataFrame, radius: int = 2, direct: bool = False) -> DataFrame:
    """Edges (u, v) between representatives that connect all of `fps` (fp long, rep long; fp distinct) within the radius; direct: each between two within it."""
    spark = ws.spark
    n = fps.count()
    share = min(0.25, SAMPLE / max(1, n))
    # By their hash, so that a retried task takes the same ones.
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))).select("fp").toPandas()
    points = np.sort(sample["fp"].to_numpy(np.int64)).view(np.uint64)
    np.random.default_rng(SEED).shuffle(points)
    leaves: list[int] = []
    tree = build_tree(points, max(16, int(max(LEAF, n / LEAVES) * share)), radius, leaves)
    sent = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy() for c in ("fp", "rep"))
            for leaf, at in route(sent.value, fp.view(np.uint64), np.arange(len(fp)), radius):
                yield pa.record_batch({"leaf": pa.array(np.full(len(at), leaf, np.int32)), "fp": pa.array(fp[at]), "rep": pa.array(rep[at])})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by leaf; one leaf is held at a time."""

        def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fp, rep = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("fp", "rep"))
            for u, v in forest(fp.view(np.uint64), rep, radius, direct=direct):
                yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

        current, held = None, []
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if leaf[a] != current and held:
                    yield from joined(held)
                    held = []
                current = leaf[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from joined(held)

    # About as many rows a task as a leaf of the least size has, times the copies that overlap makes.
    parts = max(1, min(len(leaves), max(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), n // (64 * LEAF))))
    return fps.mapInArrow(deal, "leaf int, fp long, rep long").repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.save(fingerprint_table(docs, shingle), "fingerprints")
    reps = ws.save(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    classes = connected_components(ws, near_links(ws, reps, radius))
    named = reps.join(classes, reps.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
