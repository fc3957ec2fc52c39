"""Near-duplicate documents by the Jaccard similarity of their word shingles: candidates by SimHash, then by MinHash, each verified.

1. Fingerprints of the same shingles as operator 1 makes them, dealt to its vantage-point shards: texts with one fingerprint
   are paired with the smallest, and fingerprints within RADIUS bits by a spanning forest of such pairs. Verified (4.),
   these join most close copies. Texts of similarity 0.8 differ by 10 bits of 64 on average, a radius that leaves a tree
   nothing to prune; what lies beyond RADIUS is found by the next two steps, which look at texts of different components only.
2. Signatures: BANDS values a text, each over ROWS minima of the shingles' hash values. Two texts of similarity s agree in
   a band with chance s^ROWS, so 6 of 100,000 pairs at 0.8 agree in none and are missed, of closer pairs fewer.
3. Candidates: texts that agree in a band. Each is first paired with the hub of its band, the text that agrees with the
   most others over all bands, so a group of copies is joined by its centre in as many pairs as it has texts.
   What is left are bands whose texts are still in different components. Their texts are joined by prefixes: shingles
   are ordered from the rarest among them, and two sets of the similarity share one among the first ninth of the smaller
   and the first fifth of the larger set. Parts that a group of copies has in common are frequent and come last, so
   texts below the similarity seldom meet, while no pair above it is missed; pairs within a component are not made.
4. A candidate is a link only if the shingle sets have a similarity of at least 0.8, counted on 64-bit hash values.
5. Of each component the row with the smallest doc_id is kept (a null comes last), and one row only.

A text is known by its 64-bit hash; equal texts are one node. Texts without words are alike. Fewer words than a shingle
has make one shingle of them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import simhash
from foliospark.llm.common import Workspace, connected_components, slices

SEED = 42
BANDS, ROWS = 32, 6
#: Bits that fingerprints of a candidate differ by at most.
RADIUS = 2
#: Least similarity as a fraction.
NUM, DEN = 4, 5
#: Text bytes whose shingles a worker holds at once.
HELD = 1 << 18
#: Pairs of a hub that share one copy of its set.
SPREAD = 256

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles_of(text: str | None, shingle: int = 5) -> set[int]:
    """XXH64 of the distinct shingles of the lower-case words."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if len(words) < shingle:
        return {xxhash.xxh64_intdigest(b" ".join(words), SEED)} if words else set()
    return {xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)}


def signatures_of(texts: list[str | None], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, bands) of each text."""
    h, sizes = simhash.shingle_hashes(texts, shingle)
    out = np.zeros((len(texts), BANDS), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        mixed = np.empty_like(h)
        for b in range(BANDS):
            band = np.full(len(full), b + 1, np.uint64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                np.bitwise_xor(h, _XOR[k], out=mixed)
                np.multiply(mixed, _ODD[k], out=mixed)
                band = (band ^ np.minimum.reduceat(mixed, first)) * np.uint64(0x9E3779B97F4A7C15)
                band ^= band >> np.uint64(29)
            out[full, b] = band
    return simhash.fingerprints(h, sizes).view(np.int64), out.view(np.int64)


def _node() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _row(node: Column) -> Column:
    """A row by its text and doc_id; rows that agree in both have the same."""
    return F.xxhash64(node, F.col("doc_id").cast("long"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity. u may be a hub: its set is repeated, so that its pairs are spread over tasks."""
    a = sets.select(F.col("node").alias("u"), F.col("own").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    copies = pairs.groupBy("u").agg(F.ceil(F.count("*") / SPREAD).cast("long").alias("k"))
    hubs = a.join(copies, "u").select("u", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"))
    salted = pairs.join(copies, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("k")).alias("salt"))
    both = F.size(F.array_intersect("a", "b"))
    return salted.join(b, "v").join(hubs, ["u", "salt"]).where((NUM + DEN) * both >= NUM * (F.size("a") + F.size("b"))).select("u", "v")


def _prefix_pairs(ws: Workspace, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of the open nodes (node, c) of different components that share a shingle of their prefixes."""
    words = open_.join(sets, "node").select("node", "c", F.size("own").alias("n"), F.explode("own").alias("s"))
    often = words.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    # A shingle of one node joins nothing, but it has its place in the order.
    ranked = words.join(often, "s", "left").select("node", "c", "n", F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s").alias("x"))
    ranked = ranked.groupBy("node", "c", "n").agg(F.array_sort(F.collect_list("x")).alias("x"))
    # A pair of the similarity shares t * larger and 2t / (1 + t) * smaller shingles at least, with t = NUM / DEN.
    ahead = lambda num, den: F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}") + 1
    index, probe = ahead(2 * NUM, NUM + DEN).cast("int"), ahead(NUM, DEN).cast("int")
    cut = ranked.select("node", "c", "n", index.alias("index"), F.posexplode(F.slice("x", F.lit(1), probe)).alias("at", "x")).where("x.f > 1")
    cut = ws.save(cut.select("node", "c", "n", F.col("x.s").alias("s"), (F.col("at") < F.col("index")).alias("index")), "prefixes")
    # Of a shingle's nodes those of its largest component need no look at one another.
    by_class = cut.groupBy("s", "c").agg(F.count("*").alias("k"))
    main = by_class.groupBy("s").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("classes")).where("classes > 1").select("s", "main")
    met = cut.join(main, "s")
    a = met.where("c <> main").select("s", F.col("node").alias("x"), F.col("c").alias("c_x"), F.col("n").alias("n_x"), F.col("index").alias("i_x"))
    b = met.select("s", "main", F.col("node").alias("y"), F.col("c").alias("c_y"), F.col("n").alias("n_y"), F.col("index").alias("i_y"))
    once = (F.col("c_y") == F.col("main")) | (F.col("x") < F.col("y"))
    sizes = DEN * F.least("n_x", "n_y") >= NUM * F.greatest("n_x", "n_y")
    indexed = F.when(F.col("n_x") <= F.col("n_y"), F.col("i_x")).otherwise(F.col("i_y"))
    return a.join(b, "s").where((F.col("c_x") != F.col("c_y")) & once & sizes & indexed).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _close(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) by SimHash: one fingerprint, or two within RADIUS bits."""
    fps = ws.save(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    same = nodes.select("fp", "node").join(fps, "fp").where("rep <> node").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    return same.unionByName(simhash.near_links(ws, fps, RADIUS, direct=True))


def links(ws: Workspace, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Verified edges (u, v) that connect all nodes (node, doc_id, fp, bands) of a similarity; `docs` has their texts."""
    close = ws.save(_close(ws, nodes), "close")
    dealt = nodes.select(F.explode("bands").alias("band"), "node", _row(F.col("node")).alias("row"))
    shared = dealt.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    met = ws.save(dealt.join(shared, "band"), "met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HELD):
                own = [np.fromiter(s, np.uint64, len(s)).view(np.int64) for s in (shingles_of(t, shingle) for t in part.column("text").to_pylist())]
                yield pa.record_batch({"node": part.column("node"), "own": pa.array(own, pa.list_(pa.int64()))})

    texts = docs.select(_row(_node()).alias("row"), _node().alias("node"), F.col("text").cast("string").alias("text"))
    paired = nodes.join(close.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_semi")
    wanted = met.select("row").unionByName(paired.select(_row(F.col("node")).alias("row")))
    texts = texts.join(wanted.distinct(), "row", "left_semi").dropDuplicates(["row"])
    sets = ws.save(texts.select("node", "text").mapInArrow(run, "node long, own array<long>"), "sets")
    agrees = met.groupBy("node").agg(F.sum("k").alias("agrees"))
    hubs = met.join(agrees, "node").groupBy("band").agg(F.max(F.struct("agrees", "node"))["node"].alias("hub"))
    sure = ws.save(_similar(close, sets), "sure")
    joined = connected_components(ws, sure)
    star = met.select("band", "node").join(hubs, "band").where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    named = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    star = star.join(named("u"), "u", "left").join(named("v"), "v", "left").where("c_u is null or c_v is null or c_u <> c_v").select("u", "v")
    near = ws.save(sure.unionByName(_similar(ws.save(star, "star"), sets)), "near")
    classes = connected_components(ws, near)
    open_ = met.select("band", "node").join(classes, "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    mixed = open_.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    open_ = ws.save(open_.join(mixed, "band", "left_semi").select("node", "c").distinct(), "open")
    rest = ws.save(_prefix_pairs(ws, open_, sets), "rest")
    return near.unionByName(_similar(rest, sets))


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each group of near duplicates; columns as they were."""
    ws = Workspace(docs.sparkSession, "minhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HELD):
                fp, bands = signatures_of(part.column("text").to_pylist(), shingle)
                flat = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel()))
                yield pa.record_batch({"node": part.column("node"), "doc_id": part.column("doc_id"), "fp": pa.array(fp), "bands": flat})

    rows = docs.select(_node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "node long, doc_id long, fp long, bands array<long>")
    nodes = ws.save(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    classes = connected_components(ws, links(ws, docs, nodes, shingle))
    named = nodes.select("node", "doc_id").join(classes, "node", "left").withColumn("c", F.coalesce("component", "node"))
    best = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")).alias("best"))
    kept = best.select("best.node", "best.doc_id").select(_row(F.col("node")).alias("__row"))
    return docs.withColumn("__row", _row(_node())).join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
