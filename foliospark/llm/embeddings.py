"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label become one point with a weight, so copies cost nothing more. Points are dealt to overlapping
cluster shards: a point is at home at its nearest centre and a guest at every other centre whose bisecting plane with
the home's it is within half the longest link of. Of two linked points with different homes at least one is that near the
plane between these, so it is a guest at the other's home and dealing loses no link. Centres are a bounded sample of the
points of each label. Within a shard the graph is built on overlapping clusters again (exact neighbours within a
cluster, pruned robustly, lists united), and every point at home is searched greedily from the shard's medoid and its
own node. The range grows from each point found within WIDER times the threshold's angle until no new one appears. Each link
is verified in double precision.

Links are counted where they are found, and no pair leaves a shard. Two points with the same home count each other. Of
two with different homes, the home of the point with the smaller number counts for both if the other is a guest there,
else the other home; every point carries the list of its shards, so both shards come to the same answer. A shard returns
at most one sum a point and a spanning forest of its links, however dense a group is.

Each row is a vector, also if a vec_id repeats: it gets a row and its own count of links, and component_id is the
smallest vec_id of its component. Vectors that are null, zero or hold a null or a non-finite component, and vectors
without a label or a vec_id, link with nothing. Vectors of different lengths are not compared. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, connected_components, table

THRESHOLD = 0.98
#: Points a centre has at home on average, centres in all at most (16 MB at 64 dimensions).
SHARD, MAX_CENTRES = 250, 1 << 15
#: Similarities that dealing holds at once.
HELD = 1 << 22
#: Points whose candidates are pruned at once.
PRUNED = 128
#: What single sums of products may be off by.
ROUNDING = 1e-9
#: Neighbours that a node keeps, how much nearer a neighbour must be to another to be dropped, beam of the greedy search.
DEGREE, ALPHA, BEAM = 24, 1.2, 24
#: How much further than the threshold's angle the range grows, so that points which are linked only by way of others outside it are reached.
WIDER = 1.25


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; dividing by the largest component first keeps squares finite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of each point's candidates (nearest first): a candidate goes if a kept one is ALPHA times nearer to it than the point is."""
    kept = np.full((len(near), degree), -1, np.int64)
    for at in range(0, len(near), PRUNED):
        own = near[at : at + PRUNED]
        rows = np.arange(len(own))
        around = x[own]
        # Whether a candidate goes once another is kept, for all pairs of a point's candidates: one product instead of one a kept candidate.
        drops = ALPHA * (1 - around @ around.transpose(0, 2, 1)) <= (1 - sims[at : at + PRUNED])[:, None, :]
        alive = np.ones(own.shape, bool)
        for slot in range(degree):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            kept[at : at + PRUNED, slot] = np.where(has, own[rows, first], -1)
            alive &= ~drops[rows, first]
            alive[rows, first] = False
    return kept


def build(x: np.ndarray, cluster: int = 1024, degree: int = DEGREE) -> np.ndarray:
    """Adjacency (n, up to 2 * degree, -1: none) from overlapping clusters: each point is in its two nearest.

    Of two clusters each would hold every point, so they are one.
    """
    n = len(x)
    k = -(-n // cluster) if n > 2 * cluster else 1
    rng = np.random.default_rng(0)
    centres = x[rng.choice(n, k, replace=False)]
    two = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, : min(2, k)]
    lists = [np.full((n, degree), -1, np.int64) for _ in range(two.shape[1])]
    for c in range(k):
        member = np.flatnonzero((two == c).any(axis=1))
        if len(member) < 2:
            continue
        for at in range(0, len(member), 512):
            own = member[at : at + 512]
            sims = x[own] @ x[member].T
            sims[np.arange(len(own)), at + np.arange(len(own))] = -2
            m = min(2 * degree, len(member) - 1)
            best = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            values = np.take_along_axis(sims, best, 1)
            order = np.argsort(-values, axis=1, kind="stable")
            best, values = np.take_along_axis(best, order, 1), np.take_along_axis(values, order, 1)
            pruned = _prune(x, member[best], values, degree)
            for side in range(two.shape[1]):
                mine = two[own, side] == c
                lists[side][own[mine]] = pruned[mine]
    return np.concatenate(lists, axis=1)


def _reverse(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each point is a neighbour: (first place of each point, points), so that none is out of reach."""
    source, slot = np.nonzero(graph >= 0)
    target = graph[source, slot]
    order = np.argsort(target, kind="stable")
    return np.searchsorted(target[order], np.arange(len(graph) + 1)), source[order]


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, medoid: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, points within the threshold of it) by beam search from the medoid and the query's node, then by growing the range."""
    n = len(x)
    wide = float(np.cos(min(np.pi, WIDER * np.arccos(threshold))))
    first, back = _reverse(graph)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rows = np.arange(len(q))
        beam = np.full((len(q), BEAM), -1, np.int64)
        value = np.full((len(q), BEAM), -3.0)
        seen = np.zeros((len(q), n), bool)
        done = np.zeros((len(q), BEAM), bool)
        for slot, start in enumerate((np.full(len(q), medoid), q)):
            beam[:, slot], value[:, slot] = start, np.einsum("nd,nd->n", x[q], x[start])
            done[:, slot] = seen[rows, start]
            seen[rows, start] = True
        while True:
            open_ = np.where(done | (beam < 0), -4.0, value)
            slot = open_.argmax(axis=1)
            go = open_[rows, slot] > -3.5
            if not go.any():
                break
            done[rows[go], slot[go]] = True
            around = np.where(go[:, None], graph[np.maximum(beam[rows, slot], 0)], -1)
            fresh = (around >= 0) & ~seen[rows[:, None], np.maximum(around, 0)]
            r, c = np.nonzero(fresh)
            seen[r, around[r, c]] = True
            sims = np.full(around.shape, -3.0)
            sims[r, c] = np.einsum("nd,nd->n", x[q[r]], x[around[r, c]])
            all_, val = np.concatenate([beam, np.where(fresh, around, -1)], axis=1), np.concatenate([value, sims], axis=1)
            was = np.concatenate([done, np.zeros(around.shape, bool)], axis=1)
            best = np.argpartition(-val, BEAM - 1, axis=1)[:, :BEAM]
            beam, value, done = (np.take_along_axis(a, best, 1) for a in (all_, val, was))
        # Range growth: neighbours of what is within the wider range, until none is new.
        for i, point in enumerate(q):
            front = beam[i][value[i] >= wide]
            found, known = [front], np.zeros(n, bool)
            known[front] = True
            while len(front):
                size = first[front + 1] - first[front]
                behind = back[np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                around = np.concatenate([graph[front].ravel(), behind])
                around = np.unique(around[around >= 0])
                around = around[~known[around]]
                known[around] = True
                front = around[x[around] @ x[point] >= wide]
                found.append(front)
            hits = np.unique(np.concatenate(found))
            hits = hits[(x[hits] * x[point]).sum(axis=1) >= threshold]
            yield int(point), hits[hits != point]


def _usable() -> Column:
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, label, usable) of every row, in double precision."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    return own.withColumn("usable", _usable())


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _root(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of some points; the ways to them become shorter."""
    top = root[at]
    while True:
        above = root[top]
        if (above == top).all():
            root[at] = top
            return top
        top = above


def links(ws: Workspace, points: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of distinct points (pid, v, label, copies): (pid, n) links to other points weighted by their copies, and edges (u, v) between pids."""
    spark = ws.spark
    n = points.count()
    share = min(1.0, min(n / SHARD, MAX_CENTRES) / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < F.lit(max(1, int(share * (1 << 30))))).select("pid", "v", "label").toPandas()
    centres: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for (label, size), g in chosen.assign(size=chosen.v.map(len)).groupby(["label", "size"]):
        centres[label, size] = (g.pid.to_numpy(np.int64), _unit(np.array(g.v.tolist(), float)))
    sent = spark.sparkContext.broadcast(centres)
    half = float(np.sqrt(max(0.0, 2 - 2 * threshold))) / 2

    def place(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shards each point goes to, and its home."""
        sims = x @ c.T
        best = sims.argmax(axis=1)
        # (own - sims) / apart is how far a point is from the plane between its home and a centre.
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c[best] @ c.T)))
        goes = sims.max(axis=1)[:, None] - sims <= half * apart + ROUNDING
        goes[np.arange(len(x)), best] = True
        return goes, best

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), sizes.tolist(), strict=True)):
                groups.setdefault(key, []).append(i)
            for key, every in groups.items():
                # A label without a centre is one shard.
                ids, c = sent.value.get(key, (np.array([-1]), None))
                for at in range(0, len(every), max(1, HELD // len(ids))):
                    rows = batch.take(pa.array(every[at : at + max(1, HELD // len(ids))]))
                    goes, best = np.ones((rows.num_rows, 1), bool), np.zeros(rows.num_rows, np.int64)
                    if c is not None:
                        goes, best = place(_unit(_matrix(rows.column("v"))), c)
                    which, centre = np.nonzero(goes)
                    ends = np.concatenate(([0], np.cumsum(goes.sum(axis=1)))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[centre]))
                    out, lists = rows.take(pa.array(which)), lists.take(pa.array(which))
                    names = [f"{key[0]}|{key[1]}|{s}" for s in ids[centre].tolist()]
                    yield pa.record_batch(
                        {
                            "shard": pa.array(names), "home": pa.array(centre == best[which]), "pid": out.column("pid"), "v": out.column("v"), "copies": out.column("copies"),
                            "at_home": pa.array(ids[best[which]]), "shards": lists,
                        }
                    )

    def find(key: tuple, table_: pa.Table) -> pa.Table:
        table_ = table_.sort_by("pid").combine_chunks()
        x = _unit(_matrix(table_.column("v").combine_chunks()))
        pid, copies, home, at_home = (table_.column(c).to_numpy() for c in ("pid", "copies", "home", "at_home"))
        goes = table_.column("shards").combine_chunks()
        first, listed = goes.offsets.to_numpy(), goes.flatten().to_numpy()
        first = first - first[0]
        count, root, u, v = np.zeros(len(x), np.int64), np.arange(len(x)), [], []
        if home.any() and len(x) > 1:
            graph = build(x)
            medoid = int((x @ x.mean(axis=0)).argmax())
            for i, hits in search(x, graph, np.flatnonzero(home), medoid, threshold):
                if not len(hits):
                    continue
                here, guests = hits[home[hits]], hits[~home[hits]]
                # This shard counts unless the guest's home does: its number is smaller and this point is a guest there.
                guests = guests[(guests > i) | ~np.isin(at_home[guests], listed[first[i] : first[i + 1]])]
                count[i] += copies[here].sum() + copies[guests].sum()
                count[guests] += copies[i]
                tops = np.unique(_root(root, np.append(hits, i)))
                if len(tops) > 1:
                    root[tops[1:]] = tops[0]
                    u.append(np.full(len(tops) - 1, pid[tops[0]]))
                    v.append(pid[tops[1:]])
        some = np.flatnonzero(count)
        u, v = (np.concatenate([pid[some], *z]) for z in (u, v if v else [])) if u else (pid[some], pid[some])
        v[: len(some)] = 0
        return pa.table({"u": pa.array(u), "v": pa.array(v), "n": pa.array(np.concatenate([count[some], np.zeros(len(u) - len(some), np.int64)]))})

    dealt = points.mapInArrow(deal, "shard string, home boolean, pid long, v array<double>, copies long, at_home long, shards array<long>")
    got = ws.save(dealt.groupBy("shard").applyInArrow(find, "u long, v long, n long"), "links")
    return got.where("n > 0").groupBy(F.col("u").alias("pid")).agg(F.sum("n").alias("n")), got.where("n = 0").select("u", "v")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ws = Workspace(vectors.sparkSession, "embeddings")
    rows = _vectors(vectors)
    # The vector's own doubles make the key, so that points are equal only if their vectors are.
    usable = ws.save(rows.where("usable").withColumn("key", F.sha2(F.concat_ws("|", "label", F.to_json("v")), 256)).select("vec_id", "v", "label", "key"), "usable")
    distinct = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    points = ws.save(distinct.withColumn("pid", F.monotonically_increasing_id()), "points")
    counts, edges = links(ws, points.select("pid", "v", "label", "copies"), threshold)
    classes = connected_components(ws, edges)
    named = points.select("key", "pid", "rep", "copies").join(counts, "pid", "left").join(classes.withColumnRenamed("node", "pid"), "pid", "left")
    named = ws.save(named.select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "pid").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = named.join(smallest, "component").select("key", "n_links", "component_id")
    linked = usable.select("vec_id", "key").join(by_key, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def audit(vectors: DataFrame, threshold: float = THRESHOLD, every: int = 50) -> DataFrame:
    """(queries, true_links, found_links, recall): links of the vectors whose id is divisible by `every`, by brute force and by the graph."""
    usable = _vectors(vectors).where("usable")
    queries = usable.where(F.col("vec_id") % every == 0)
    cosine = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(cosine(a, a))
    q, p = queries.alias("q"), usable.alias("p")
    near = q.join(p, (F.col("q.label") == F.col("p.label")) & (F.size("q.v") == F.size("p.v")) & (F.col("q.vec_id") != F.col("p.vec_id"))).where(
        cosine(F.col("q.v"), F.col("p.v")) >= threshold * norm(F.col("q.v")) * norm(F.col("p.v"))
    )
    true = near.groupBy(F.col("q.vec_id").alias("vec_id")).agg(F.count("*").alias("t"))
    found = near_duplicates(vectors, threshold).join(queries.select("vec_id"), "vec_id", "left_semi").select("vec_id", "n_links")
    return found.join(true, "vec_id", "left").agg(
        F.count("*").alias("queries"), F.sum(F.coalesce("t", F.lit(0))).alias("true_links"), F.sum("n_links").alias("found_links"),
        (F.sum("n_links") / F.greatest(F.sum(F.coalesce("t", F.lit(0))), F.lit(1))).alias("recall"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same rows in SQL: all pairs of a label, and the smallest vec_id that is reached.
ORACLE = f"""
WITH RECURSIVE
p AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS v,
         vec_id IS NOT NULL AND label IS NOT NULL AND coalesce(len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))), FALSE)
         AND coalesce(len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS usable
  FROM embeddings),
u AS (SELECT * FROM p WHERE usable),
l AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y, b.vec_id FROM u AS a JOIN u AS b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT reach.x, min(p.vec_id) AS low FROM reach JOIN p ON p.r = reach.y GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT p.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(p.vec_id, coalesce(c.low, p.vec_id)) AS component_id,
       p.vec_id = least(p.vec_id, coalesce(c.low, p.vec_id)) AS kept
FROM p LEFT JOIN n ON n.x = p.r LEFT JOIN c ON c.x = p.r
"""
