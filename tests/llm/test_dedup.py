"""Near and substring deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import embeddings, simhash, substrings


def fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def check_simhash(got, rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(i, fingerprint(t))
    known = [i for i in prints if i is not None]
    want = components(known, [(a, b) for a in known for b in known if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])


def test_simhash_odd_rows(docs_of, odd):
    got = simhash.near_duplicates(docs_of(odd)).collect()
    check_simhash(got, odd)
    assert next(r for r in got if r["doc_id"] is None)["component_id"] == 8
    assert simhash.near_duplicates(docs_of(odd).limit(0)).collect() == []


def test_simhash_with_many_leaves(docs_of, monkeypatch):
    """Small leaves, so that most fingerprints meet in leaves that overlap."""
    monkeypatch.setattr(simhash, "LEAF", 20)
    random.seed(2)
    rows = []
    for i in range(500):
        words = [random.choice("abcdefghijkl") for _ in range(120)]
        for k in range(3):
            rows.append((3 * i + k, " ".join(words)))
            words[random.randrange(120)] = "x"
    check_simhash(simhash.near_duplicates(docs_of(rows)).collect(), rows)


def test_simhash_groups(docs_of):
    random.seed(1)
    base = [random.choice("abcdefgh") for _ in range(400)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(random.randint(0, 6)):
            own[random.randrange(400)] = random.choice("abcdefgh")
        rows.append((i * 3 % 361, " ".join(own) if i % 4 else " ".join(random.choice("abcdefgh") for _ in range(50))))
    check_simhash(simhash.near_duplicates(docs_of(rows)).collect(), rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=60, unique=True), st.integers(0, 4))
def test_tree_shares_a_leaf(seeds, radius):
    points = np.array(sorted({*seeds, *(s ^ 3 for s in seeds), *(s ^ (1 << 63) for s in seeds)}), np.uint64)
    leaves = []
    tree = simhash.build_tree(points[::2], 4, radius, leaves)
    held = {}
    for leaf, at in simhash.route(tree, points, np.arange(len(points)), radius):
        held.setdefault(leaf, set()).update(at.tolist())
    for i in range(len(points)):
        for j in np.flatnonzero(simhash.distances(points[i], points) <= radius).tolist():
            assert any(i in s and j in s for s in held.values())


def test_forest_splits_large_leaves():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([points, points ^ np.uint64(5)]))
    ids = np.arange(len(points))
    edges = [(int(a), int(b)) for u, v in simhash.forest(points, ids, 2, leaf=64) for a, b in zip(u, v, strict=True)]
    near = [(i, j) for i in range(len(points)) for j in range(i) if (int(points[i]) ^ int(points[j])).bit_count() <= 2]
    assert components(ids.tolist(), edges) == components(ids.tolist(), near)


def kept_words(rows, width=13):
    low, words = {}, [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1 if i is not None else 0):
            x = tuple(w[k : k + width])
            low[x] = min(low.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1 if i is not None else 0):
            if low[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_substrings(docs_of, odd):
    random.seed(2)
    base = [random.choice("abcd") for _ in range(300)]
    rows = [*odd, (10, "x " * 50), (11, "X " * 50)]
    for _ in range(50):
        k = random.randint(0, 250)
        rows.append((random.randint(0, 40), " ".join([random.choice("abcdefgh") for _ in range(random.randint(0, 20))] + base[k : k + random.randint(5, 60)] + [random.choice("abc") for _ in range(random.randint(0, 30))])))
    for parts in (1, 5):
        got = substrings.deduplicated(docs_of(rows).repartition(parts)).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == kept_words(rows)
        assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert substrings.deduplicated(docs_of(rows).limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=4), st.lists(st.integers(0, 2), max_size=30))
def test_automaton(texts, query):
    a = substrings.Automaton()
    for t in texts:
        a.add(t)
    held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((n for n in range(1, e + 1) if tuple(query[e - n : e]) in held), default=0) for e in range(1, len(query) + 1)]
    assert a.matches(query) == want


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * 0.01 * (i % 5)).tolist(), i % 3) for i in range(400)]
    rows += [(400 + i, rows[0][1], 0) for i in range(30)] + [(430, [x * 7 for x in rows[0][1]], 0), (431, rows[0][1], None), (432, None, 0), (433, [0.0] * 16, 0), (434, [None] * 16, 0), (435, [float("nan")] * 16, 0), (436, [1.0], 0), (437, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "'x' AS key")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    good = [(i, np.array(v, float), la) for i, v, la in rows if v is not None and la is not None and None not in v and np.isfinite(v).all() and any(v)]
    linked = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y >= 0.98 * np.linalg.norm(x) * np.linalg.norm(y)]
    count = {i: 0 for i, *_ in rows}
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    want = components(count, linked)
    assert got == {i: (count[i], want[i], want[i] == i) for i in count}
    assert embeddings.near_duplicates(df.limit(0)).collect() == []
    assert embeddings.audit(df.where("vec_id < 436")).first()["recall"] == 1.0


def test_embeddings_rows_and_dense_groups(spark, monkeypatch):
    """A vec_id that repeats gives a row each; counts hold however many homes a dense group has."""
    monkeypatch.setattr(embeddings, "SHARD", 20)
    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    rows = [(7, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.02], 1), (None, [1.0, 0.0], 1), (9, [], 1)]
    rows += [(100 + i, (one + rng.normal(size=8) * 0.12).tolist(), 2) for i in range(300)] + [(500 + i, rng.normal(size=8).tolist(), 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()), key=str)
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for _, v, _ in rows]
    good = [k for k, (i, v, _) in enumerate(rows) if i is not None and v]
    linked = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    count = Counter(x for e in linked for x in e)
    group = components(range(len(rows)), linked)
    low = {}
    for k in good:
        low[group[k]] = min(low.get(group[k], 1 << 60), rows[k][0])
    want = sorted(((i, count[k], low[group[k]] if k in good else i) for k, (i, _, _) in enumerate(rows)), key=str)
    assert len(linked) > 5000 and got == want


@pytest.mark.parametrize("shard", [25, 250])
def test_embeddings_lose_no_link_between_shards(spark, monkeypatch, shard):
    """Overlapping Gaussian groups, cut through by many shards, against brute force."""
    monkeypatch.setattr(embeddings, "SHARD", shard)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 64)) * 0.135
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    assert near.sum() > 100_000 and got == dict(enumerate((near.sum(axis=1) - 1).tolist()))


def test_embeddings_graph_of_a_shard_is_built_once():
    """Two clusters, each with every point, are one; pruning looks at all pairs of a point's candidates."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))[rng.integers(0, 300, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embeddings.build(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    for i in range(0, 1500, 25):
        left, kept = np.argsort(-sims[i])[: 2 * embeddings.DEGREE].tolist(), []
        while left and len(kept) < embeddings.DEGREE:
            kept.append(left[0])
            left = [j for j in left[1:] if embeddings.ALPHA * (1 - sims[kept[-1], j]) > 1 - sims[i, j]]
        assert graph[i][graph[i] >= 0].tolist() == kept
