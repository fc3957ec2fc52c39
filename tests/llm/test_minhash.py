"""The pipeline's near-duplicate stage against brute force."""

import random

import numpy as np

import corpus_pipeline
from foliospark.llm import minhash, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts):
    """Components of the texts by exact similarity."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_stage_links_all_pairs_from_0_8_and_none_below(spark, docs_of, odd):
    random.seed(3)
    rows = [*odd]
    for i in range(150):
        words = [f"w{random.randint(0, 9999)}" for _ in range(random.choice([12, 60, 200]))]
        rows.append((100 + 3 * i, " ".join(words)))
        for k in range(2):
            own = list(words)
            for _ in range(random.randint(1, max(1, len(own) // 25))):
                own[random.randrange(len(own))] = "changed"
            rows.append((101 + 3 * i + k, " ".join(own)))
    # A crowd of near copies of one text, and a row without doc_id.
    base = [f"v{k}" for k in range(80)]
    for i in range(60):
        own = list(base)
        own[random.randrange(80)] = f"x{i}"
        rows.append((None if i == 7 else 1000 + i, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    assert sum(0.8 <= similarity(a, b) < 0.9 for i, a in enumerate(sets) for b in sets[:i]) > 50
    docs = docs_of(rows)
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    held = {}
    for (i, t), g in zip(rows, groups([t for _, t in rows]), strict=True):
        held.setdefault(g, []).append((i is None, i or 0))
    want = sorted(min(h) for h in held.values())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want
    assert corpus_pipeline.simhash_stage(spark, docs.limit(0), "").collect() == []


def test_bands_agree_as_often_as_they_should():
    random.seed(4)
    agree = 0
    for _ in range(200):
        words = [f"w{random.randint(0, 99999)}" for _ in range(94)]
        a, b = " ".join(words), " ".join([*words[:84], *(f"y{k}" for k in range(10))])
        _, bands = minhash.signatures_of([a, b])
        agree += int((bands[0] == bands[1]).sum())
    # 80 of 100 shingles are common: a band agrees with chance 0.8^6.
    assert abs(agree / (200 * minhash.BANDS) - 0.8**6) < 0.03


def test_stage_takes_close_pairs_from_the_vantage_point_shards(spark, docs_of, monkeypatch):
    random.seed(6)
    base = [[f"w{random.randint(0, 9999)}" for _ in range(150)] for _ in range(30)]
    rows = [(3 * i + k, " ".join([*words, *(["changed"] * k)])) for i, words in enumerate(base) for k in range(3)]
    dealt, near_links = [], simhash.near_links

    def seen(ws, fps, radius, direct):
        out = near_links(ws, fps, radius, direct)
        dealt.append((fps, radius, out))
        return out

    monkeypatch.setattr(simhash, "near_links", seen)
    kept = corpus_pipeline.simhash_stage(spark, docs_of(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [3 * i for i in range(30)]
    (fps, radius, pairs), = dealt
    of = {r["rep"]: r["fp"] for r in fps.collect()}
    assert set(of.values()) == set(simhash.fingerprints_of([t for _, t in rows], 5).view(np.int64).tolist())
    pairs = [(r["u"], r["v"]) for r in pairs.collect()]
    assert pairs and all(((of[u] ^ of[v]) & (2**64 - 1)).bit_count() <= radius for u, v in pairs)


def test_direct_edges_are_within_the_radius_and_join_the_same():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, np.uint64)
    points = np.unique(np.concatenate([b ^ np.concatenate(([0], np.cumsum(1 << rng.choice(60, 4, replace=False)))).astype(np.uint64) for b in base]))
    ids = rng.permutation(len(points))

    def components(edges):
        root = np.arange(len(points))
        for a, b in edges:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    edges = {d: [(int(a), int(b)) for u, v in simhash.forest(points, ids, 2, leaf=64, direct=d) for a, b in zip(u, v, strict=True)] for d in (False, True)}
    at = np.argsort(ids)
    assert edges[True] and all(simhash.distances(points[at[a]], points[at[b]]) <= 2 for a, b in edges[True])
    assert components(edges[True]) == components(edges[False]) and max(map(len, components(edges[True]))) > 1
