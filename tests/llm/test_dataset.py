"""The manifest, importance resampling and byte-level BPE against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bytebpe, merkle, resampling


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        a = i - i % 3
        yield level[a:i], level[i + 1 : a + 3]
        i //= 3


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit(7) for c in ("g", "rank", "node", "levels", "path", "root", "leaf", "block", "of")})


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    rows = [(i, f"s{i % 3}" if i % 4 else None, "en", i, f"text {i}\n") for i in range(40)]
    rows += [(5, "s9", None, None, None), (6, "é", "de", 3, ""), (7, "é", "de", 3, "\n\n"), (None, "s1", "en", 1, "no id\n"), (None, "s1", "en", 1, "no id\n"), (3, "s0", "en", 9, "again"), (2, "Z", "x" * 300, 1, "é\n" * 5000)]
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    trees, order = {}, sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(groups[s]):
            way = [*siblings(trees[s], i), *siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = sha("".join(map(field, (*r[:4], r[4].replace("\n", ""))))) if hit and r[4] else own
            for a, b in way:
                fold = sha("".join([*a, fold, *b]))
            want.append((str(r[0]), own, trees[s][-1][0], top[-1][0], sha("".join(x for a, b in way for x in (*a, *b))), fold, fold == top[-1][0]))
    made = merkle.manifest(rows_of(spark, rows), keep={"doc_id": F.col("doc_id"), "presented": merkle.tampered_leaf()}, height=height)
    got = merkle.verified(made.proofs(), "presented").select(F.col("doc_id").cast("string"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert [r["root"] for r in made.root().collect()] == [top[-1][0]]
    nodes = {(r["g"], r["level"], r["idx"]): r["node"] for r in made.rows.nodes().collect()}
    assert nodes == {(s, j, i): x for s in order for j, level in enumerate(trees[s]) for i, x in enumerate(level)}


def test_manifest_of_few_rows(spark):
    none = merkle.manifest(rows_of(spark, []))
    assert none.proofs().collect() == [] and none.root().collect() == []
    one = merkle.manifest(rows_of(spark, [(1, None, None, None, None)])).proofs().collect()
    assert [(r["leaf"], r["root"], r["path"]) for r in one] == [(sha("1:1----"), sha("1:1----"), [])]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling(spark, docs_of, odd, runs):
    rows = [*odd, *((i, f"{'Prose' if i % 3 else 'QUESTION answer'} " * (i % 30) + f"w{i} É-x") for i in range(100, 160))]
    target = [(1, "question answer question"), (2, None), (2, "What is the ANSWER?")]

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for _, x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    want = []
    for i, x in rows:
        n_words, own = features(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        want.append([i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is not None, w[0] or 0, w[2]))
    for k, w in enumerate(able):
        w.append(k + 1 if k < 10 * len(able) // 100 else None)
    want = [(*w, None)[:6] for w in want]
    items = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resampled(docs_of(rows), items, runs=runs).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(w[5] for w in want)
    best = {w[0] for w in want if w[5]}
    kept = resampling.drawn(docs_of(rows), items, runs=runs)
    assert kept.columns == docs_of(rows).columns and {r["doc_id"] for r in kept.collect()} == best


def test_resampling_of_empty_tables(spark, docs_of, odd):
    docs, items = docs_of(odd), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(docs.limit(0), items).collect() == []
    assert resampling.resampled(docs, items).where("weight > 1000").count() == 0


def test_pretokens():
    """Cut word by word, random texts have the ids that the encoder gives to the whole."""
    rng, own = random.Random(3), bytebpe.encoder(bytebpe.default_vocabulary())
    parts = [*" \n\t 　'aAsStTreveldlmé1２½!?.-_´́😀​ǅ中٣ⅷ\x1c\x85", "'s", "'ll", "'re", "'ve", "'d", "'m", "'t", " '", "\r\n", "'S", "'LL", "  "]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(4000)), "� a", "x" * 5000, " " * 5000 + "a"]
    for array in (pa.array(texts), pa.array(["'s zz", *texts])[1:]):
        codes, ends, words = bytebpe.pretokens(array)
        names = words.to_pylist()
        for i, t in enumerate(texts):
            cut = [names[c] for c in codes[ends[i] : ends[i + 1]]]
            assert "".join(cut) == (t or "") and [k for w in cut for k in own.encode_ordinary(w)] == own.encode_ordinary(t or "")


@pytest.mark.parametrize("block", [1, 16 << 20])
def test_byte_level_bpe(spark, docs_of, odd, block, monkeypatch):
    rows = [*odd, (20, "It's we'll  'tis\n\n and more\t"), (21, "\x00 null byte"), (20, "again and again and again"), (22, " ".join(f"w{i}" for i in range(20_000)))]
    own = bytebpe.encoder(bytebpe.default_vocabulary())
    monkeypatch.setattr(bytebpe, "BLOCK_BYTES", block)
    docs = docs_of(rows).repartition(2)
    found = bytebpe.encoded(docs, bytes=True).collect()
    want = sorted((str(i), np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["bytes"])) for r in found) == want
    ids = bytebpe.encoded(docs)
    assert ids.columns == ["doc_id", "ids"]
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in bytebpe.decoded(ids).collect()) == sorted((i, b) for i, _, b in want)


def test_byte_level_bpe_of_odd_tables(spark, docs_of):
    assert bytebpe.encoded(docs_of([(1, "a")]).limit(0), bytes=True).collect() == []
    assert [tuple(r) for r in bytebpe.encoded(docs_of([(1, None)]), bytes=True).collect()] == [(1, b"", b"")]
    ids = spark.createDataFrame([(1, np.array([60_000, 64, 4_000_000_000], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in bytebpe.decoded(ids).collect()) == [(1, b"a"), (2, b"")]
