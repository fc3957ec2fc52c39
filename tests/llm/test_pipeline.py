"""The whole pipeline over small tables, against brute force."""

import random

import pytest

import corpus_pipeline
from foliospark.llm import packing


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(21)
    root = tmp_path_factory.mktemp("tables")
    vocabulary = ["".join(random.choice("aeioubcdlmnrst") for _ in range(random.randint(3, 8))) for _ in range(800)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    benchmark = [(i, prose(30)) for i in range(20)] + [(20, None), (None, "")]
    rows, labels = [], []
    for i in range(400):
        text = prose(random.choice([20, 60, 200]))
        if i % 5 == 0:
            text = f"{text} {random.choice(['grumpwort', 'vilefish', 'snarkos'])} {prose(20)}"
        elif i % 5 == 1 and i % 2:
            text = f"{text} {benchmark[i % 20][1]} {prose(5)}"
        elif i % 5 == 2:
            text = f"{text} write to someone{i}@example.org {prose(3)}"
        rows.append((i, text))
        labels.append((i, int(i % 2), int(i % 5 == 0)))
    clean = [t for i, t in rows if i % 5 in (3, 4)]
    near = clean[0].split()
    near[len(near) // 2] = "changed"
    extra = [(None, None), (1000, None), (1001, ""), (1002, " \n"), (1003, clean[1]), (3, clean[2]), (None, clean[3]), (1004, " ".join(near)), (1005, rows[0][1]), (1006, "x " * 20_000), (1007, "x " * 20_000)]
    rows += extra
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, benchmark


def test_run(spark, tables):
    from tokenizers import Tokenizer

    root, rows, benchmark = tables
    got = corpus_pipeline.run(spark, root).collect()
    left = [(i, t) for i, t in rows if not any(w in (t or "") for w in ("grumpwort", "vilefish", "snarkos"))]
    groups = []
    for i, t in left:
        met = [g for g in groups if any(alike(t, u) for _, u in g)]
        groups = [g for g in groups if g not in met] + [[(i, t), *(r for g in met for r in g)]]
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    windows = {tuple(w[k : k + 10]) for _, t in benchmark for w in [(t or "").split()] for k in range(len(w) - 9)}
    left = [(i, t) for i, t in left if not any(tuple(w[k : k + 10]) in windows for w in [(t or "").split()] for k in range(len(w) - 9))]
    left = [(i, None if t is None else " ".join("[EMAIL]" if "@" in w else w for w in t.split(" "))) for i, t in left]
    own = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted((str(i), len(own.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in left)
    sums = {}
    for r in got:
        sums[str(r["doc_id"])] = sums.get(str(r["doc_id"]), 0) + r["length"]
    per_doc = {}
    for i, n in want:
        per_doc[i] = per_doc.get(i, 0) + n
    assert sums == per_doc and 200 < len(want) < 330 and "1004" not in sums and "1003" not in sums and "1006" in sums and "1007" not in sums


def test_stages_over_empty_tables(spark, tables):
    root, *_ = tables
    empty = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, root)
        assert out.collect() == [] and (name == "packing" or out.columns == empty.columns)
