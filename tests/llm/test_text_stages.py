"""Decontamination, personal data, packing, sharding, chat, toxicity and the language model."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import chat, decontaminate, maxent, packing, pii, sharding, toxicity
from foliospark.llm.common import byte_hashes


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def test_decontaminate(spark, docs_of, odd):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away now"), (2, "Only Three words"), (2, "Only Three words"), (3, None), (4, "..."), (None, "é b c d e f g h i j"), (11, "three words, the quick")]
    rows = [*odd, (20, "So THE quick brown fox; jumps over the-lazy dog and runs! End"), (21, "only three words only three words"), (22, "three. words the QUICK x"), (23, "É b c d e f g h i j"), (24, "é b c d e f g h i j")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = alnum(t)
        for k in range(max(len(w) - 9, min(1, len(w)))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for block in (decontaminate.BLOCK_BYTES, 64):
        decontaminate.BLOCK_BYTES, before = block, decontaminate.BLOCK_BYTES
        got = decontaminate.scan(docs_of(rows), bench).collect()
        decontaminate.BLOCK_BYTES = before
        seen = []
        for i, t in rows:
            w, names, hit = alnum(t), set(), set()
            for x, ids in windows.items():
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        names |= {str(n) for n in ids if n is not None}
                        hit |= set(range(k, k + len(x)))
            seen.append((i, len(w), len(hit), sorted(names)))
        key = lambda r: str(r)
        assert sorted(((r["doc_id"], r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), r["items"]) for r in got), key=key) == sorted(seen, key=key)
    docs = docs_of(rows)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id >= 20").collect()) == [23]
    assert {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs_of([(21, "a only three words.")]), bench).collect()} == {21: "a   ."}
    assert decontaminate.scan(docs.limit(0), bench).collect() == [] and decontaminate.scan(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    t, digits = t or "", lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_pii(docs_of, odd):
    random.seed(1)
    texts = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.1.1.1", "😀 4845168114407329 x", "+1 (017) 555-7713", "1" * 20_000, "a" * 20_000 + "@b.c", "+" * 50, "1-" * 5000, ".@a.b", "9 " * 14 + "+49 30 1234567."]
    texts += ["".join(random.choice(["1", "2", "4", ".", "@", "a", " ", "-", "+", "(", ")", "255", "é", "😀", "4845168114407329"]) for _ in range(random.randint(1, 80))) for _ in range(150)]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    got = pii.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: [(s["start"], s["end"]) for s in r[f"_{k}"]] for k in pii.BASE} == base_spans(r["text"])
    more = {r["doc_id"]: r for r in pii.scan(docs_of([(1, "my iban DE89 3704 0044 0532 0130 00"), (2, "iban DE88 3704 0044 0532 0130 00"), (3, "call 030 1234 5678"), (4, "see 030 1234 5678")])).collect()}
    assert [len(more[i]["_iban"]) for i in (1, 2)] == [1, 0] and [len(more[i]["_tel"]) for i in (3, 4)] == [1, 0]
    docs = docs_of([(1, "a@b.cc, 1.2.3.4"), (2, None), (3, "x")])
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and [(r["text"], r["n_chars"]) for r in clean.orderBy("doc_id").collect()] == [("[EMAIL], [IP]", 13), (None, None), ("x", 1)]


def test_pii_with_many_spans(spark, docs_of):
    """Places, overlaps and redaction of thousands of spans in a text, against plain Python; an empty table."""
    random.seed(11)
    bits = ["a@b.cc", "1.2.3.4", "+49 30 1234567", "4845168114407329", "tel 030 1234 5678", "phone 030 1234 5678@x.yy", "é😀", "word " * 300, "\n", "IBAN DE89 3704 0044 0532 0130 00"]
    for size in (1, 127, 128, 129, 3000):
        text = " ".join(random.choice(bits) for _ in range(size))
        docs = docs_of([(1, text)])
        row = pii.scan(docs).first()
        assert {k: [(s["start"], s["end"]) for s in row[f"_{k}"]] for k in pii.BASE} == base_spans(text)
        base = [(s["start"], s["end"]) for k in pii.BASE for s in row[f"_{k}"]]
        for kind in pii.KINDS[4:]:
            for m in re.finditer(pii._PATTERNS[kind].replace("}+", "}").replace("?+", "?"), text):
                near = re.search(pii.CONTEXT_WORDS[kind].replace("(?i)", ""), text[max(0, m.start() - 12) : m.start()], re.IGNORECASE)
                free = not any(a < m.end() and m.start() < b for a, b in base)
                assert ((m.start(), m.end()) in [(s["start"], s["end"]) for s in row[f"_{kind}"]]) == bool(near and free)
        want, at = "", 0
        for a, b, k in sorted((s["start"], s["end"], k) for k in pii.KINDS for s in row[f"_{k}"]):
            if a >= at:
                want += text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert pii.redacted(docs).first()["text"] == want + text[at:]
    assert pii.scan(docs_of([(1, "x")]).limit(0)).collect() == [] == pii.redacted(docs_of([(1, "x")]).limit(0)).collect()
    many = docs_of([(1, "a@b.cc, " * 16_000)])
    start = time.monotonic()
    assert len(pii.redacted(many).first()["text"]) == 16_000 * len("[EMAIL], ")
    assert time.monotonic() - start < 10


def test_windows_with_the_same_key(monkeypatch):
    """Windows whose keys collide are told apart by their words."""
    monkeypatch.setattr(decontaminate, "_keys", lambda ids: np.full(len(ids), 7, np.uint64))
    windows = decontaminate.Windows([("a", "one two three"), ("b", "two three four"), ("c", "five")], 3)
    codes, ends, words = decontaminate.alnum_words(pa.array(["x one two three four", "three two one", "five"]))
    hit, pairs = windows.find(codes, ends, words)
    assert hit.tolist() == [False, True, True, True, True, False, False, False, True] and pairs == [(0, "a"), (0, "b"), (2, "c")]


def test_packing(docs_of, odd):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own = Tokenizer.from_file(path)
    random.seed(4)
    words = ["Don't", "x.", "y!!", "Ünï", "a-b", "1234", "<|endoftext|>", "…", "end.…", "İ", "Å.", "中文", "it's,", "'s", "ok\x1cgo", " "]
    rows = [*odd] + [(100 + i, " ".join(random.choice(words) for _ in range(random.choice([1, 30, 500, 6000])))) for i in range(60)]
    got = packing.packed(docs_of(rows).repartition(3)).collect()
    ids, pieces, sequences = {}, {}, {}
    for i, t in rows:
        ids.setdefault(i, []).append([*own.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for i, rs in pieces.items():
        # Rows that repeat are documents of their own, so each id is covered as often as there are rows.
        assert sorted({(r["doc_tokens"], k) for r in rs for k in range(r["start"], r["start"] + r["length"])}) == sorted({(len(x), k) for x in ids[i] for k in range(len(x))})
        assert sum(r["length"] for r in rs) == sum(map(len, ids[i]))
        for r in rs:
            part = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4") for x in ids[i] if len(x) == r["doc_tokens"]]
            assert r["ids_crc32"] in [zlib.crc32(p.tobytes()) for p in part]
    lack = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and {r["sequence_tokens"] for r in rs} == {at}
        lack += 4096 - at if at & (at - 1) else 0
    assert lack < 0.02 * sum(r["length"] for r in got)
    assert packing.packed(docs_of(rows).limit(0)).collect() == []


def test_packing_groups():
    """Items of awkward sizes: every token once, near-equal windows, little padding."""
    for sizes in ([2100] * 1100, [4000, 500] * 500, [3000] * 800, [1] * 300_000, [4096] * 5, [8193, 1, 4095] * 200):
        packer = packing.Packer(0, 4096)
        for i, n in enumerate(sizes):
            packer.add(i, np.full(n, i, np.uint32))
        packer.flush(end=True)
        loads, got = {}, Counter()
        for doc, _, n, _, _, sequence, offset, load in packer.rows:
            got[doc] += n
            loads[sequence] = load
            assert offset + n <= load <= 4096
        assert got == dict(enumerate(sizes))
        assert sum(4096 - x for x in loads.values() if x & (x - 1)) <= 0.02 * sum(sizes)


def test_frequent_words_are_encoded_once(monkeypatch):
    """Words that come back stay known when rare ones fill a worker's memory; closing punctuation of any kind is a word of its own."""
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    path = packing.default_tokenizer()
    own, learned = packing.WordIds(path), Counter()
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: (learned.update(words), learn(words))[1])
    monkeypatch.setitem(packing._tokenizers, path, own)
    for k in range(12):
        rare = [f"{chr(97 + i)}q{chr(97 + k)}x" for i in range(20)]
        texts = [" ".join(f"{w}{'***' if i % 3 else ''}" for i, w in enumerate(["the", "É", "of", "naïve", "ΣΑΣ", "and", "e\u0301", *rare])), "a\u00a0b\u3000 \u0301x the%%% l'est' don't. <|x|>&"]
        got = packing.token_ids(pa.array(texts), path)
        want = [[*own.own.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
        assert [x.tolist() for x in got] == want
    assert learned["the"] == learned["of"] == learned["***"] == 1 and not any("*" in w and w.strip("*") for w in learned)


def test_word_ids_are_the_tokenizers():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    import public_tokenizers

    letters = "abİIıΣςσ'’.,;:!?-<|>़फजढक١2é\u0301\u0308\u0307ßⒶ中。😀ﬁǅ \t\n\x1c\u3000"
    texts = st.lists(st.one_of(st.text(sorted(set(letters)), max_size=30), st.text(st.characters(exclude_categories=["Cs"]), max_size=20), st.sampled_from(["<|endoftext|>.", "don't!", "फ़?", "bİ.", "ढ़!"])), max_size=8).map(" ".join)

    def check(path, own):
        @settings(max_examples=300, deadline=None, derandomize=True)
        @given(st.lists(texts, max_size=5))
        def same(every):
            got = packing.token_ids(pa.array(every, pa.string()), path)
            assert [x.tolist() for x in got] == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in every]

        same()

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        check(public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name)))


def test_differencing():
    parts = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for p in parts for i in p) == list(range(5)) and sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_sharding(docs_of, odd):
    rows = [*odd, *((100 + i, "z" * random.Random(i).randint(0, 400)) for i in range(300)), *((7777, "q" * 700) for _ in range(9)), *((7777, "r" * 300) for _ in range(4))]
    got = sharding.sharded(docs_of(rows), limit=1000).collect()
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in got), key=key) == sorted(((i, len((t or "").encode())) for i, t in rows), key=key)
    load = Counter()
    for r in got:
        load[r["shard"], r["page"]] += r["n_bytes"]
        bits = format(int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16), "060b")
        assert bits.startswith(r["shard"]) and len(r["shard"]) == r["depth"]
    over = [k for k, n in load.items() if n > 1000]
    assert {r["doc_id"] for r in got if (r["shard"], r["page"]) in over} == {6}
    names = {s for s, _ in load}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.sharded(docs_of(rows).limit(0)).collect() == []


def test_shards_hold_every_row_once(docs_of, odd, spark, tmp_path):
    rows = [*odd, *[(50, "y" * 40)] * 25, *[(None, "z" * 30)] * 10, (60, "long " * 100), *((100 + i, "w" * 20) for i in range(40))]
    docs = docs_of(rows)
    sharding.write_shards(docs, str(tmp_path / "shards"), limit=100)
    got = spark.read.option("inferSchema", "false").schema("doc_id long, text string, _shard string, _page long").parquet(str(tmp_path / "shards")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    held = Counter()
    for r in got:
        held[r["_shard"], r["_page"]] += len((r["text"] or "").encode())
    want = Counter()
    for r in sharding.sharded(docs, 100).collect():
        want[r["shard"] or None, r["page"]] += r["n_bytes"]
    assert {k: v for k, v in held.items() if v} == {k: v for k, v in want.items() if v}


def test_chat(spark):
    rows = [
        (1, 0, "user", "How do I join?\nThanks"), (1, 1, "assistant", "Use a key.\nAnd an index."), (1, 2, "user", "On Monday Bob wrote:\n> How  do I JOIN?\n>> deep\nMore please"),
        (1, 3, "user", "> and an index.\n> Use a key.\n> How do I join?\nWhy?"), (1, 300, "assistant", "Because."), (2, 0, None, None), (None, 1, "user", "x"), (3, None, "user", "> x\ny"), (1, 0, "user", "How do I join?\nThanks"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS level")
    got = {(r["conv_id"], r["turn"]): r for r in chat.linked(df).collect()}
    assert len(got) == 8
    assert [(got[1, t]["parent_turn"], got[1, t]["linked"]) for t in (0, 1, 2, 3, 300)] == [(None, False), (0, False), (0, True), (1, True), (3, False)]
    # What nobody has said stays, with its marks.
    assert got[1, 2]["body"] == ">> deep\nMore please" and got[1, 2]["level"] == 2 and got[3, None]["body"] == "> x\ny"
    parts = {(r["conv_id"], r["part"]): r for r in chat.conversations(df).collect()}
    assert parts[1, 0]["parents"] == "0:,1:0,2:0,3:1" and parts[1, 0]["n_linked"] == 2 and parts[1, 1]["parents"] == "300:3" and parts[2, 0]["chat"] == "<||>\n\n" and parts[None, None]["n_messages"] == 1
    assert chat.conversations(df.limit(0)).collect() == []


def test_chat_passages(spark):
    """Quotes that are nested, wrapped anew, in part unknown, very long; many messages of one turn."""
    fox = "The quick brown fox jumps over the lazy dog. And then\nit sleeps for the rest of the day."
    rows = [
        (1, 0, "a", fox), (1, 1, "b", "I saw it."), (1, 2, "a", "Bob wrote\n> the quick brown fox jumps over\n> the  lazy dog. And then it sleeps\n> for the rest of the day.\nReally?"),
        (1, 3, "b", "> I saw it.\n>> The quick brown fox jumps\n>> over the lazy dog.\nSee."), (1, 4, "a", "> I saw it.\n> I did not.\n>\nHm."), (1, 5, "b", "> it sleeps for the rest of the day.\nok"),
        (2, 0, "a", "x y.\n" * 3000), (2, 1, "b", "> x y. x y.\n" * 3000 + "end"), (2, 2, "a", ">\n> \n"), *((3, 0, "a", f"m{k}") for k in range(300)), (3, 1, "b", "> m7\nyes"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["linked"], r["body"], r["level"]) for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == (0, True, "Bob wrote\nReally?", 1)
    assert got[1, 3] == (1, True, "See.", 2)
    assert got[1, 4] == (1, True, "> I did not.\nHm.", 1)
    assert got[1, 5] == (0, True, "ok", 1)
    assert got[2, 1] == (0, True, "end", 1) and got[2, 2] == (1, False, "", 1)
    assert got[3, 1] == (0, True, "yes", 1)


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    random.seed(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [random.choice(["tree", "river", "stone", "cloud", "house", "light"]) for _ in range(random.randint(5, 60))]
        if bad:
            words += random.sample(["grumpwort", "blastnik", "vilefish", "snarkos", "snarkel"], 2)
            random.shuffle(words)
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs_of, labelled, odd):
    rows, labels = labelled
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    docs = docs_of([*rows, *((None if i is None else 10_000 + i, t) for i, t in odd)])
    got = toxicity.scored(docs, known).collect()
    assert len(got) == docs.count()
    truth = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert not any(r["predicted"] for r in got if r["doc_id"] not in truth)
    # Labels of rows that may not be learnt from change nothing.
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(rows), flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 0.05 for r in got if r["doc_id"] in truth)
    kept = toxicity.accepted(docs, known)
    assert kept.columns == docs.columns and kept.where("doc_id < 600").count() == sum(not r["predicted"] for r in got if r["doc_id"] in truth)
    assert [r["score"] for r in toxicity.scored(docs.limit(5), known.limit(0)).collect()] == [0.0] * 5
    assert toxicity.scored(docs.limit(0), known).collect() == []


def test_maxent(docs_of, odd):
    random.seed(6)
    rows = [*odd]
    for i in range(300):
        a, b = random.choice([("north", "wind"), ("south", "rain")])
        rows.append((100 + i, " ".join(random.choice([a, a, b, f"w{random.randint(0, 400)}"]) for _ in range(40))))
    got = maxent.scored(docs_of(rows).repartition(2)).collect()
    words = lambda t: [*(t or "").encode().lower().split(), "end"]
    train = [words(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for x in train for w in x)
    mass = sum(c.values()) + len(c) + 1
    want = Counter()
    for i, t in rows:
        w = words(t)
        want[i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), sum(c.values()), round(sum(math.log10((c[x] + 1) / mass) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in got)
    assert maxent.scored(docs_of(rows).limit(0)).collect() == []


def a_model():
    words = [maxent.END, "a", "bb", "ccc", "dd", "eeee", *(f"w{k}" for k in range(300))]
    counts = [40, 30, 9, 5, 1, 1, *([2] * 200), *([1] * 100)]
    totals = {}
    for w, n in zip(words, counts, strict=True):
        k = int(maxent.cells_of(pa.array([w]))[0])
        a, b = totals.get(k, (0, 0))
        totals[k] = (a + n, b + (n == 1))
    v = maxent.Vocabulary(words, counts, totals)
    w = maxent.Weights(v.total, 1 << 8)
    w.rows += np.random.default_rng(0).normal(size=w.rows.shape).astype(np.float32) * 0.3
    return words, v, w


def test_maxent_is_a_distribution():
    """Over all words of the vocabulary and the unseen outcome of each cell, probabilities sum to one."""
    _, v, w = a_model()
    single = maxent.SINGLES * maxent.SIDE
    cells = [k for k in range(maxent.CELLS) if k >= single or k % maxent.SIDE == 0]
    feature = np.array([77, 0])
    p = np.array([w._log10(np.array([16, k]), feature, np.array([0, 2]))[1] for k in cells])
    assert abs((10**p).sum() - 1) < 1e-4
    inside = Counter()
    for k, x in zip(v.cell, v.inside, strict=True):
        inside[int(k)] += 10**x
    for k, x in inside.items():
        assert abs(x + (v.unseen[k] if k >= single else 0) - 1) < 1e-9


def test_maxent_score_by_hand():
    """A text's score, token by token and level by level in plain numbers."""
    words, v, w = a_model()
    text = "a w7 bb w200 a unheard-of w7"
    _, cell, feature, ends, *_ = v.encode(pa.record_batch({"text": pa.array([text])}))
    got = w.log10(cell, feature, ends)
    low = (1 << 64) - 1

    def mix(kind, a, b=0):
        h = ((a & low) + (kind << 40)) * 0x9E3779B97F4A7C15 & low
        h = (h ^ h >> 31 ^ b & low) * 0xD6E8FEB86659FD93 & low
        return h ^ h >> 32

    tokens = text.split()
    at = [words.index(t) if t in words else None for t in [*tokens, maxent.END]]
    often = [k is not None and v.counts[k] >= maxent.OFTEN for k in at]
    ids = [int(byte_hashes(pa.array([t]))[0]) if o else int(c) // 16 + 1 for t, o, c in zip(tokens, often, cell, strict=False)]
    assert sum(often) > 2
    for i, t in enumerate([*tokens, maxent.END]):
        c = int(v.cell[at[i]]) if at[i] is not None else int(maxent.cells_of(pa.array([t]))[0])
        assert cell[i] == c
        back = [ids[i - k] if i >= k else 0 for k in (1, 2, 3)]
        keys = [mix(1, back[0]), mix(2, back[0], back[1]), mix(3, back[1]), mix(4, back[2])]
        total, first = 0.0, 0
        for level, times in enumerate(maxent.LEVELS):
            before, truth = c // 16 ** (3 - level), c // 16 ** (2 - level) % 16
            z = w.bias[level][before].astype(float)
            for key, share in zip(keys, maxent.SHARES, strict=True):
                n = w.unit * share * times
                z = z + w.rows[first + ((mix(5 + level, key >> 8, before) if level else key) & (n - 1))]
                first += n
            if level < 2 or c >= maxent.SINGLES * 16:
                total += math.log10(math.exp(z[truth]) / sum(math.exp(x) for x in z))
        assert abs(total - got[i]) < 1e-5


def test_maxent_changes_are_averaged_in_a_tree(spark):
    """Means over many tasks, weighted by tokens, whatever the depth of the tree."""
    rng = np.random.default_rng(1)
    total, weight, batches = np.zeros((10, 16)), np.zeros(10), []
    for task in range(300):
        row = np.flatnonzero(rng.random(10) < 0.4)
        used, change = rng.integers(1, 9, len(row)).astype(np.float32), rng.normal(size=(len(row), 16)).astype(np.float16)
        total[row] += used[:, None] * change
        weight[row] += used
        if len(row):
            batches.append(maxent._packed_block(task, 3, row, used, change).to_pylist()[0])
    got = maxent._mean(spark.createDataFrame(batches, maxent._CHANGES), 300).collect()
    assert len(got) == 1 and got[0]["block"] == 3
    row = np.frombuffer(got[0]["row"], np.uint16)
    mean = np.frombuffer(got[0]["change"], np.float16).reshape(-1, 16)
    assert np.abs(mean - (total / weight[:, None])[row]).max() < 0.01 and np.allclose(np.frombuffer(got[0]["used"], np.float32), weight[row])
    assert maxent.scale(0)[0] == maxent.LEAST_UNIT and maxent.scale(10**12)[0] == maxent.MOST_UNIT and maxent.scale(10**9)[1] > maxent.scale(10**6)[1]


def test_label_model_by_hand(spark):
    """EM over a small table of votes, row by row in plain numbers; an accurate voter is told from one that votes at random."""
    random.seed(11)
    size, prior, rounds = 3 + toxicity.PATTERNS, 0.3, 4
    table = Counter()
    for _ in range(2000):
        bad = random.random() < prior
        a = random.random() < (0.9 if bad else 0.02)
        votes = [a, a if random.random() < 0.9 else not a, random.random() < 0.2, *(random.random() < (0.3 if bad else 0.1) for _ in range(toxicity.PATTERNS))]
        table[tuple(votes)] += 1
    rows = [(np.flatnonzero(v).astype(np.uint16).tobytes(), n) for v, n in table.items()]
    model = toxicity.label_model(spark.createDataFrame(rows, "votes binary, n long").repartition(3), prior, size, rounds)
    parent = model.parent.tolist()
    assert sorted(parent)[0] == -1 and parent.count(-1) == 1 and (parent[1] == 0 or parent[0] == 1)

    post = {v: [prior / 10, 0.9, 0.97, 0.99][sum(v[:3])] for v in table}
    first = dict(post)
    for k in range(rounds):
        given = {}
        for c in (0, 1):
            # Later rounds add the start's counts.
            w = {v: n * (post[v] if c else 1 - post[v]) + (toxicity.TRUST * n * (first[v] if c else 1 - first[v]) if k else 0) for v, n in table.items()}
            all_ = sum(w.values())
            for j, i in enumerate(parent):
                yes = sum(x for v, x in w.items() if v[j])
                base = (yes + 0.5) / (all_ + 1)
                for up in (0, 1):
                    rest = {v: x for v, x in w.items() if (v[i] if i >= 0 else 0) == up}
                    given[c, j, up] = (sum(x for v, x in rest.items() if v[j]) + 2 * base) / (sum(rest.values()) + 2)
        for v in table:
            p = [1 - prior, prior]
            for c in (0, 1):
                for j, i in enumerate(parent):
                    p[c] *= given[c, j, int(v[i]) if i >= 0 else 0] if v[j] else 1
            post[v] = p[1] / (p[0] + p[1]) if any(v) else prior / 10
    got = model.posterior(np.array(list(table), bool))
    assert np.abs(got - np.array(list(post.values()))).max() < 1e-6
    gap = model.given[1].mean(axis=1) - model.given[0].mean(axis=1)
    # The start trusts all entries alike, as the lexicon has chosen them for their odds; EM moves the random one away from that.
    assert gap[0] > gap[2]


def test_toxicity_finds_rare_words_among_many_common_ones(spark, docs_of):
    random.seed(8)
    common = ["".join(random.choice("bcdfghjklmnprstvwz") for _ in range(10)) for _ in range(4500)]
    rows, labels = [], []
    for i in range(150):
        bad = i % 2
        rows.append((i, " ".join([*common, *([["grumpwort", "vilefish", "snarkos"][i // 2 % 3]] if bad else [])])))
        labels.append((i, bad))
    # 4,500 words and their beginnings, in every toxic row, are more frequent than any toxic word.
    assert len({f for w in common for f in toxicity.features_of(w)}) > 25_000
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {e.lstrip("=^")[:4] for e in model.entries} == {"grum", "vile", "snar"}


def test_stages_reject_rows_whatever_their_doc_id(spark, docs_of, labelled):
    rows, labels = labelled
    bad = "river grumpwort stone blastnik tree"
    docs = docs_of([*rows, (None, bad), (None, "river stone"), (7000, bad), (7000, "tree stone")])
    kept = toxicity.accepted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.where("doc_id is null or doc_id = 7000").collect()) == [("7000", "tree stone"), ("None", "river stone")]
    bench = spark.createDataFrame([(1, "three words only")], "item_id long, text string")
    docs = docs_of([(None, "Three words, only."), (None, "x"), (1, "three words only"), (1, "y"), (2, None)])
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "y"), ("2", "None"), ("None", "x")]


def test_maxent_batches_read_each_row_once():
    """Rows of one token and shared ones against plain sums; a step is plain Adagrad, and batches are worked out in the same room."""
    rng = np.random.default_rng(2)
    table = rng.normal(size=(5000, maxent.SIDE)).astype(np.float32)
    for rows in (rng.integers(0, 5000, 3000), rng.integers(0, 40, 3000), np.arange(9)[::-1], np.zeros(1, np.int64)):
        used, g = maxent.Used(table, rows.astype(np.int32), "test"), rng.normal(size=(len(rows), maxent.SIDE)).astype(np.float32)
        assert sorted(used.row.tolist()) == np.unique(rows).tolist() and (used.values[used.which] == table[rows]).all()
        want = np.zeros_like(table)
        np.add.at(want, rows, g)
        assert np.allclose(used.sums(g), want[used.row], atol=1e-4) and (used.times == np.bincount(rows, minlength=5000)[used.row]).all()
    assert np.shares_memory(used.values, maxent.Used(table, rows, "test").values)
    n = 3000
    cell, feature, ends = rng.integers(maxent.SINGLES * maxent.SIDE, maxent.CELLS, n), rng.integers(1, 60, n), np.array([0, 1200, n])
    weights = maxent.Weights(np.bincount(cell, minlength=maxent.CELLS), 1 << 8)
    trainer, rows, sums, count = maxent.Trainer(weights), np.zeros(weights.rows.shape), np.full(len(weights.rows), maxent.FIRST), np.zeros(len(weights.rows), int)
    for _ in range(2):
        for (own, before, truth, kinds), bias in zip(weights.features(feature, ends, cell), weights.bias, strict=True):
            z = np.exp(sum(rows[r] for r in kinds) + bias[before])
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(own)), truth] -= 1
            for r in kinds:
                grad = np.zeros_like(rows)
                np.add.at(grad, r, g)
                sums += (grad**2).sum(axis=1) / maxent.SIDE
                rows -= grad * (maxent.RATE / np.sqrt(sums))[:, None]
                count += np.bincount(r, minlength=len(count))
        trainer.step(cell, feature, ends)
    assert np.abs(rows).max() > 0.05 and np.allclose(trainer.w.rows, rows, atol=1e-4) and (trainer.used == count).all() and not weights.rows.any()
