"""Titles, chunks, pairs, checks, prompts and the pipeline against cases worked out by hand (FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import chunks, pairs, titles, translate, verify
from foliospark.plans.pipeline import Pipeline
from foliospark.sources.settings import TranslatorOptions

EN = "We evaluate the GPU kernel on 42 tasks [1] and report a 3.5% gain over the strongest baseline."
ZH = "我们在42个任务上评估该GPU内核[1]，相比最强基线提升了3.5%。"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    cases = {
        "a" * 39: True, "a" * 40: False, "We propose a new method for joins over streams.": False, "3.4.2. Cache management for very long contexts": True,
        "12345 apples are sold in the market each day here": True, "Efficient Attention Kernels Under Limited Memory": True, "Efficient Attention Kernels Under Limited Memory.": False,
        "GPU 4090 Benchmarks Under Heavy Sustained Loads": True, "": True,
    }
    assert each(spark, list(cases), titles.is_pseudo_title) == list(cases.values())
    assert each(spark, ["a" * n for n in (199, 200, 500, 501)], titles.route) == ["short", "normal", "normal", "long"]


def test_chunks(spark):
    assert each(spark, ["Aaaa. Bbbb. Cccccccccccc. D.", "e.g. lower stays", "  "], lambda c: chunks.chunks(c, 10)) == [["Aaaa. Bbbb.", "Cccccccccccc.", "D."], ["e.g. lower stays"], ["  "]]


@pytest.mark.parametrize(("zh", "a", "b", "want"), [("甲乙。丙丁。", 2, 2, ("甲乙。", "丙丁。")), ("甲乙。丙丁。", 3, 1, ("甲乙。丙丁。", "")), ("甲乙丙丁", 1, 3, ("甲", "乙丙丁")), ("甲", 0, 0, ("甲", ""))])
def test_divide(spark, zh, a, b, want):
    assert tuple(one(spark, chunks.divide(F.lit(zh), F.lit(a), F.lit(b)))) == want


def rows_of(spark, pages):
    flat = [("d", p, i, k, x) for p, page in enumerate(pages, 1) for i, (k, x) in enumerate(page)]
    return spark.createDataFrame(flat, "doc_id string, page int, seq int, type string, en string")


def found(spark, pages):
    got = pairs.cross_page_pairs(rows_of(spark, pages))
    return sorted((r["page_a"], r["seq_a"], r["page_b"], r["seq_b"]) for r in got.collect())


def test_pairs(spark):
    t = lambda x: ("text", x)
    assert found(spark, [[("title", "Intro"), t("This sentence continues"), ("image", "")], [("header", "h"), t("on the next page."), t("Next.")], [t("starts lower")]]) == [(1, 1, 2, 1)]
    assert found(spark, [[t("aa")], [("image", "")], [t("bb")]]) == [] and found(spark, [[t("a [Non-Text]")], [t("b")]]) == []
    chain = rows_of(spark, [[t("aa")], [t("bb")], [t("cc.")]])
    links = pairs.cross_page_pairs(chain)
    assert [(r["page_a"], r["chain"]) for r in pairs.chains(links).orderBy("page_a").collect()] == [(1, 1), (2, 1)]
    assert [r["page"] for r in pairs.without_consumed(chain, links).collect()] == [1]


def test_similarity(spark):
    for a, b, want in (("a b", "a b", 1.0), ("the cat", "the dog", 0.477778), ("a-b", "a b", 0.4), ("", "x", 0.0)):
        assert one(spark, F.round(verify.similarity(F.lit(a), F.lit(b)), 6)) == want == one(spark, F.round(verify.similarity(F.lit(b), F.lit(a)), 6))
    assert each(spark, ["a" * n for n in (99, 100, 299, 300, 599, 600)], verify.threshold) == [0.50, 0.45, 0.45, 0.40, 0.40, 0.35]


def test_audit(spark):
    assert each(spark, ["alpha", "beta", "gamma", "中文", "", "k1", "k8", "k31", "k35"], verify.audit_bucket) == [5917, 8343, 2845, 1768, 2610, 987, 781, 305, 125]
    assert each(spark, ["alpha", "k1"], verify.is_audited) == [False, True]
    assert one(spark, verify.is_audited(F.lit("k1"), 0.0)) is False and one(spark, verify.is_audited(F.lit("alpha"), 1.7)) is True


def test_gate(spark):
    nine = "快速模型内核任务评估"[:9]
    cases = [
        (EN, ZH, "accepted"), (EN, "  ", "empty_or_error"), (EN, "[ERROR: x]", "empty_or_error"), (EN, "Translation：" + ZH, "label_leak"), (EN[:70], ZH, "short_source"), (EN, ZH * 3, "length_ratio"),
        (EN, "我们在42个", "length_ratio"), (EN, EN + "中", "insufficient_chinese"), (EN, ZH + nine * 3, "repetition"), (EN, ZH.replace("GPU", "图形处理器"), "protected_span_missing"),
        (EN, ZH.replace("42", "四十二"), "protected_span_missing"), (EN, ZH.replace("[1]", ""), "protected_span_missing"), (EN, ZH.replace("GPU", "G PU"), "accepted"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r["x"] for r in df.select("i", verify.gate_reason(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [c for *_, c in cases]


@pytest.mark.parametrize(
    ("en", "zh", "back1", "back2", "strategy", "want"),
    [
        (EN, ZH, "x", "x", "adaptive", ("fast_accepted", ZH, 0)), (EN, "bad", EN, "x", "adaptive", ("passed", "bad", 1)), (EN, "bad", "x", EN, "adaptive", ("retried", "second", 2)),
        (EN, "bad", "", "x", "adaptive", ("failed", "bad", 2)), (EN, ZH, EN, "x", "full", ("passed", ZH, 1)), ("short", "bad", "x", "x", "adaptive", ("passed", "bad", 0)),
    ],
)
def test_outcome(spark, en, zh, back1, back2, strategy, want):
    o = one(spark, verify.outcome(*map(F.lit, (en, zh, back1, "second", back2)), strategy=strategy, rate=0.0))
    assert (o["outcome"], o["final_zh"], o["back_verified"]) == want
    with pytest.raises(ValueError):
        verify.outcome(*[F.lit("")] * 5, strategy="half")


def test_clean_output(spark):
    cases = {"Chinese: 你好\n\nrest": "你好", "\n\n你好\n世界\nEnglish: x": "你好 世界", "---\n\n你好": "你好", "English: hi\n你好": "English: hi 你好", "": ""}
    assert each(spark, list(cases), translate.clean_output) == list(cases.values())
    assert one(spark, translate.direction(F.lit("abc"))) == translate.DEFAULT_DIRECTION


def test_pipeline(spark, tmp_path):
    block = lambda y, x: f"<|det|>text [0,{y},10,{y + 5}]<|/det|>{x}"
    long = "This is a paragraph of some length that certainly is no heading and it goes on"
    pages = [("d", 1, block(0, long)), ("d", 2, block(0, "over the page. ") + "<|det|>title [0,9,9,19]<|/det|>Results")]
    ocr = spark.createDataFrame(pages, "doc_id string, page int, ocr_text string")
    say = translate.CallableProvider(lambda: lambda texts: ["甲乙。丙丁。" for _ in texts])
    rows = Pipeline(say, str(tmp_path)).run(ocr).orderBy("page", "seq").collect()
    assert [(r["page"], r["zh"], r["status"]) for r in rows] == [(1, "甲乙。丙丁。", "translated"), (2, "", "translated"), (2, "Results", "passthrough")]

    def broken():
        def call(texts):
            raise RuntimeError("no model")

        return call

    failed = Pipeline(translate.CallableProvider(broken), str(tmp_path / "b")).run(ocr).where("status = 'error'").collect()
    assert failed and failed[0]["zh"].startswith("[ERROR")
    joint = f"{long} over the page."
    recorded = [("d/1/0/0/zh1", "甲"), ("d/1/0/0/back1", "nothing"), ("d/1/0/0/zh2", "乙丙。丁。"), ("d/1/0/0/back2", joint)]
    p = Pipeline(translate.RecordedProvider(spark.createDataFrame(recorded, "unit_id string, output string")), str(tmp_path / "c"))
    done = p.run(ocr)
    assert [r["zh"] for r in done.where("status = 'translated'").orderBy("page").collect()] == ["乙丙。丁。", ""]
    counts = p.checks(spark).first()
    assert (counts["total"], counts["retried"], counts["fast_rejected"], counts["back_verified"]) == (1, 1, 1, 2)
    assert p.events(done).where("type = 'block_done'").count() == 3 and p.markdown(done).first()["markdown"].count("## Page") == 2


def test_paragraph_over_three_pages_is_translated_whole(spark):
    texts = [f"{x * 50} and goes on" for x in ("a", "b", "c")]
    rows = rows_of(spark, [[("text", x)] for x in texts]).withColumn("passthrough", F.lit(False)).withColumn("zh", F.lit(None).cast("string"))
    links = pairs.cross_page_pairs(rows)
    sent = translate.units(rows, links).collect()
    assert [(r["page"], r["source"]) for r in sent] == [(1, " ".join(texts))]
    answer = spark.createDataFrame([("d", 1, 0, 0, "甲。乙。丙。")], "doc_id string, page int, seq int, part int, zh string")
    got = translate.assemble(rows, links, answer).orderBy("page").collect()
    assert [(r["zh"], r["status"]) for r in got] == [("甲。", "translated"), ("乙。", "translated"), ("丙。", "translated")]
    # The reference's pairs: the third block is never sent.
    assert [r["source"] for r in translate.units(rows, links, reference_mode=True).collect()] == [" ".join(texts[:2])]
    old = translate.assemble(rows, links, answer, reference_mode=True).orderBy("page").collect()
    assert [r["status"] for r in old] == ["translated", "translated", "skipped"]


def test_blocks_are_asked_in_order_with_context_and_sampling(spark, tmp_path):
    import json

    block = lambda y, x: f"<|det|>text [0,{y},10,{y + 5}]<|/det|>{x}"
    texts = [(f"Paragraph {k} has to be long enough to be asked with its context, so it goes on and on " * 4)[:300].strip() + "." for k in "abc"]
    ocr = spark.createDataFrame([(d, 1, "".join(block(100 * i, t) for i, t in enumerate(texts))) for d in ("d", "e")], "doc_id string, page int, ocr_text string")

    def load():
        def model(prompts, sampling):
            # Names what it was asked, so that answers show the prompts; the field is an answer, too.
            return [json.dumps([sampling["temperature"], sampling["top_k"], p.count("甲"), [k for k in "abc" if f"Paragraph {k}" in p], sampling["max_tokens"], sampling.get("seed")]) + "甲" for p in prompts]

        return model

    p = Pipeline(translate.CallableProvider(load), str(tmp_path), TranslatorOptions(seed=7))
    rows = p.run(ocr).orderBy("doc_id", "seq").collect()
    first = {r["unit_id"]: json.loads(r["output"][:-1]) for r in spark.read.parquet(f"{tmp_path}/answers-zh1").collect()}
    for d in ("d", "e"):
        assert [first[f"{d}/1/{k}/0/zh1"] for k in range(3)] == [[0.3, 20, 1, ["a"], 512, 7], [0.3, 20, 2, ["a", "b"], 512, 7], [0.3, 20, 2, ["b", "c"], 512, 7]]
    limits = lambda name: {tuple(json.loads(r["output"][:-1])[4:]) for r in spark.read.parquet(f"{tmp_path}/answers-{name}").collect()}
    assert (limits("back1"), limits("zh2"), limits("field")) == ({(256, 7)}, {(512, 7)}, {(64, 7)})
    again = [json.loads(r["output"][:-1]) for r in spark.read.parquet(f"{tmp_path}/answers-zh2").collect()]
    assert len(again) == 6 and {x[0] for x in again} == {0.05}
    assert [r["verified"] for r in rows] == [False] * 6
    one_by_one = Pipeline(translate.CallableProvider(load), str(tmp_path / "b"), TranslatorOptions(context=False))
    one_by_one.run(ocr)
    assert all(json.loads(r["output"][:-1])[2] == 1 for r in spark.read.parquet(f"{tmp_path}/b/answers-zh1").collect())


def test_a_batch_that_fails_is_asked_prompt_by_prompt(spark):
    def load():
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [f"{len(prompts)} {p}" for p in prompts]

        return model

    ask = lambda rows: sorted(tuple(r) for r in translate.CallableProvider(load)(spark.createDataFrame(rows, "unit_id string, prompt string").coalesce(1)).collect())
    assert ask([("1", "x"), ("2", "y")]) == [("1", "2 x", None), ("2", "2 y", None)]
    assert ask([("1", "x"), ("2", "bad")]) == [("1", "1 x", None), ("2", None, "no")]


def test_cleaned_is_clean_output(spark):
    cases = ["Chinese: 你好\n\nrest", "\n\n你好\n世界\nEnglish: x", "---\n\n你好", "English: hi\n你好", "", "Chinese:\n Chinese: a\nSummary: b\nc"]
    assert each(spark, cases, translate.clean_output) == [translate.cleaned(c) for c in cases]


def test_long_text_of_one_chunk_is_not_checked(spark, tmp_path):
    text = "a" * 260 + " " + "b" * 300
    ocr = spark.createDataFrame([("d", 1, f"<|det|>text [0,0,9,9]<|/det|>{text}")], "doc_id string, page int, ocr_text string")
    p = Pipeline(translate.CallableProvider(lambda: lambda texts: ["x" for _ in texts]), str(tmp_path))
    assert [(r["zh"], r["verified"]) for r in p.run(ocr).collect()] == [("x", True)]
    assert p.checks(spark).first()["passed"] == 1


def test_documents_are_asked_in_step(spark, tmp_path):
    """The n-th units of all documents in one call; each prompt as if the document had been asked alone."""
    log = tmp_path / "calls"
    log.mkdir()
    rows = [(f"d{d}/{k}", f"d{d}", k // 3 + 1, k, 0, f"source {k} of document {d}, long enough for context", f"plain {d} {k}", f"c {translate.EARLIER[0]} | {translate.EARLIER[1]} {d} {k}" if k % 4 else None) for d, n in enumerate((1, 2, 2, 30, 0, 3)) for k in range(n)]
    rows.append(("d0/1b", "d0", 1, 0, 1, "second part", "part", None))
    schema = "unit_id string, doc_id string, page int, seq int, part int, source string, prompt string, context string"

    def load():
        import uuid

        def ask(prompts):
            (log / uuid.uuid4().hex).write_text(str(len(prompts)))
            if any("5" == p.split()[-1] for p in prompts):
                raise ValueError("five")
            return [f"答{p[:200]}" for p in prompts]

        return ask

    earlier, want = {}, {}
    for unit, doc, _, k, part, source, prompt, context in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4])):
        en, zh = earlier.get(doc, ("", ""))
        asked = context.replace(translate.EARLIER[0], en[:300]).replace(translate.EARLIER[1], zh[:300]) if context and len(en) > 30 else prompt
        want[unit] = None if asked.split()[-1] == "5" else f"答{asked[:200]}"
        if want[unit] and not (doc == "d0"):
            earlier[doc] = (source, translate.cleaned(want[unit]))
    calls = spark.createDataFrame(rows, schema).coalesce(1)
    got = translate.CallableProvider(load, most=4).in_order(calls).collect()
    assert {r["unit_id"]: r["output"] for r in got} == want and sum(r["error"] == "five" for r in got) == 1
    sizes = [int(f.read_text()) for f in log.iterdir()]
    assert max(sizes) <= 4 and len(sizes) < len(rows)
