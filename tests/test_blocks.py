"""Page steps against cases worked out by hand (FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import blocks as B

BLOCKS = f"array<{B.BLOCK}>"


def run(spark, step, rows):
    df = spark.createDataFrame([([(t, *box, x) for t, box, x in rows],)], f"b {BLOCKS}")
    return [(r["type"], (r["x1"], r["y1"], r["x2"], r["y2"]), r["text"]) for r in df.select(step(F.col("b")).alias("b")).first()["b"]]


def text(y1, y2, x, kind="text"):
    return (kind, (0, y1, 10, y2), x)


PAGE = "noise<|det|>title [10, 20, 300,40]<|/det|>1 Intro\n<|det|>text [10,50,300,90]<|/det|>We study joins and\n<|det|>text [10,95,300,130]<|/det|>their cost.<|det|>text [1,2,3]<|/det|>lost<|det|>page_number [500,990,520,1000]<|/det|>7"


def test_parse(spark):
    got = spark.createDataFrame([(PAGE,), ("",), ("no marker",)], "t string").select(B.parse(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got[0]["b"]] == [
        ("title", 10, 20, 300, 40, "1 Intro"), ("text", 10, 50, 300, 90, "We study joins and"), ("text", 10, 95, 300, 130, "their cost."), ("page_number", 500, 990, 520, 1000, "7"),
    ]
    assert got[1]["b"] == [] and got[2]["b"] == []


def test_clean_pages(spark):
    rows = B.clean_pages(spark.createDataFrame([("d", 1, PAGE)], "doc_id string, page int, ocr_text string")).orderBy("seq").collect()
    assert [(r["idx"], r["type"], r["en"], r["zh"], r["passthrough"]) for r in rows] == [(0, "title", "1 Intro", "1 Intro", True), (1, "text", "We study joins and their cost.", "", False)]


@pytest.mark.parametrize(
    ("prev", "cur", "merged"),
    [
        (text(0, 20, "a"), text(70, 80, "and"), True), (text(0, 20, "a"), text(71, 80, "and"), False), (text(0, 2, "a"), text(27, 30, "and"), True), (text(0, 2, "a"), text(28, 30, "and"), False),
        (text(500, 520, "a"), text(10, 20, "and"), True), (text(0, 20, "a"), text(30, 40, "The"), False), (text(0, 20, "a"), text(30, 40, "3 x"), True), (text(0, 20, "a"), text(30, 40, "中"), True),
        (text(0, 20, 'a."'), text(30, 40, "and"), False), (text(0, 20, "a.)"), text(30, 40, "and"), False), (text(0, 20, "a!"), text(30, 40, "and"), False),
        (text(0, 20, 'a?"'), text(30, 40, "and"), True), (text(0, 20, "a!)"), text(30, 40, "and"), True), (text(0, 20, "a", "title"), text(30, 40, "and"), False), (text(0, 20, " "), text(30, 40, "and"), False),
    ],
)
def test_continuation(spark, prev, cur, merged):
    assert len(run(spark, B.merge_continuations, [prev, cur])) == (1 if merged else 2)


def test_merged_box_counts(spark):
    got = run(spark, B.merge_continuations, [text(0, 10, "a"), text(30, 40, "b "), text(130, 140, " c")])
    assert got == [("text", (0, 0, 10, 140), "a b c")]
    assert run(spark, B.merge_continuations, []) == []


def test_repeats_markers_fragments(spark):
    t = lambda *xs: [text(0, 1, x) for x in xs]
    got = run(spark, B.drop_repeats, [*t("A", " A "), text(0, 1, "A", "title"), *t("A")])
    assert [(k, x) for k, _, x in got] == [("text", "A"), ("title", "A"), ("text", "A")]
    kept = run(spark, B.drop_markers, t("[NONE]", " [blank] ", "[Non-Text] [non text]", "[non-text] 123456789", "Figure shows [Non-Text] axes here", ""))
    assert [x for *_, x in kept] == ["[non-text] 123456789", "Figure shows [Non-Text] axes here", ""]
    got = run(spark, B.drop_fragments, [*t("alpha beta gamma", "beta gamma", "alpha", "delta", "alpha"), text(0, 1, "alp", "title"), *t(" ")])
    assert [x for *_, x in got] == ["alpha beta gamma", "delta", "alpha", "alp"]


def equations(spark, rows, mode):
    df = spark.createDataFrame([([(i, k, x, "z", True, 0, 0, 1, 1) for i, (k, x) in enumerate(rows)],)], f"r {B.ROW}")
    return [(r["type"], r["en"], r["zh"]) for r in df.select(B.merge_equations(F.col("r"), B.ROW, mode).alias("r")).first()["r"]]


def test_equations(spark):
    assert equations(spark, [("equation", "$$"), ("equation", "x=1$$")], False) == [("equation", "$$\nx=1$$", "z")]
    assert equations(spark, [("equation", ""), ("equation", "y")], True) == [("equation", "$$\ny", "z")]
    mixed = [("equation", "$$"), ("text", "Hello"), ("text", "World")]
    assert [x[:2] for x in equations(spark, mixed, True)] == [("equation", "$$\nHello"), ("text", "World")]
    assert [x[:2] for x in equations(spark, mixed, False)] == mixed
    assert [x[:2] for x in equations(spark, [("equation", "$$"), ("image", ""), ("text", "T")], True)] == [("equation", "$$\n\nT")]
    assert equations(spark, [], False) == []


def test_formulas_are_marked_before_equations_are_merged(spark):
    page = "<|det|>equation [0,0,9,9]<|/det|>\\[<|det|>equation [0,10,9,19]<|/det|>x=1 \\]<|det|>image [5,5,5,9]<|/det|><|det|>title [0,20,9,29]<|/det|>T<|det|>image [5,5,6,9]<|/det|>"
    for mode in (False, True):
        rows = B.clean_pages(spark.createDataFrame([("d", 1, page)], "doc_id string, page int, ocr_text string"), mode)
        assert [(r["type"], r["en"], r["figure_id"]) for r in B.with_figures(rows).orderBy("seq").collect()] == [("equation", "$$\nx=1 $$", None), ("title", "T", None), ("image", "", "p0_f0.png")]
        assert B.figure(B.figures(rows), "d", "p0_f0.png").count() == 1 and B.figure(B.figures(rows), "d", "p0_f9.png").count() == 0


def test_classes_latex_crop(spark):
    kinds = ["text", "image_caption", "title", "sidebar_x", "page_number", "image", "chart"]
    df = spark.createDataFrame([([(k, 100, 200, 300, 400, "x") for k in kinds],)], f"b {BLOCKS}")
    rows = df.select(B.classify(F.col("b")).alias("r")).first()["r"]
    assert [(r["idx"], r["type"], r["en"], r["zh"], r["passthrough"]) for r in rows] == [
        (0, "text", "x", "", False), (1, "image_caption", "x", "", False), (2, "title", "x", "x", True), (3, "sidebar_x", "x", "x", True), (5, "image", "", "", True), (6, "chart", "", "", True),
    ]
    one = spark.range(1).select(
        B.fix_latex(F.lit(r"\(x\) and \[y\]")).alias("l"), B.crop_box({"x1": F.lit(100), "y1": F.lit(200), "x2": F.lit(300), "y2": F.lit(400)}, F.lit(1224), F.lit(1584)).alias("c")
    ).first()
    assert one["l"] == "$x$ and $$y$$" and tuple(one["c"]) == (119, 309, 358, 618)
