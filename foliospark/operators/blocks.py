"""Page text to typed blocks: parsing and the page-level repairs, in the order that clean_pages applies them.

A page is one row with an array of blocks, so every step here is a projection: no shuffle, and a page's order is the
order of its array. Folds carry the last block beside those that are finished.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

BLOCK = "struct<type:string,x1:int,y1:int,x2:int,y2:int,text:string>"

# The markup of recognised pages, block types and their classes, markers of empty blocks.
MARKUP = r"<\|det\|>(\w+)\s*\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]<\|/det\|>(.*?)(?=<\|det\||$)"
HEADER_END = "<|/det|>"
TEXT_TYPES = ("text", "image_caption", "image_footnote")
PASSTHROUGH_TYPES = ("title", "ref_text", "equation", "table", "aside_text", "header", "footer", "algorithm")
HIDDEN_TYPES = ("page_number", "page_footnote")
IMAGE_TYPES = ("image", "chart")
REPORT_TYPES = ("text", "title", "aside_text", "caption")
EMPTY_MARKERS = ("[non-text]", "[non text]", "[none]", "[blank]")
ORPHAN = ("$$", "")
MODEL_SPACE = 1024


def parse(page_text: Column) -> Column:
    """Blocks of marked-up page text. Text before the first marker and malformed headers are lost."""
    head = "(?U)^" + MARKUP.partition("<\\|/det")[0]
    number = lambda m, i: F.regexp_extract(m, head, i).try_cast("int")
    # The whole markup is matched once; what it found is taken apart by its header.
    return F.transform(
        F.regexp_extract_all(page_text, F.lit("(?Usd)" + MARKUP), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, head, 1).alias("type"), number(m, 2).alias("x1"), number(m, 3).alias("y1"), number(m, 4).alias("x2"), number(m, 5).alias("y2"),
            T.strip(F.substring(m, F.locate(HEADER_END, m) + len(HEADER_END), F.length(m))).alias("text"),
        ),
    )


def continues(prev: Column, cur: Column) -> Column:
    """Whether the words of a text block go on with the sentence of the block before it; its place is not looked at."""
    return (
        (prev["type"] == "text") & (cur["type"] == "text") & ~T.is_blank(prev["text"]) & ~T.is_blank(cur["text"])
        & ~T.ends_sentence(prev["text"]) & ~T.starts_upper(cur["text"])
    )


def merge_continuations(blocks: Column) -> Column:
    """Joins a text block to the one before if its sentence goes on and it is close below, or in the next column.

    The box of a merged block is the union, and later blocks are measured against it. Its text ends as its last part
    does, so the words are compared between neighbours beforehand; the fold carries heights and where groups start.
    """

    def step(acc: Column, x: Column) -> Column:
        near = (x["y1"] - acc["y2"]) <= 2.5 * F.greatest(acc["y2"] - acc["y1"], F.lit(10))
        joins = x["goes_on"] & (acc["i"] > 0) & near
        return F.struct(
            (acc["i"] + 1).alias("i"), F.when(joins, F.least(acc["y1"], x["y1"])).otherwise(x["y1"]).alias("y1"), F.when(joins, F.greatest(acc["y2"], x["y2"])).otherwise(x["y2"]).alias("y2"),
            F.when(joins, acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["i"]))).alias("cuts"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("y1"), F.lit(0).alias("y2"), F.array().cast("array<int>").alias("cuts"))

    def one(group: Column) -> Column:
        parts = F.transform(
            group, lambda b, k: F.when((k > 0) & (k < F.size(group) - 1), T.strip(b["text"])).when(k > 0, T.lstrip(b["text"])).when(F.size(group) > 1, T.rstrip(b["text"])).otherwise(b["text"])
        )
        side = lambda f, name: f(F.transform(group, lambda b: b[name])).alias(name)
        return F.struct(F.get(group, 0)["type"].alias("type"), side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2"), F.array_join(parts, " ").alias("text"))

    def merged(own: Column) -> Column:
        marks = F.transform(own, lambda b, i: F.struct(b["y1"].alias("y1"), b["y2"].alias("y2"), F.when(i > 0, continues(F.get(own, i - 1), b)).otherwise(False).alias("goes_on")))
        cuts = F.concat(F.aggregate(marks, start, step, lambda a: a["cuts"]), F.array(F.size(own)))
        cut = lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda at, k: T.bind(F.slice(own, at + 1, F.get(c, k + 1) - at), one))
        return T.bind(cuts, cut)

    return T.bind(blocks, merged)


def drop_repeats(blocks: Column) -> Column:
    """Without blocks that repeat type and stripped text of the block right before."""
    same = lambda a, b: (a["type"] == b["type"]) & (T.strip(a["text"]) == T.strip(b["text"]))
    return T.bind(blocks, lambda own: F.filter(own, lambda b, i: (i == 0) | ~F.coalesce(same(b, F.get(own, i - 1)), F.lit(False))))


def is_empty_marker(text: Column) -> Column:
    low = F.lower(T.strip(text))
    share = F.regexp_count(low, F.lit(r"\[non[- ]text\]")) * F.lit(10.0) / F.greatest(F.length(low), F.lit(1))
    return low.isin(*EMPTY_MARKERS) | (share > 0.5)


def drop_markers(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: ~is_empty_marker(b["text"]))


def drop_fragments(blocks: Column) -> Column:
    """Without short text blocks that the last kept block contains. The fold carries that block's text and the numbers of those that go."""

    def step(acc: Column, b: Column) -> Column:
        own = T.strip(b["text"])
        gone = (b["type"] == "text") & (F.length(own) < 80) & F.coalesce(F.contains(acc["last"], own), F.lit(False))
        return F.struct(
            (acc["i"] + 1).alias("i"), F.when(gone, acc["last"]).otherwise(b["text"]).alias("last"),
            F.when(gone, F.concat(acc["gone"], F.array(acc["i"]))).otherwise(acc["gone"]).alias("gone"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("last"), F.array().cast("array<int>").alias("gone"))
    kept = lambda x: F.when(F.size(x["gone"]) > 0, F.filter(x["own"], lambda b, i: ~F.array_contains(x["gone"], i.cast("int")))).otherwise(x["own"])
    return T.bind(blocks, lambda own: T.bind(F.struct(own.alias("own"), F.aggregate(own, start, step, lambda a: a["gone"]).alias("gone")), kept))


def block_class(kind: Column) -> Column:
    return (
        F.when(kind.isin(*TEXT_TYPES), "text").when(kind.isin(*HIDDEN_TYPES), "hidden").when(kind.isin(*IMAGE_TYPES), "image").otherwise("passthrough")
    )


def ui_passthrough(kind: Column) -> Column:
    """The viewer's rule: what it shows once, untranslated."""
    return kind.isin(*PASSTHROUGH_TYPES) | ~kind.isin(*TEXT_TYPES, "image")


def report_kept(kind: Column, text: Column) -> Column:
    """The page report's rule for blocks worth translating."""
    return kind.isin(*REPORT_TYPES) & (F.length(T.strip(text)) > 3)


def fix_latex(text: Column) -> Column:
    r"""\[ \] become $$, \( \) become $."""
    for old, new in ((r"\[", "$$"), (r"\]", "$$"), (r"\(", "$"), (r"\)", "$")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def merge_equations(rows: Column, schema: str, reference_mode: bool = False) -> Column:
    """Joins an equation that is a lone `$$` or empty to the equation after it; `en` changes, `zh` stays. `schema` is that of the rows.

    In reference mode a lone `$$` that found no equation takes in the next block whatever its type.
    """
    orphan = lambda b: (b["type"] == "equation") & T.strip(b["en"]).isin(*ORPHAN)

    def step(acc: Column, i: Column) -> Column:
        b, following = F.get(rows, i), F.get(rows, i + 1)
        joins = orphan(b) & F.coalesce((following["type"] == "equation") & ~T.strip(following["en"]).isin(*ORPHAN), F.lit(False))
        own = F.when(joins, b.withField("en", F.concat(F.lit("$$\n"), following["en"]))).otherwise(b)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        takes = F.coalesce(orphan(last), F.lit(False))
        if not reference_mode:
            takes = takes & (own["type"] == "equation")
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(last.withField("en", F.concat(last["en"], F.lit("\n"), own["en"]))))
        out = F.when(acc["skip"], acc["out"]).when(takes, grown).otherwise(F.concat(acc["out"], F.array(own)))
        return F.struct(out.alias("out"), (~acc["skip"] & joins).alias("skip"))

    start = F.struct(F.array().cast(schema).alias("out"), F.lit(False).alias("skip"))
    done = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(rows), F.lit(1)) - 1), start, step, lambda a: a["out"])
    # Pages without such an equation stay as they are.
    return F.when(F.exists(rows, orphan), done).otherwise(rows)


ROW = "array<struct<idx:int,type:string,en:string,zh:string,passthrough:boolean,x1:int,y1:int,x2:int,y2:int>>"


def classify(blocks: Column) -> Column:
    """Rows with text and target, formulas marked by dollars; idx counts all blocks of the page, also those that are hidden."""
    rows = F.transform(
        F.transform(blocks, lambda b: b.withField("text", fix_latex(b["text"]))),
        lambda b, i: F.struct(
            i.cast("int").alias("idx"), b["type"].alias("type"), F.when(b["type"].isin(*IMAGE_TYPES), "").otherwise(b["text"]).alias("en"),
            F.when(b["type"].isin(*TEXT_TYPES, *IMAGE_TYPES), "").otherwise(b["text"]).alias("zh"), (~b["type"].isin(*TEXT_TYPES)).alias("passthrough"),
            b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"),
        ),
    )
    return F.filter(rows, lambda r: ~r["type"].isin(*HIDDEN_TYPES)).cast(ROW)


def crop_box(row: Column, width: Column, height: Column) -> Column:
    """Pixels of a box in model space, cut off to whole numbers."""
    scaled = lambda v, side: (v * side / F.lit(float(MODEL_SPACE))).cast("int")
    return F.struct(scaled(row["x1"], width).alias("x1"), scaled(row["y1"], height).alias("y1"), scaled(row["x2"], width).alias("x2"), scaled(row["y2"], height).alias("y2"))


def page_rows(page_ocr: DataFrame, reference_mode: bool = False, *more: str) -> DataFrame:
    """(doc_id, page, r[, more]): the cleaned rows of each page as an array, a projection without a shuffle."""
    steps = page_ocr.select("doc_id", "page", parse(F.col("ocr_text")).alias("b"), *more)
    for step in (merge_continuations, drop_repeats, drop_markers, drop_fragments):
        steps = steps.select("doc_id", "page", step(F.col("b")).alias("b"), *more)
    rows = steps.select("doc_id", "page", classify(F.col("b")).alias("r"), *more)
    cropped = F.filter("r", lambda r: ~r["type"].isin(*IMAGE_TYPES) | ((r["x2"] > r["x1"]) & (r["y2"] > r["y1"])))
    return rows.select("doc_id", "page", cropped.alias("r"), *more).select("doc_id", "page", merge_equations(F.col("r"), ROW, reference_mode).alias("r"), *more)


def exploded(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, <row>) of pages (doc_id, page, r)."""
    return pages.select("doc_id", "page", F.posexplode("r").alias("seq", "r")).select("doc_id", "page", "seq", "r.*")


def clean_pages(page_ocr: DataFrame, reference_mode: bool = False) -> DataFrame:
    """(doc_id, page, seq, idx, type, en, zh, passthrough, x1, y1, x2, y2) of page text (doc_id, page, ocr_text).

    Pages without blocks give no rows. Images without an area are left out, as there is nothing to crop.
    """
    return exploded(page_rows(page_ocr, reference_mode))


def with_figures(rows: DataFrame) -> DataFrame:
    """Rows with the figure_id of image blocks, null for others. Only images are put in order, so text is not shuffled for it."""
    named = figures(rows.where(F.col("type").isin(*IMAGE_TYPES))).select("doc_id", "page", "seq", "figure_id")
    return rows.join(named, ["doc_id", "page", "seq"], "left")


def figure(figures_: DataFrame, doc_id: str, figure_id: str) -> DataFrame:
    """The figure of a document by its name; no row where there is none."""
    return figures_.where((F.col("doc_id").cast("string") == doc_id) & (F.col("figure_id") == figure_id))


def figures(rows: DataFrame) -> DataFrame:
    """Image blocks with their figure names: p, page from 0, f, figures of the document so far."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("page", "seq")
    found = rows.where(F.col("type").isin(*IMAGE_TYPES) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    found = found.withColumn("fig_no", F.row_number().over(order) - 1)
    return found.withColumn("figure_id", F.format_string("p%d_f%d.png", F.col("page") - 1, F.col("fig_no")))
