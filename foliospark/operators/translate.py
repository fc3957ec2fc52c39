"""Translation units, context, prompts, and cleaning of model output; models are providers.

A provider turns (unit_id, prompt) into (unit_id, output, error). Two come with the package: RecordedProvider joins a
table of outputs, CallableProvider runs a function over Arrow batches (a model is loaded once a task). Neither is a
model: rendering, recognition and translation need one to be plugged in.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import chunks as C
from foliospark.operators.titles import CHUNK_SIZE, is_skipped, route


@dataclass(frozen=True)
class Templates:
    """Prompt wording; {direction}, {style}, {text}, {prev_en}, {prev_zh} and {abstract} are filled in."""

    style: str = "Translate into formal, concise academic Chinese. Keep terms consistent; leave formulas, citations, numbers, units, acronyms and names as they are. Add and leave out nothing."
    direction: str = "Name the research field of this abstract in a few Chinese keywords joined by ·. Output the keywords only.\n\n{abstract}\n\nKeywords:"
    short: str = "Field: {direction}\n{style}\n\nTranslate this short text into Chinese. Output the translation only.\n\n{text}\n\nChinese:"
    normal: str = "Field: {direction}\n{style}\n\nTranslate this academic text into Chinese. Output the translation only.\n\n{text}\n\nChinese:"
    context: str = "Field: {direction}\n{style}\n\nFor consistent terms, the text before it:\nEnglish: {prev_en}\nChinese: {prev_zh}\n\nTranslate this academic text into Chinese. Output the translation only.\n\n{text}\n\nChinese:"
    back: str = "Translate this Chinese text into English. Output the translation only.\n\nChinese: {text}\nEnglish:"


#: Characters of an abstract, and of the context on either side; context shorter than the last is not used.
ABSTRACT, CONTEXT, LEAST_CONTEXT = 1500, 300, 30
DEFAULT_DIRECTION = "academic"
ERROR = "[ERROR"


def fill(template: str, **values: Column | str) -> Column:
    """The template with its fields replaced; values are not searched for fields again."""
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        value = values[name]
        parts += [F.lit(before), value if isinstance(value, Column) else F.lit(value)]
    return F.concat(*parts, F.lit(rest))


def prompt(text: Column, direction: Column, prev_en: Column, prev_zh: Column, templates: Templates = Templates(), kind: Column | None = None) -> Column:
    """Short texts have no context; others have the block before, if it is long enough to help. kind: the text's route, where it is a part of a longer one."""
    common = {"direction": direction, "style": templates.style, "text": text}
    with_context = prev_en.isNotNull() & (F.length(prev_en) > LEAST_CONTEXT)
    return (
        F.when((route(text) if kind is None else kind) == "short", fill(templates.short, **common))
        .when(with_context, fill(templates.context, prev_en=F.left(prev_en, F.lit(CONTEXT)), prev_zh=F.left(prev_zh, F.lit(CONTEXT)), **common))
        .otherwise(fill(templates.normal, **common))
    )


def abstract_of(rows: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(doc_id, abstract): the longest text block of the first page that is no heading (is_pseudo_title), the first of equals."""
    from foliospark.operators.titles import is_pseudo_title

    first = rows.where((F.col("page") == 1) & (F.col("type") == "text")).where(~is_pseudo_title(F.col("en"), ascii_only=ascii_only))
    return first.groupBy("doc_id").agg(F.max_by(F.left("en", F.lit(ABSTRACT)), F.struct(F.length("en"), -F.col("seq"))).alias("abstract"))


def with_context(rows: DataFrame) -> DataFrame:
    """Adds prev_en and prev_zh: the last block before that has a translation (recorded in zh) without an error."""
    before = Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("zh").isNotNull() & (F.col("zh") != "") & ~F.col("zh").startswith(ERROR)
    last = F.last(F.when(good, F.struct("en", "zh")), ignorenulls=True).over(before)
    return rows.withColumn("_c", last).withColumns({"prev_en": F.col("_c.en"), "prev_zh": F.col("_c.zh")}).drop("_c")


def history(rows: DataFrame, size: int = 10) -> DataFrame:
    """Adds the last translated blocks before each, at most `size`."""
    before = Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(-size, -1)
    return rows.withColumn("history", F.collect_list(F.struct("en", "zh")).over(before))


def units(rows: DataFrame, pairs: DataFrame, reference_mode: bool = False, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """(doc_id, page, seq, part, kind, parts, source): what is sent to the model, a row a call. Long texts come in parts.

    A paragraph over several pages is sent whole. Reference mode joins its first two blocks only and drops the others.
    """
    from foliospark.operators.pairs import merged, without_consumed

    ahead = merged(pairs, reference_mode).select("doc_id", "page", "seq", F.col("en").alias("joint"))
    open_ = without_consumed(rows.where(~F.col("passthrough")), pairs).join(ahead, ["doc_id", "page", "seq"], "left")
    open_ = open_.withColumn("source", F.coalesce("joint", "en")).where(~T.is_blank(F.col("source"))).where(~is_skipped(F.col("type"), F.col("source")))
    open_ = open_.withColumn("kind", route(F.col("source"), chunk_size=chunk_size))
    every = F.when(F.col("kind") == "long", C.chunks(F.col("source"), chunk_size)).otherwise(F.array("source"))
    open_ = open_.select("doc_id", "page", "seq", "kind", every.alias("every"))
    return open_.select("doc_id", "page", "seq", "kind", F.size("every").alias("parts"), F.posexplode("every").alias("part", "source"))


def assemble(rows: DataFrame, pairs: DataFrame, translated: DataFrame, reference_mode: bool = False) -> DataFrame:
    """Rows with their translations (doc_id, page, seq, part, zh[, verified]): parts joined, joint translations divided between their blocks.

    status: translated, passthrough, skipped or error. verified: whether all parts passed their checks, null for what was not sent.
    """
    from foliospark.operators.pairs import merged

    key = ["doc_id", "page", "seq"]
    checked = F.min("verified") if "verified" in translated.columns else F.lit(None).cast("boolean")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "zh"))), lambda p: p["zh"]), "")
    whole = translated.groupBy(*key).agg(text.alias("out"), checked.alias("checked"))

    def give(acc: Column, x: Column) -> Column:
        """The next block gets its share of what is left."""
        after = acc["size"] - F.length(x["en"])
        d = C.divide(acc["rest"], F.length(x["en"]), after)
        return F.struct(d["zh2"].alias("rest"), after.alias("size"), F.concat(acc["done"], F.array(F.struct(x["page"].alias("page"), x["seq"].alias("seq"), d["zh1"].alias("zh")))).alias("done"))

    size = F.aggregate("parts", F.lit(0), lambda n, x: n + F.length(x["en"]))
    start = F.struct(F.col("out").alias("rest"), size.alias("size"), F.array().cast("array<struct<page:int,seq:int,zh:string>>").alias("done"))
    last = F.col("parts")[F.size("parts") - 1]

    def close(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(last["page"].alias("page"), last["seq"].alias("seq"), acc["rest"].alias("zh"))))

    shares = F.aggregate(F.slice("parts", F.lit(1), F.size("parts") - 1), start, give, close)
    given = merged(pairs, reference_mode).join(whole, key).select("doc_id", "checked", F.explode(shares).alias("s"))
    given = given.select("doc_id", "s.page", "s.seq", F.col("s.zh").alias("share"), F.col("checked").alias("with_first"))
    found = rows.join(whole, key, "left").join(given, key, "left").withColumn("verified", F.coalesce("checked", "with_first"))
    zh = F.coalesce("share", "out")
    status = F.when(F.col("passthrough"), "passthrough").when(zh.startswith(ERROR), "error").when(zh.isNull(), "skipped").otherwise("translated")
    return found.withColumns({"status": status, "zh": F.when(F.col("passthrough"), F.col("zh")).otherwise(F.coalesce(zh, F.col("en")))}).drop("out", "share", "checked", "with_first")


def clean_output(output: Column, labels: bool = True) -> Column:
    """The first paragraph of a model's output. With labels: `Chinese:` is cut off, and `---` and `Summary:` lines go."""
    lines = F.transform(F.split(output, "\n"), T.strip)

    def step(acc: Column, raw: Column) -> Column:
        has = F.size(acc["out"]) > 0
        stops = ((raw == "") & has) | (raw.startswith("English:") & has)
        line = F.when(raw.startswith("Chinese:"), T.strip(F.substring(raw, F.lit(9), F.length(raw)))).otherwise(raw) if labels else raw
        keep = (line != "") & (~line.startswith("---") & ~line.startswith("Summary:") if labels else F.lit(True))
        done = acc["done"] | stops
        return F.struct(done.alias("done"), F.when(~done & keep, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))
    return T.strip(F.aggregate(lines, start, step, lambda a: F.array_join(a["out"], " ")))


def direction(output: Column, default: str = DEFAULT_DIRECTION) -> Column:
    """The field that a model named, if it named one."""
    own = clean_output(output)
    return F.when(F.length(own) > 3, own).otherwise(F.lit(default))


def cleaned(output: str) -> str:
    """clean_output of one string, for models that are asked one prompt after another."""
    kept: list[str] = []
    for line in (own.strip() for own in output.split("\n")):
        if kept and (not line or line.startswith("English:")):
            break
        line = line.removeprefix("Chinese:").strip()
        if line and not line.startswith(("---", "Summary:")):
            kept.append(line)
    return " ".join(kept)


#: Sampling of a call, as a provider gets it.
SAMPLING = "struct<temperature:double,top_p:double,top_k:int,max_tokens:int,seed:bigint>"
#: Where a prompt has the text before it and its translation.
EARLIER = ("\ue000en\ue000", "\ue000zh\ue000")


class Provider(Protocol):
    """(unit_id, prompt[, sampling]) to (unit_id, output, error).

    A provider with `in_order` can also be asked one block after another, with (unit_id, doc_id, page, seq, part, source,
    prompt, context, sampling): context is the prompt with EARLIER in it, null for units that have no context.
    """

    def __call__(self, calls: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RecordedProvider:
    """Outputs from a table (unit_id, output[, error]); a unit without one is an error."""

    outputs: DataFrame

    def __call__(self, calls: DataFrame) -> DataFrame:
        error = F.col("error") if "error" in self.outputs.columns else F.lit(None).cast("string")
        own = self.outputs.select("unit_id", "output", error.alias("error"))
        missing = F.when(F.col("output").isNull() & F.col("error").isNull(), "no recorded output").otherwise(F.col("error"))
        return calls.select("unit_id").join(own, "unit_id", "left").withColumn("error", missing)


@dataclass(frozen=True)
class CallableProvider:
    """load() runs once a task and returns a function from prompts (and sampling, if it takes two arguments) to outputs. Write the result before it is used twice.

    Prompts of one sampling go to the model in batches; a batch that fails is asked prompt by prompt.
    """

    load: Callable[[], Callable[..., list[str]]]
    #: Most prompts of one call when documents are asked in order.
    most: int = 256

    def __call__(self, calls: DataFrame) -> DataFrame:
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = _asker(load())
            for batch in batches:
                got: list[tuple[str | None, str | None]] = [(None, None)] * len(batch)
                for key in sorted(set(batch["key"])):
                    at = [i for i, k in enumerate(batch["key"]) if k == key]
                    for i, x in zip(at, ask([batch["prompt"].iloc[i] for i in at], key), strict=True):
                        got[i] = x
                yield pd.DataFrame({"unit_id": batch["unit_id"], "output": [o for o, _ in got], "error": [e for _, e in got]})

        return calls.select("unit_id", "prompt", _sampling(calls)).mapInPandas(run, "unit_id string, output string, error string")

    def in_order(self, calls: DataFrame) -> DataFrame:
        """The same for units of documents, each asked with the last translated block before its own.

        Documents go in step: rows are sorted by their number within the document, so that the n-th units of all of a
        task's documents go to the model together, at most `most` a call, and a long document holds up no other. What a
        document's next unit needs is kept by document until its last: at most CONTEXT characters on either side.
        """
        load, most = self.load, self.most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = _asker(load())
            kept: dict[str, _Earlier] = {}

            def answers(rows: list) -> list[tuple]:
                prompts = []
                for r in rows:
                    own = kept.setdefault(r.doc_id, _Earlier())
                    own.turn_to((r.page, r.seq))
                    prompts.append(own.filled(r.context) or r.prompt)
                found: dict[int, tuple[str | None, str | None]] = {}
                for key in sorted({r.key for r in rows}):
                    at = [i for i, r in enumerate(rows) if r.key == key]
                    found.update(zip(at, ask([prompts[i] for i in at], key), strict=True))
                for i, r in enumerate(rows):
                    kept[r.doc_id].add(r.source, found[i][0])
                    if r.no == r.of:
                        del kept[r.doc_id]
                return [(r.unit_id, *found[i]) for i, r in enumerate(rows)]

            for batch in batches:
                rows, got, at = list(batch.itertuples(index=False)), [], 0
                while at < len(rows):
                    stop = at + 1
                    while stop < len(rows) and rows[stop].no == rows[at].no and stop - at < most:
                        stop += 1
                    got += answers(rows[at:stop])
                    at = stop
                yield pd.DataFrame(got, columns=["unit_id", "output", "error"])

        whole = Window.partitionBy("doc_id")
        no = F.row_number().over(whole.orderBy("page", "seq", "part")).alias("no")
        own = calls.select("unit_id", "doc_id", "page", "seq", "part", "source", "prompt", "context", _sampling(calls)).repartition("doc_id").select("*", no, F.count("*").over(whole).alias("of"))
        ordered = own.sortWithinPartitions("no", "doc_id").select("unit_id", F.col("doc_id").cast("string").alias("doc_id"), "page", "seq", "source", "prompt", "context", "key", "no", "of")
        return ordered.mapInPandas(run, "unit_id string, output string, error string")


class _Earlier:
    """What a document's next unit is asked with: the last block that was translated whole, and the block that is under way."""

    def __init__(self) -> None:
        self.en = self.zh = self.own_en = self.own_zh = ""
        self.block, self.whole, self.parts = None, True, 0

    def turn_to(self, block: tuple) -> None:
        if block != self.block:
            if self.parts and self.whole:
                self.en, self.zh = self.own_en, self.own_zh
            self.block, self.own_en, self.own_zh, self.whole, self.parts = block, "", "", True, 0

    def filled(self, context: str | None) -> str | None:
        """The context prompt with the text before, if there is enough of it."""
        if not context or len(self.en) <= LEAST_CONTEXT:
            return None
        a, _, rest = context.partition(EARLIER[0])
        b, _, c = rest.partition(EARLIER[1])
        return a + self.en + b + self.zh + c

    def add(self, source: str, output: str | None) -> None:
        if output:
            self.own_en = (self.own_en + (" " if self.parts else "") + source)[:CONTEXT]
            self.own_zh = (self.own_zh + cleaned(output))[:CONTEXT]
        else:
            self.whole = False
        self.parts += 1


def _sampling(calls: DataFrame) -> Column:
    return (F.to_json("sampling") if "sampling" in calls.columns else F.lit("{}")).alias("key")


def _asker(model: Callable[..., list[str]]) -> Callable[[list[str], str], list[tuple[str | None, str | None]]]:
    """(output, error) of each prompt."""
    two = len(inspect.signature(model).parameters) > 1

    def call(prompts: list[str], sampling: str) -> list[str]:
        out = model(prompts, json.loads(sampling)) if two else model(prompts)
        if len(out) != len(prompts):
            raise ValueError(f"{len(out)} outputs for {len(prompts)} prompts")
        return out

    def ask(prompts: list[str], sampling: str) -> list[tuple[str | None, str | None]]:
        try:
            return [(x, None) for x in call(prompts, sampling)]
        except Exception as e:  # a failed call is a result of its own
            return [(None, str(e))] if len(prompts) == 1 else [x for p in prompts for x in ask([p], sampling)]

    return ask


def as_translation(output: Column, error: Column) -> Column:
    """Cleaned output, or the error in its wire form."""
    return F.when(error.isNotNull(), F.concat(F.lit(ERROR + ": "), error, F.lit("]"))).otherwise(clean_output(output))
