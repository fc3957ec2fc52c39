"""Documents from recognised pages to bilingual results. Steps are plans; model calls are written before they are read again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import blocks, pairs, report, translate, verify
from foliospark.sources.settings import TranslatorOptions
from foliospark.streaming import events


@dataclass
class Pipeline:
    """`provider` answers prompts; `work_dir` is a folder that driver and executors share. `reference_mode` reproduces old quirks."""

    provider: translate.Provider
    work_dir: str
    options: TranslatorOptions = field(default_factory=TranslatorOptions)
    templates: translate.Templates = field(default_factory=translate.Templates)
    reference_mode: bool = False

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.work_dir}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _ask(self, units: DataFrame, prompt: Column, kind: str, temperature: float | None = None, context: Column | None = None) -> DataFrame:
        """(unit_id, <kind>) of the units' prompts: cleaned output, or the error in its wire form. Calls are named unit_id/<kind>.

        With `context`, a provider that can is asked block after block.
        """
        o = self.options
        # As many tokens as the kind of answer may take.
        most = F.lit(o.field_tokens if kind == "field" else o.back_tokens) if not kind.startswith("zh") else F.when(F.col("kind") == "short", o.short_tokens).otherwise(o.normal_tokens)
        values = {"temperature": F.lit(o.temperature if temperature is None else temperature), "top_p": F.lit(o.top_p), "top_k": F.lit(o.top_k), "max_tokens": most, "seed": F.lit(o.seed).cast("long")}
        sampling = F.struct(*(v.alias(k) for k, v in values.items())).alias("sampling")
        ordered = context is not None and o.context and hasattr(self.provider, "in_order")
        more = ["doc_id", "page", "seq", "part", "source", context.alias("context")] if ordered else []
        calls = units.select("unit_id", F.concat_ws("/", "unit_id", F.lit(kind)).alias("call"), prompt.alias("prompt"), sampling, *more)
        named = calls.drop("unit_id").withColumnRenamed("call", "unit_id")
        answers = self._written(self.provider.in_order(named) if ordered else self.provider(named), f"answers-{kind}")
        found = answers.select(F.col("unit_id").alias("call"), translate.as_translation(F.col("output"), F.col("error")).alias(kind))
        return calls.select("unit_id", "call").join(found, "call").drop("call")

    def run(self, page_ocr: DataFrame, seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Rows with zh and status. The units that were sent, with the outcome of their checks, are left in checks().

        seen, if given, gets the recognised rows as soon as they are written, before any model is asked.
        """
        t, o = self.templates, self.options
        rows = self._written(blocks.with_figures(blocks.clean_pages(page_ocr, self.reference_mode)), "rows")
        if seen:
            seen(rows)
        links = pairs.cross_page_pairs(rows)
        fields = self._ask(translate.abstract_of(rows).withColumn("unit_id", F.col("doc_id").cast("string")), translate.fill(t.direction, abstract=F.col("abstract")), "field")
        units = translate.units(rows, links, self.reference_mode, o.chunk_size).withColumn("unit_id", F.concat_ws("/", "doc_id", "page", "seq", "part"))
        named = units.join(fields.withColumnRenamed("unit_id", "_doc"), F.col("doc_id").cast("string") == F.col("_doc"), "left")
        field = F.when(F.length("field") > 3, F.col("field")).otherwise(F.lit(translate.DEFAULT_DIRECTION))
        units = self._written(named.withColumn("field", F.when(F.col("field").startswith(translate.ERROR), translate.DEFAULT_DIRECTION).otherwise(field)).drop("_doc"), "asked")
        none, source = F.lit(None).cast("string"), F.col("source")
        wanted = translate.prompt(source, F.col("field"), none, none, t, F.col("kind"))
        earlier = {"prev_en": F.lit(translate.EARLIER[0]), "prev_zh": F.lit(translate.EARLIER[1])}
        context = F.when(F.col("kind") != "short", translate.fill(t.context, direction=F.col("field"), style=t.style, text=source, **earlier))
        done = units.join(self._ask(units, wanted, "zh1", context=context), "unit_id", "left")
        # A long text that is one chunk is taken as it comes.
        trusted = (F.col("kind") == "long") & (F.col("parts") == 1)
        # Cheap checks first: only what they don't settle is sent back to the model, and only what fails there a second time.
        fast = F.lit(o.verify_strategy == "adaptive") & (verify.gate_reason(source, F.col("zh1")) == "accepted") & ~verify.is_audited(source, o.verify_audit_rate)
        open_ = self._written(done.where(~verify.needs_no_check(source, o.verify) & ~trusted).where(~fast), "open")
        open_ = open_.join(self._ask(open_, translate.fill(t.back, text=F.col("zh1")), "back1"), "unit_id", "left")
        again = self._written(open_.where(~verify.back_passes(source, F.col("back1"))).select("unit_id", "source", "field", "kind"), "again")
        second = self._ask(again, wanted, "zh2", o.retry_temperature)
        second = second.join(self._ask(second, translate.fill(t.back, text=F.col("zh2")), "back2"), "unit_id", "left")
        done = done.join(open_.select("unit_id", "back1"), "unit_id", "left").join(second, "unit_id", "left")
        result = verify.outcome(source, F.col("zh1"), F.col("back1"), F.col("zh2"), F.col("back2"), o.verify_strategy, o.verify, o.verify_audit_rate, trusted)
        done = done.withColumn("o", result).select("doc_id", "page", "seq", "part", "kind", "source", F.col("o.final_zh").alias("zh"), (F.col("o.outcome") != "failed").alias("verified"), "o")
        return translate.assemble(rows, links, self._written(done, "units"), self.reference_mode)

    def checks(self, spark: SparkSession) -> DataFrame:
        """Counters of the last run's checks by document."""
        return report.verifier_counts(spark.read.parquet(f"{self.work_dir}/units"), ["doc_id"])

    def events(self, rows: DataFrame) -> DataFrame:
        return events.from_results(rows)

    def markdown(self, rows: DataFrame) -> DataFrame:
        return report.markdown(rows, "doc_id", F.col("doc_id").cast("string"), F.lit("bilingual"))
