"""Sentences, chunks of sentences, and dividing a joint translation between two blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.titles import CHUNK_SIZE


def sentences(text: Column) -> Column:
    """Split at white space after . ! ? and before A-Z; a text without sentences is its own."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z])"), T.strip), lambda s: s != "")
    return T.bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Sentences packed in order: a chunk ends before the sentence that takes it over `size`; joining spaces don't count.

    The fold notes where each chunk starts; strings are joined once.
    """

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s)
        full = (acc["n"] + n > size) & (acc["n"] > 0)
        return F.struct(F.when(full, n).otherwise(acc["n"] + n).alias("n"), (acc["i"] + 1).alias("i"), F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("cuts"))

    def pack(parts: Column) -> Column:
        cuts = F.concat(F.aggregate(parts, start, step, lambda a: a["cuts"]), F.array(F.size(parts)))
        return T.bind(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda at, k: F.array_join(F.slice(parts, at + 1, F.get(c, k + 1) - at), " ")))

    return T.bind(sentences(text), pack)


def divide(joint: Column, first: Column, second: Column) -> Column:
    """struct(zh1, zh2): a joint translation divided in the ratio of the sources' lengths, after a sentence if it has two."""
    total = first + second
    target = F.floor(F.length(joint) * (first / F.greatest(total, F.lit(1)))).cast("int")

    def reach(acc: Column, s: Column) -> Column:
        """Counts sentences until their length reaches the target."""
        more = acc["n"] < acc["target"]
        return F.struct((acc["n"] + F.when(more, F.length(s)).otherwise(0)).alias("n"), (acc["k"] + F.when(more, 1).otherwise(0)).alias("k"), acc["target"].alias("target"))

    def cut(b: Column) -> Column:
        parts, at = b["parts"], b["target"]
        seen = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), at.alias("target")), reach)
        # The first sentence goes first even if the target is 0.
        k = F.greatest(seen["k"], F.lit(1))
        whole = F.struct(F.array_join(F.slice(parts, F.lit(1), k), "").alias("zh1"), F.array_join(F.slice(parts, k + 1, F.greatest(F.size(parts), F.lit(1))), "").alias("zh2"))
        plain = F.struct(F.substring(joint, F.lit(1), at).alias("zh1"), F.substring(joint, at + 1, F.length(joint)).alias("zh2"))
        return F.when((F.size(parts) >= 2) & (seen["n"] >= at), whole).otherwise(plain)

    parts = F.filter(F.split(joint, "(?<=[。！？；\n])"), lambda s: ~T.is_blank(s))
    both = T.bind(F.struct(parts.alias("parts"), target.alias("target")), cut)
    return F.when(total == 0, F.struct(joint.alias("zh1"), F.lit("").alias("zh2"))).otherwise(both)
