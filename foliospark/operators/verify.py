"""Checks of translations: structure, deterministic audits, similarity of the back-translation, and the outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.titles import needs_no_check

# Thresholds, limits, patterns of spans that must survive translation.
THRESHOLDS = ((100, 0.50), (300, 0.45), (600, 0.40))
THRESHOLD_LONGEST = 0.35
AUDIT_RATE, AUDIT_BUCKETS = 0.10, 10_000
LEAST_SOURCE, RATIO, LEAST_HAN, HAN_SHARE = 80, (0.20, 1.25), 12, 0.25
LABEL_LEAK = r"(?iU)^(english|chinese|translation|analysis)\s*[:：]"
REPETITION = r"(?d)(.{8,30})\1{2,}"
PROTECTED = (
    r"\$\$.*?\$\$", r"\$[^$\n]+\$", r"\\\(.*?\\\)", r"\\\[.*?\\\]",
    r"\[[^\]\n]{1,80}\]", r"https?://\S+",
    r"\b[A-Z]{2,}(?:[-_][A-Z0-9]+)*\b",
    r"(?<![A-Za-z0-9])\d+(?:\.\d+)?(?:e[+-]?\d+)?%?",
)


def similarity(a: Column, b: Column) -> Column:
    """0.6 of the word sets' overlap and 0.4 of the character trigrams'; 0 if either is empty."""
    padded = lambda s: F.concat(F.lit("  "), F.replace(s, F.lit("-"), F.lit(" ")), F.lit("  "))

    def score(x: Column) -> Column:
        by_word = T.overlap(F.array_distinct(T.words(x["a"])), F.array_distinct(T.words(x["b"])))
        by_gram = T.overlap(T.ngrams(padded(x["a"]), 3), T.ngrams(padded(x["b"]), 3))
        return F.when((x["a"] == "") | (x["b"] == ""), F.lit(0.0)).otherwise(by_word * 0.6 + by_gram * 0.4)

    return T.bind(F.struct(T.strip(F.lower(a)).alias("a"), T.strip(F.lower(b)).alias("b")), score)


def threshold(source: Column) -> Column:
    size = F.length(source)
    out = F.when(size < THRESHOLDS[0][0], THRESHOLDS[0][1])
    for limit, value in THRESHOLDS[1:]:
        out = out.when(size < limit, value)
    return out.otherwise(THRESHOLD_LONGEST)


def back_passes(source: Column, back: Column) -> Column:
    return F.coalesce((back != "") & (similarity(source, back) >= threshold(source)), F.lit(False))


def audit_bucket(source: Column) -> Column:
    return F.conv(F.left(F.sha2(source, 256), F.lit(8)), 16, 10).cast("long") % AUDIT_BUCKETS


def is_audited(source: Column, rate: float = AUDIT_RATE) -> Column:
    rate = min(1.0, max(0.0, rate))
    if rate in (0.0, 1.0):
        return F.lit(rate == 1.0)
    return audit_bucket(source) < round(rate * AUDIT_BUCKETS)


def protected_spans(source: Column) -> Column:
    """All spans of the patterns, white space taken out, empty ones dropped."""
    found = F.concat(*(F.regexp_extract_all(source, F.lit("(?Usd)" + p), F.lit(0)) for p in PROTECTED))
    return F.filter(F.transform(found, T.without_space), lambda s: s != "")


def gate_reason(source: Column, target: Column) -> Column:
    """The first rule that a translation breaks, or `accepted`."""

    def rules(x: Column) -> Column:
        en, zh, compact = x["en"], x["zh"], x["compact"]
        size_zh = F.length(compact)
        ratio, han = size_zh / F.greatest(F.length(T.without_space(en)), F.lit(1)), T.han_count(zh)
        return (
            F.when((zh == "") | zh.startswith("[ERROR"), "empty_or_error")
            .when(zh.rlike(LABEL_LEAK), "label_leak")
            .when(F.length(en) < LEAST_SOURCE, "short_source")
            .when(~ratio.between(*RATIO), "length_ratio")
            .when((han < LEAST_HAN) | (han / F.greatest(size_zh, F.lit(1)) < HAN_SHARE), "insufficient_chinese")
            .when(zh.rlike(REPETITION), "repetition")
            .when(~F.forall(protected_spans(en), lambda s: F.contains(compact, s)), "protected_span_missing")
            .otherwise("accepted")
        )

    return T.bind(F.struct(T.strip(source).alias("en"), T.strip(target).alias("zh"), T.without_space(target).alias("compact")), rules)


def outcome(en: Column, zh1: Column, back1: Column, zh2: Column, back2: Column, strategy: str = "adaptive", verify: bool = True, rate: float = AUDIT_RATE, trusted: Column | None = None) -> Column:
    """struct(outcome, final_zh, gate_reason, audited, fast_accepted, fast_audited, fast_rejected, back_verified) of recorded model outputs. What is `trusted` goes unchecked."""
    if strategy not in ("adaptive", "full"):
        raise ValueError(f"strategy is adaptive or full, not {strategy}")

    def first_look(x: Column) -> Column:
        """Back-translations are compared only where nothing before has settled the row."""
        fine = F.coalesce(x["reason"] == "accepted", F.lit(False))
        fast = ~x["unchecked"] & fine & ~x["audited"]
        first = F.when(x["unchecked"] | fast, False).otherwise(back_passes(en, back1))
        return T.bind(F.struct(*(x[n].alias(n) for n in ("reason", "unchecked", "audited")), fine.alias("fine"), fast.alias("fast"), first.alias("first")), decide)

    def decide(x: Column) -> Column:
        fine, fast, unchecked, audited, first = x["fine"], x["fast"], x["unchecked"], x["audited"], x["first"]
        second = F.when(unchecked | fast | first, False).otherwise(back_passes(en, back2))
        result = F.when(unchecked, "passed").when(fast, "fast_accepted").when(first, "passed").when(second, "retried").otherwise("failed")
        gated = F.lit(strategy == "adaptive") & ~unchecked
        return F.struct(
            result.alias("outcome"), F.when(result == "retried", zh2).otherwise(zh1).alias("final_zh"), F.when(gated, x["reason"]).alias("gate_reason"),
            (gated & fine & audited).alias("audited"), fast.alias("fast_accepted"), (gated & fine & audited).alias("fast_audited"), (gated & ~fine).alias("fast_rejected"),
            F.when(unchecked | fast, 0).when(first, 1).otherwise(2).alias("back_verified"),
        )

    reason = gate_reason(en, zh1) if strategy == "adaptive" else F.lit(None).cast("string")
    seen = F.struct(
        reason.alias("reason"), (needs_no_check(en, verify) | (F.lit(False) if trusted is None else trusted)).alias("unchecked"), is_audited(en, rate).alias("audited")
    )
    return T.bind(seen, first_look)
