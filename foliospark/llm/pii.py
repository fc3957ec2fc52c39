"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

DataFrame functions only. Spans are code points, end exclusive. The four base kinds (email, ip, card, phone) are always
kept; further kinds are kept if their score reaches KEEP: `iban` (mod 97 confirms it) and `tel` (a number without a
country code, which only context words lift above the line). Null texts are empty. Every row gives one row.

The expressions are written so that Java's matcher neither recurses (possessive groups) nor tries every place inside a
run (a match can only start where a run starts, or where the last match ended), so very long runs take linear time.
Places of spans are running sums over short folds (`running`), so many spans in one text do not cost the square of their
number. An empty table gives no rows; doc_id is passed on as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import bind
from foliospark.llm.common import table

_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of digits with single separators; shorter ones than 13 digits cannot be cards, and no match starts inside a run.
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
TEL = r"(?<![0-9A-Za-z+().-])\(?[0-9]{2,5}\)?[ ./-][0-9]{2,4}[ .-][0-9]{2,6}(?![0-9A-Za-z])"

#: Scores of a span: by its kind, with a checksum that holds, with a context word within CONTEXT characters before it.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.5, "phone": 0.8, "iban": 0.4, "tel": 0.3}
CHECKED, CONTEXT_BONUS, CONTEXT, KEEP = 0.4, 0.3, 40, 0.6
#: Elements that one fold gathers, characters of a block that texts are cut from, a place behind every text.
RUN, BLOCK, FAR = 128, 512, (1 << 31) - 1
CONTEXT_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|adresse|servidor)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|anruf|appel|llamar)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "tel": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|anruf|appel|llamar)\b",
}
KINDS = ("email", "ip", "card", "phone", "iban", "tel")
BASE = KINDS[:4]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1 of ISO 13616."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = F.split(s, r"\.")
        return F.forall(part, lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        a = F.replace(s, F.lit(" "))
        return F.when(F.length(a).between(15, 34), mod97(a)).otherwise(False)
    if kind == "tel":
        return F.length(_digits(s)).between(7, 12)
    return F.lit(True)


_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "tel": TEL}
#: What a text must have for the pattern to be worth a search.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "tel": r"[0-9][) ./-]+[0-9]"}
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def running(n: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """value(0), combine(value(0), value(1)) and so on, n in all, as ints.

    Arrays are grown over RUN elements only, then over one element a run, so the time does not grow with the square of n
    at any length of a text that a row can hold.
    """
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(zero))
    add = lambda x: lambda a, i: F.concat(a, F.array(combine(last(a), x(i)).cast("int")))
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda k: F.aggregate(F.sequence(k * RUN, F.least(n, (k + 1) * RUN) - 1), none, add(value))
    )
    before = lambda r: F.aggregate(r, F.array(F.lit(zero)).cast("array<int>"), lambda a, x: F.concat(a, F.array(combine(last(a), last(x)).cast("int"))))
    whole = bind(runs, lambda r: bind(before(r), lambda o: F.flatten(F.transform(r, lambda x, k: F.transform(x, lambda y: combine(y, F.get(o, k)))))))
    return F.when(n > 0, whole).otherwise(none)


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind, from the first to the last: struct(kind, start, end, score).

    The pieces between matches give the places: split() and regexp_extract_all() walk the same matches.
    """
    pattern = _PATTERNS[kind]

    def named(found: Column, between: Column, ends: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            gap, end = F.get(between, i), F.get(ends, i)
            near = F.substring(gap, F.greatest(F.length(gap) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))
            good = _confirmed(kind, hit)
            score = F.lit(BASE_SCORE[kind]) + (CHECKED if kind in ("card", "iban") else 0.0) + F.when(near.rlike(CONTEXT_WORDS[kind]), CONTEXT_BONUS).otherwise(0.0)
            score = F.least(score, F.lit(1.0))
            keep = good if kind in BASE else good & (score >= KEEP)
            return F.when(keep, F.struct(F.lit(kind).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"), score.alias("score")))

        return F.filter(F.transform(found, one), lambda s: s.isNotNull()).cast(_SPAN)

    def placed(found: Column, between: Column) -> Column:
        length = lambda i: F.length(F.get(between, i)) + F.length(F.get(found, i))
        return bind(running(F.size(found), length, lambda x, y: x + y, 0), lambda ends: named(found, between, ends))

    spans = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: bind(F.split(text, pattern), lambda between: placed(found, between)))
    needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_NEEDS[kind])
    return F.when(needed, spans).otherwise(F.array().cast(_SPAN))


def _free(kind: str) -> Column:
    """The spans of a further kind that no base span overlaps: in order of their starts, the furthest end before and the nearest start behind tell."""
    pick = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["score"].alias("score"))
    base = F.concat(*(F.transform(F.col(f"_{k}"), pick(False)) for k in BASE))
    both = F.sort_array(F.concat(base, F.transform(F.col(f"_{kind}"), pick(True))))

    def kept(every: Column, ends: Column, starts: Column) -> Column:
        alone = lambda s, i: s["own"] & (F.get(ends, i) <= s["start"]) & (F.get(starts, F.size(every) - 1 - i) >= s["end"])
        one = lambda s, i: F.when(alone(s, i), F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
        return F.filter(F.transform(every, one), lambda s: s.isNotNull()).cast(_SPAN)

    def behind(every: Column) -> Column:
        at = lambda i: F.get(every, F.size(every) - 1 - i)
        return running(F.size(every), lambda i: F.when(at(i)["own"], FAR).otherwise(at(i)["start"]), F.least, FAR)

    def before(every: Column) -> Column:
        return running(F.size(every), lambda i: F.when(F.get(every, i)["own"], 0).otherwise(F.get(every, i)["end"]), F.greatest, 0)

    free = bind(both, lambda every: bind(before(every), lambda ends: bind(behind(every), lambda starts: kept(every, ends, starts))))
    return F.when(F.size(f"_{kind}") == 0, F.col(f"_{kind}")).otherwise(free)


def scan(docs: DataFrame) -> DataFrame:
    """The documents' columns and `_email`, `_ip`, ...: the spans of each kind. A further kind does not repeat what a base span covers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("*", *(spans_of(k, text).alias(f"_{k}") for k in KINDS))
    return found.withColumns({f"_{k}": _free(k) for k in KINDS[4:]})


def _listed(kinds: tuple[str, ...]) -> Column:
    every = F.concat(*(F.col(f"_{k}") for k in kinds))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one, named after the first. Columns as they were; n_chars, if there, follows.

    What stays is cut from blocks of BLOCK characters, so that a place far into a text is not counted from its start.
    """
    text = F.col("text").cast("string")
    found = scan(docs).withColumn("_all", F.sort_array(F.transform(F.concat(*(F.col(f"_{k}") for k in KINDS)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first = lambda k: F.greatest(a - k * BLOCK, F.lit(0))
        part = lambda k: F.substring(F.get(blocks, k), first(k) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - first(k))
        parts = F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), part)
        return F.when(a < b, F.array_join(parts, "")).otherwise("")

    def put_together(blocks: Column, every: Column, ends: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(every, one), ""), cut(blocks, F.get(ends, F.size(ends) - 1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = lambda every: running(F.size(every), lambda i: F.get(every, i)["end"], F.greatest, 0)
    clean = bind(blocks, lambda c: bind(F.col("_all"), lambda every: bind(ends(every), lambda e: put_together(c, every, e))))
    clean = F.when(F.size("_all") > 0, clean).otherwise(text)
    fields = []
    for name in docs.columns:
        if name == "text":
            fields.append(clean.alias("text"))
        elif name == "n_chars":
            fields.append(F.when(F.size("_all") > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            fields.append(F.col(f"`{name}`"))
    return found.select(*fields)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(KINDS).alias("spans")
    )
