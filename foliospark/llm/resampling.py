"""Importance resampling towards a target distribution over hashed n-gram features.

Features are the runs of 1 to `runs` consecutive words; a feature's bucket is the crc32 of its text modulo BUCKETS. A
bucket's gain is the logarithm of how much likelier it is in the target than in the documents, a document's weight the
mean gain of its features, and Gumbel noise from its doc_id turns "the highest scores" into a draw in proportion to the weights.

DataFrame functions only. Higher-order functions make each document's array of buckets; what a document is worth is an
aggregate over lookups in one literal array of BUCKETS gains, so scoring neither explodes nor shuffles. Of the counting
only the buckets' partial totals are shuffled, at most BUCKETS rows a task, and the driver gets BUCKETS totals. Ranks are dealt by ranges of the score.

Null and empty texts have no features and weight 0. A null doc_id draws its noise from `seed:` alone and wins ties.
Rows that repeat a doc_id are documents of their own, of equal noise. Empty targets and empty tables give gains and rows as the formulas say.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import bind
from foliospark.llm.common import Workspace, numbered, table
from foliospark.llm.merkle import CRC_TABLE, crc_sql

BUCKETS = 10_000
RUNS = 1
SEED = 2024
#: Words that a document needs to be drawn, and how many of 100 such documents are drawn.
LEAST_WORDS, PERCENT = 20, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    # On ASCII alone, lower() does the same in one pass over the bytes.
    low = F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(F.translate(own, UPPER, LOWER))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def buckets(words_: Column, runs: int = RUNS) -> Column:
    """The buckets of all features of a document, repeats included."""
    hashed = lambda s: (F.crc32(s.cast("binary")) % BUCKETS).cast("int")
    if runs == 1:
        return F.transform(words_, hashed)

    def every(own: Column) -> Column:
        of = lambda n: F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(0))), lambda _, i: hashed(F.array_join(F.slice(own, i + 1, F.lit(n)), " ")))
        return F.concat(*map(of, range(1, runs + 1)))

    return bind(words_, every)


def totals(found: DataFrame) -> list[int]:
    """How often each bucket occurs in a table with the column `buckets`."""
    counts = found.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    out = [0] * BUCKETS
    for r in counts:
        out[r["b"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(p / q)) of each bucket, with one added to each count."""
    s, t = sum(source), sum(target)
    return [math.floor(1000 * math.log(float(b + 1) * float(s + BUCKETS) / (float(a + 1) * float(t + BUCKETS)))) for a, b in zip(source, target, strict=True)]


def weight(buckets_: Column, gains_: list[int]) -> Column:
    """The mean gain of a document's buckets, rounded down; 0 without any."""
    every = F.split(F.lit(",".join(map(str, gains_))), ",").cast("array<bigint>")  # folded to one literal array
    total = F.aggregate(buckets_, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.element_at(every, b + 1))
    floor = lambda x: F.when(x["n"] > 0, (x["s"] - F.pmod(x["s"], x["n"])) / x["n"]).otherwise(0.0).cast("bigint")
    return bind(F.struct(total.alias("s"), F.greatest(F.size(buckets_), F.lit(1)).cast("bigint").alias("n")), floor)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(`seed:doc_id`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row: rank from 1 for those drawn, null for the others."""
    ws = Workspace(docs.sparkSession, "resampling")
    cut = lambda df, *more: df.select(*more, words(F.col("text")).alias("words"))
    own = cut(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.size("words").cast("bigint").alias("n_words"), buckets(F.col("words"), runs).alias("buckets"))
    own = ws.save(own, "buckets")
    worth = gains(totals(own), totals(cut(target).select(buckets(F.col("words"), runs).alias("buckets"))))
    scored = own.select("doc_id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight(F.col("buckets"), worth).alias("weight"))
    scored = ws.save(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = numbered(ws, scored.where(F.col("n_words") >= least_words), [-F.col("score"), F.col("doc_id"), F.col("n_features")])
    rank = F.when(F.col("rank") < F.floor(F.col("of") * percent / 100), F.col("rank") + 1)
    ranked = able.withColumn("rank", rank).drop("of")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """The rows of the documents that are drawn, with all their columns; of rows that share a doc_id all come if one is drawn, null ones never."""
    ids = resampled(docs, target, percent, least_words, runs, seed).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same rows in SQL; each distinct word is hashed once.
ORACLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d),
bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
distinct_words AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hashed AS MATERIALIZED (SELECT word, {crc_sql("word", "t")} % {BUCKETS} AS b FROM distinct_words, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT b, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (totals.t + {BUCKETS})::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range(0, {BUCKETS})) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), totals),
sums AS (SELECT r, count(*)::BIGINT AS n, sum(g)::BIGINT AS g FROM dw JOIN hashed USING (word) JOIN gain USING (b) GROUP BY 1),
scored AS (
  SELECT d.r, doc_id, coalesce(n, 0)::BIGINT AS n_features, CAST(CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN sums USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank
FROM scored LEFT JOIN able USING (r)
"""
