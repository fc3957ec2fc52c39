"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, split only where a bucket is too large.

DataFrame functions only. A document's hash is the first 60 bits of md5(doc_id as text); its shard is the shortest
prefix of it whose documents take at most the byte limit. STEP bits are looked at at a time: the bytes of each prefix of
STEP more bits are summed (with partial sums, so that no bucket meets in one task), and the sums of all shorter
prefixes follow from those. Documents whose prefix is still too large go on to the next STEP bits.

A document over the limit, or documents of the same hash that are over it together, cannot be split by hash: they get
the full 60 bits and overflow pages. Equal rows are interchangeable, so pages are dealt by counting rows of the same
size and hash. A null doc_id has the hash of the empty text; a null text has 0 bytes. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, table

LIMIT = 1 << 20
BITS, STEP = 60, 12


def key_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.shiftright(h, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright(h, {BITS} - depth)")


def directory(ws: Workspace, keys: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows) of the shards of `keys` (h long, n_bytes long). Prefixes of no rows are left out."""
    cells = ws.save(keys.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c")), "hashes")
    found, depth = None, 0
    while True:
        top = min(depth + STEP, BITS)
        sums = cells.groupBy(_prefix(F.col("h"), top).alias("p")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
        # The sum of a prefix at every depth of this step; depth 0 only at the start.
        levels = F.sequence(F.lit(depth + 1 if depth else 0), F.lit(top))
        every = sums.withColumn("depth", F.explode(levels)).groupBy("depth", F.expr(f"shiftright(p, {top} - depth)").alias("prefix")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
        every = every.withColumn("fits", (F.col("b") <= limit) if top < BITS else (F.col("b") <= limit) | (F.col("depth") == BITS))
        # A shard fits and the prefix one bit shorter does not.
        above = every.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        first = depth + 1 if depth else 0
        fitting = every.where("fits").withColumn("parent", F.shiftright("prefix", 1))
        shards = fitting.where(F.col("depth") == first).unionByName(fitting.where(F.col("depth") > first).join(above, ["depth", "parent"], "left_semi").select(fitting.columns))
        shards = ws.save(shards.select("depth", "prefix", F.col("b").alias("shard_bytes"), F.col("c").alias("shard_rows")), f"shards{top}")
        found = shards if found is None else found.unionByName(shards)
        if top == BITS:
            return found
        over = ws.save(every.where((F.col("depth") == top) & ~F.col("fits")).select("prefix"), f"over{top}")
        if over.limit(1).count() == 0:
            return found
        cells = ws.save(cells.join(over, _prefix(F.col("h"), top) == F.col("prefix"), "left_semi"), f"cells{top}")
        depth = top


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, page, shard_bytes) of every row. shard: the prefix bits as a string of 0 and 1."""
    ws = Workspace(docs.sparkSession, "sharding")
    keys = ws.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), key_hash(F.col("doc_id")).alias("h"),
            F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        ),
        "keys",
    )
    shards = directory(ws, keys.select("h", "n_bytes"), limit)
    # Depth of each distinct hash: the shard that is a prefix of it. Depths are few, so each is an equi-join key.
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    tries = keys.groupBy("h").agg(F.count("*").alias("same")).withColumn("depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")))
    named = tries.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)")).join(shards, ["depth", "prefix"])
    named = ws.save(named.select("h", "depth", "prefix", "shard_bytes"), "named")
    over = named.where(F.col("shard_bytes") > limit).select("h", "depth", "prefix", "shard_bytes")
    bits = F.when(F.col("depth") > 0, F.expr("lpad(conv(prefix, 10, 2), depth, '0')")).otherwise("")
    plain = keys.join(named.where(F.col("shard_bytes") <= limit), "h").select(
        "doc_id", "n_bytes", bits.alias("shard"), "depth", F.lit(0).cast("long").alias("page"), "shard_bytes"
    )
    # Rows of one hash and size fill pages of their own, as many a page as fit.
    alike = keys.join(over, "h").groupBy("doc_id", "n_bytes", "h", "depth", "prefix", "shard_bytes").agg(F.count("*").alias("k"))
    a_page = F.greatest(F.lit(1).cast("long"), F.expr(f"{limit} div greatest(n_bytes, 1L)"))
    by_size = alike.groupBy("h", "n_bytes").agg(F.sum("k").alias("k")).withColumn("pages", F.ceil(F.col("k") / a_page))
    # Sizes of one hash, counted once each, in order: the pages before a size's own.
    before = Window.partitionBy("h").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    first = by_size.select("h", "n_bytes", F.coalesce(F.sum("pages").over(before), F.lit(0)).cast("long").alias("first"))
    paged = alike.join(first, ["h", "n_bytes"]).withColumn("i", F.explode(F.expr("sequence(0L, k - 1)")))
    paged = paged.select("doc_id", "n_bytes", bits.alias("shard"), "depth", (F.col("first") + F.floor(F.col("i") / a_page)).cast("long").alias("page"), "shard_bytes")
    return plain.unionByName(paged)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes every row of the documents once, as Parquet, a folder for each shard and page (columns _shard, _page)."""
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    places = sharded(docs, limit).groupBy("doc_id", "n_bytes", "shard", "page").agg(F.count("*").alias("k"))
    # Rows of one doc_id and size that are in several pages are dealt to them by number; all others have one place.
    many = places.groupBy("doc_id", "n_bytes").agg(F.count("*").alias("n"), F.min("shard").alias("_shard"), F.min("page").alias("_page"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").cast("long").alias("_id"), n_bytes.alias("_n"))
    here = (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_n") == F.col("n_bytes"))
    one = rows.join(many.where("n = 1"), here).select("d", "_shard", "_page")
    group = Window.partitionBy("doc_id", "n_bytes")
    spread = places.join(many.where("n > 1").select(F.col("doc_id").alias("m_id"), F.col("n_bytes").alias("m_n")), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("n_bytes") == F.col("m_n")))
    spread = spread.select("doc_id", "n_bytes", F.col("shard").alias("_shard"), F.col("page").alias("_page"), (F.sum("k").over(group.orderBy("page")) - F.col("k")).alias("first"), "k")
    spread = spread.select("*", F.explode(F.expr("sequence(first, first + k - 1)")).alias("at"))
    numbered = rows.join(many.where("n > 1"), here).select("d", "_id", "_n", (F.row_number().over(Window.partitionBy("_id", "_n").orderBy(F.xxhash64("d.text"))) - 1).cast("long").alias("no"))
    several = numbered.join(spread, here & (F.col("no") == F.col("at"))).select("d", "_shard", "_page")
    every = one.unionByName(several).select("d.*", "_shard", "_page")
    every.repartition("_shard", "_page").write.partitionBy("_shard", "_page").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


#: The same shards in SQL, by trying every depth. Overflow pages do not occur in tables without documents over the limit.
ORACLE = f"""
WITH k AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes
  FROM documents),
d AS (SELECT unnest(range(0, 41))::INTEGER AS depth),
s AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM k, d GROUP BY 1, 2),
f AS (
  SELECT k.doc_id, k.n_bytes, k.h, s.depth, s.prefix, s.shard_bytes,
         row_number() OVER (PARTITION BY k.doc_id ORDER BY s.depth) AS r
  FROM k JOIN s ON s.prefix = k.h >> ({BITS} - s.depth) WHERE s.shard_bytes <= {LIMIT})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(ltrim(right(bin(prefix), 64)), depth, '0') END AS shard,
       depth, 0::BIGINT AS page, shard_bytes
FROM f WHERE r = 1
"""
