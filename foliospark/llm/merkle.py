"""A Merkle manifest of a dataset: digests of rows, of runs of rows, of groups and of the whole, and proofs for single rows.

A row's leaf is H (lowercase hex sha256) of its fields. Within a group the leaves stand in order; while there are several
nodes, every FANOUT consecutive ones become the H of their digests, and what remains is the group's root. The groups'
roots in turn form a tree of the same kind.

DataFrame functions only. Leaves are numbered within their group by ranges (no group has to fit a task) and gathered in
blocks of FANOUT ** height: fixed-size ordered arrays that sequence, transform, slice and aggregate collapse level by
level. Block roots are the nodes of the next round, until each group has one. Proofs go the other way: each block hands
its nodes the path above. Of a row only its digests, its order and its group are shuffled, never its text.

Any field may be null. Rows that are equal in order and fields are interchangeable; of equal order but other fields the
smaller digest comes first. Null orders and null groups come first. An empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, numbered, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels that a block collapses: 3 ** 6 leaves a block.
HEIGHT = 6


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*map(encoded, fields)))


def collapsed(nodes: Column, height: Column) -> Column:
    """The levels of a block: its nodes, and `height` times the digests of every FANOUT of the level before."""

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda j: digest(F.array_join(F.slice(level, j * FANOUT + 1, FANOUT), "")))

    steps = F.slice(F.sequence(F.lit(1), F.lit(64)), F.lit(1), height)
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, -1)))))


def own_path(levels: Column, place: Column) -> Column:
    """Siblings of a node of a block, level by level: those left of it joined, and those right of it. place: from 0."""

    def step(level: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(FANOUT)), level)).cast("int")
        first, nodes = node - node % FANOUT, F.element_at(levels, level + 1)
        join = lambda start, n: F.array_join(F.slice(nodes, start + 1, n), "")
        return F.struct(join(first, node - first).alias("left"), join(node + 1, first + FANOUT - 1 - node).alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(63)), F.lit(1), F.size(levels) - 1), step)


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_, lambda own, p: digest(F.concat(p["left"], own, p["right"])))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


@dataclass
class Tree:
    """Block tables of a tree, from the leaves up: (g, block, items array<struct<rank, node, about>>, levels, of)."""

    stages: list[DataFrame]
    height: int = HEIGHT

    def roots(self) -> DataFrame:
        """(g, root): the last node of each group."""
        top = self.stages[-1]
        return top.select("g", F.element_at(F.element_at("levels", -1), 1).alias("root"))

    def nodes(self) -> DataFrame:
        """(g, level, idx, node) of all nodes, for a manifest to be kept."""
        out = None
        for s, stage in enumerate(self.stages):
            # The last level of a block is the next stage's first, if there are other blocks; a group of one block has no more to come.
            shown = F.slice("levels", F.lit(1), F.size("levels") - (F.col("of") > FANOUT**self.height).cast("int"))
            level = (stage.where("of > 1") if s else stage).select("g", "block", F.posexplode(shown).alias("l", "nodes")).select("g", "block", "l", F.posexplode("nodes").alias("i", "node"))
            width = F.pow(F.lit(float(FANOUT)), self.height - F.col("l")).cast("long")
            rows = level.select("g", (F.col("l") + s * self.height).alias("level"), (F.col("block") * width + F.col("i")).alias("idx"), "node")
            out = rows if out is None else out.unionByName(rows)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(g, node, about, path, ...) of every leaf; above (g, path, ...): what stands over the group's root."""
        more = [c for c in above.columns if c not in ("g", "path")]
        over = above.withColumn("block", F.lit(0).cast("long"))
        for stage in reversed(self.stages):
            up = over.select(F.col("g").alias("_g"), F.col("block").alias("_b"), F.col("path").alias("_p"), *more)
            joined = stage.join(up, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
            # Paths are made within the block's row, so that its levels aren't copied for each node.
            every = F.transform("items", lambda x, i: F.struct(x["rank"].alias("block"), x["node"].alias("node"), x["about"].alias("about"), F.concat(own_path(F.col("levels"), i), F.col("_p")).alias("path")))
            over = joined.select("g", *more, F.explode(every).alias("x")).select("g", "x.*", *more)
        return over.drop("block")


def tree(ws: Workspace, nodes: DataFrame, height: int = HEIGHT) -> Tree:
    """The tree over nodes (g, rank, of, node, about): rank from 0 within g, of: the nodes of g, about: a struct that stays with a leaf."""
    width = FANOUT**height
    stages = []
    while True:
        needed = sum((F.col("of") > FANOUT**k).cast("int") for k in range(height))
        blocks = nodes.groupBy("g", F.floor(F.col("rank") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "node", "about"))).alias("items"), F.max("of").alias("of"))
        blocks = blocks.select("g", "block", "items", collapsed(F.transform("items", lambda x: x["node"]), needed).alias("levels"), "of")
        stages.append(ws.save(blocks, f"blocks{len(stages)}"))
        if (stages[-1].agg(F.max("of").alias("n")).first()["n"] or 0) <= width:
            return Tree(stages, height)
        root = F.element_at(F.element_at("levels", -1), 1)
        nodes = stages[-1].select("g", F.col("block").alias("rank"), F.ceil(F.col("of") / width).alias("of"), root.alias("node"), F.struct(F.lit(0).alias("none")).alias("about"))


@dataclass
class Manifest:
    """Trees of the groups' rows and of the groups' roots."""

    rows: Tree
    groups: Tree

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.groups.roots().select("root")

    def subroots(self) -> DataFrame:
        """(g, root): a row for each group."""
        return self.rows.roots()

    def proofs(self) -> DataFrame:
        """(g, leaf, <what was kept of the row>, path array<struct<left, right>>, subroot, root) of every row. The path leads from the leaf by way of its group to the root."""
        top = self.groups.roots().select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), "root")
        groups = self.groups.paths(top).select(F.col("about.g").alias("g"), F.col("node").alias("subroot"), "path", "root")
        return self.rows.paths(groups).select("g", F.col("node").alias("leaf"), "about.*", "path", "subroot", "root")


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of a table. keep: columns of the rows that come back with their proofs. height: levels of a block."""
    ws = Workspace(rows.sparkSession, "manifest")
    kept = [v.alias(k) for k, v in (keep or {}).items()] or [F.lit(0).alias("none")]
    leaves = ws.save(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf(*map(F.col, fields)).alias("node"), F.struct(*kept).alias("about")), "leaves")
    own = tree(ws, numbered(ws, leaves, [F.col("o"), F.col("node")], ["g"]).drop("o"), height)
    subroots = own.roots().select(F.lit(0).alias("g"), F.col("g").alias("o"), F.col("root").alias("node"))
    subroots = ws.save(subroots.withColumn("about", F.struct(F.col("o").alias("g"))), "subroots")
    return Manifest(own, tree(ws, numbered(ws, subroots, [F.col("o")]).drop("o"), height))


def verified(proofs: DataFrame, presented: str) -> DataFrame:
    """Proofs with folded_root, to which the leaf in the column `presented` leads, and whether that is the root."""
    return proofs.withColumn("folded_root", folded(F.col(presented), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The leaf of a row as somebody hands it in who deleted line ends where 2 divides the crc32 of doc_id."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    changed = F.when(hit, F.replace(F.col(text).cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col(text).cast("string"))
    return leaf(*(changed if f == text else F.col(f) for f in FIELDS))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = manifest(docs, keep={"doc_id": F.col("doc_id"), "presented": tampered_leaf()})
    return verified(made.proofs(), "presented").select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: crc32 of the bytes of a BLOB b, a table of 256 remainders t: the rule of the polynomial 0xEDB88320.
CRC_TABLE = """SELECT list(list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256)) AS n)"""


def crc_sql(text: str, remainders: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes; `remainders` names a list made by CRC_TABLE."""
    hexes = f"hex(encode({text}))"
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr({hexes}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, {remainders}[(xor(c, b) & 255) + 1])), 4294967295)"


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"

#: The same rows in SQL: level by level up, and from each row its way to the root.
ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
leaves AS (
  SELECT doc_id, source, sha256({" || ".join(_FIELD.format(f) for f in FIELDS)}) AS leaf,
         sha256({" || ".join(_FIELD.format(f if f != "text" else "changed") for f in FIELDS)}) AS presented
  FROM (SELECT *, CASE WHEN {crc_sql("doc_id::VARCHAR", "t")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, crc)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx FROM leaves),
up AS (
  SELECT 0 AS level, source, idx, leaf AS node FROM ranked
  UNION ALL
  SELECT level + 1, source, idx // 3, sha256(string_agg(node, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM up) WHERE n > 1 GROUP BY level, source, idx // 3),
tops AS (SELECT source, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level DESC) AS r FROM up) WHERE r = 1),
above AS (
  SELECT 0 AS level, idx, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY level, idx // 3),
-- The two trees as one: a source's levels, and then those of the sources.
nodes AS MATERIALIZED (
  SELECT level, source, idx, node FROM up JOIN (SELECT source, height FROM tops) h USING (source) WHERE level < height
  UNION ALL SELECT height + a.level, t.source, a.idx, a.node FROM tops t, above a),
depth AS (SELECT source, height, idx AS place, subroot, (SELECT max(level) FROM above) AS rest, (SELECT arg_max(node, level) FROM above) AS root FROM tops),
way AS (
  SELECT r.doc_id, r.idx AS row_idx, r.source, r.leaf, d.subroot, d.root, 0 AS level, d.height, d.height + d.rest AS stop, CASE WHEN d.height = 0 THEN d.place ELSE r.idx END AS idx, d.place, r.presented AS own, '' AS siblings
  FROM ranked r JOIN depth d ON r.source IS NOT DISTINCT FROM d.source
  UNION ALL
  SELECT doc_id, row_idx, source, leaf, subroot, root, level + 1, height, stop, CASE WHEN level + 1 = height THEN place ELSE idx // 3 END, place,
         sha256(coalesce(l, '') || own || coalesce(r, '')), siblings || coalesce(l, '') || coalesce(r, '')
  FROM (SELECT w.*, (SELECT string_agg(n.node, '' ORDER BY n.idx) FROM nodes n WHERE n.level = w.level AND n.source IS NOT DISTINCT FROM w.source AND n.idx // 3 = w.idx // 3 AND n.idx < w.idx) AS l,
               (SELECT string_agg(n.node, '' ORDER BY n.idx) FROM nodes n WHERE n.level = w.level AND n.source IS NOT DISTINCT FROM w.source AND n.idx // 3 = w.idx // 3 AND n.idx > w.idx) AS r
        FROM way w WHERE w.level < w.stop))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, own AS folded_root, own = root AS verified FROM way WHERE level = stop
"""
