"""Chat formatting by quotation linking: quotes are traced to the message they are from, then taken out.

DataFrame functions only. A line is quoted if `>` is its first mark; its level is the number of `>` before its text. Lines
of one level that follow one another are a run. The passages of a run are its lines and its sentences, the latter with
lines joined, so that a quote that was wrapped anew has the same; both are normalised (lower case, single spaces) and
hashed. Hashes of quoted passages are joined to the first message of the conversation that says the passage itself.

A message's parent is the earlier message with the lowest quote level, then the most passages, then the latest turn;
without such a quote it is the previous turn (none for the first). A quoted line goes if it, or every sentence of its
run, is said by an earlier message, or if it is blank; what nobody has said stays, with its marks. Attribution lines
("On ... wrote:") go with the quotes.

A conversation is returned in parts of PART consecutive turn numbers, so that a very long one is spread over tasks;
within a part messages are in the order of their turns, which puts every message after its parent. Rows that repeat in
every column are one message. A message without conv_id or turn stands alone (part null, no parent, quotes stay). Null
text or role is the empty text. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import table

PART = 256
QUOTED = r"^[ \t]*>"
PREFIX = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?i)^[ \t]*(?:on|am|le|el) .*(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"


#: Where a sentence ends, and what stands between two of them while they are taken apart.
SENTENCE, MARK = r"([.!?])[ \t]+", "\x01"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 1), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, PREFIX, "")), r"[ \t]+", " "))


def _hash(passage: Column) -> Column:
    return F.md5(passage.cast("binary"))


def _sentences(lines: Column) -> Column:
    """Normalised sentences of normalised lines; a blank line ends a sentence."""
    paragraphs = F.split(F.array_join(F.transform(lines, lambda x: F.when(x == "", MARK).otherwise(x)), " "), MARK)
    marked = F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, SENTENCE, "$1" + MARK), MARK))
    return F.filter(F.transform(F.flatten(marked), F.trim), lambda x: x != "")


def _passages(lines: Column) -> Column:
    return F.array_distinct(F.concat(F.filter(lines, lambda x: x != ""), _sentences(lines)))


_RUN = "array<struct<level:int,lines:array<string>>>"


def _runs(lines: Column) -> tuple[Column, Column]:
    """Where runs of lines of one level (0: own text) start, and, from a column `_starts` of that, the runs."""
    levels = F.transform(lines, _level)
    starts = F.filter(F.transform(levels, lambda x, i: F.when((i == 0) | (x != F.get(levels, i - 1)), i)), lambda i: i.isNotNull())
    size = F.size(lines)
    run = lambda at, k: F.struct(
        F.get(levels, at).alias("level"), F.slice(lines, at + 1, F.coalesce(F.get(F.col("_starts"), k + 1), size) - at).alias("lines")
    )
    return starts, F.transform(F.col("_starts"), run)


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, body, n_quoted, level, parent_turn, linked), a row for each distinct message."""
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    starts, runs = _runs(F.col("_lines"))
    split = base.withColumn("_lines", F.split("text", "\n")).withColumn("_starts", starts).withColumn("runs", runs.cast(_RUN)).drop("_lines", "_starts")
    placed = split.where("conv_id is not null and turn is not null")
    quotes = placed.where(F.col("text").rlike(r"(?m)" + QUOTED))
    quoted = quotes.select("conv_id", "turn", F.explode(F.filter("runs", lambda r: r["level"] > 0)).alias("r"))
    asked = quoted.select("conv_id", "turn", F.col("r.level").alias("level"), F.explode(_passages(F.transform("r.lines", _normal))).alias("p"))
    asked = asked.select("conv_id", "turn", "level", _hash(F.col("p")).alias("hash")).distinct()
    # Only what some message of the conversation quotes; one row for each conversation and passage.
    said = placed.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.filter("runs", lambda r: r["level"] == 0)).alias("r"))
    said = said.select("conv_id", "turn", F.explode(_passages(F.transform("r.lines", _normal))).alias("p"))
    said = said.select("conv_id", "turn", _hash(F.col("p")).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("first"))
    met = asked.join(said, ["conv_id", "hash"]).where("first < turn")
    votes = met.groupBy("conv_id", "turn", "first").agg(F.count("*").alias("n"), F.min("level").alias("level"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("a"), F.col("n").alias("b"), F.col("first").alias("c")))["c"].alias("quoted_turn"))
    # As many hash values as a message quotes passages.
    known = met.groupBy("conv_id", "turn").agg(F.collect_set("hash").alias("known"))

    def rest(r: Column) -> Column:
        """The lines of a run that stay."""
        normal = F.transform(r["lines"], _normal)
        whole = F.forall(_sentences(normal), lambda s: F.array_contains("_known", _hash(s)))
        said_line = lambda x: (_normal(x) == "") | F.array_contains("_known", _hash(_normal(x)))
        attribution = lambda x: (F.size(F.filter("runs", lambda q: q["level"] > 0)) > 0) & x.rlike(ATTRIBUTION)
        return F.when(r["level"] == 0, F.filter(r["lines"], lambda x: ~attribution(x))).when(whole, F.array().cast("array<string>")).otherwise(F.filter(r["lines"], lambda x: ~said_line(x)))

    full = split.join(known, ["conv_id", "turn"], "left").withColumn("_known", F.coalesce("known", F.array().cast("array<string>")))
    body = F.when(F.size("runs") > 1, F.array_join(F.flatten(F.transform("runs", rest)), "\n")).when(F.element_at("runs", 1)["level"] > 0, F.array_join(rest(F.element_at("runs", 1)), "\n")).otherwise(F.col("text"))
    full = full.select(
        "conv_id", "turn", "role", "text", F.regexp_replace(body, r"^[ \t\n]+|[ \t\n]+$", "").alias("body"),
        F.aggregate("runs", F.lit(0), lambda n, r: n + F.when(r["level"] > 0, F.size(r["lines"])).otherwise(0)).cast("long").alias("n_quoted"),
        F.array_max(F.transform("runs", lambda r: r["level"])).cast("long").alias("level"),
    )

    # The previous turn: within PART turn numbers, else the last of the part before.
    turns = placed.select("conv_id", "turn", F.floor(F.col("turn") / PART).cast("long").alias("part")).distinct()
    last = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("last")).withColumn("last", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")))
    before = turns.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn"))).join(last, ["conv_id", "part"])
    before = before.select("conv_id", "turn", F.coalesce("before", "last").alias("before"))
    return (
        full.join(before, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", "text", "body", "n_quoted", "level", F.coalesce("quoted_turn", "before").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("linked"))
    )


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, part, n_messages, n_linked, parents, chat) of each part of a conversation. parents: turn:parent, comma-joined."""
    rows = linked(messages)
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    link = F.concat(F.col("turn").cast("string"), F.lit(":"), F.coalesce(F.col("parent_turn").cast("string"), F.lit("")))
    rows = rows.select("conv_id", "turn", F.floor(F.col("turn") / PART).cast("long").alias("part"), "role", "body", "text", "linked", link.alias("link"), shown.alias("shown"))
    alone = rows.where("conv_id is null or turn is null").select("conv_id", F.lit(None).cast("long").alias("part"), F.lit(1).cast("long").alias("n_messages"), F.lit(0).cast("long").alias("n_linked"), F.lit("").alias("parents"), F.col("shown").alias("chat"))
    parts = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "part").agg(
        F.count("*").alias("n_messages"), F.count_if("linked").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "link", "shown"))).alias("m"),
    )
    return parts.select("conv_id", "part", "n_messages", "n_linked", F.array_join("m.link", ",").alias("parents"), F.array_join("m.shown", "").alias("chat")).unionByName(alone)


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages as they are, but every third turn quotes, wrapped anew, the one two turns before, and something that nobody has said."""
    before = F.lag("text", 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    wrapped = F.regexp_replace(F.regexp_replace(before, r"\n", " "), "(.{30}[^ ]*) ", "$1\n> ")
    quoting = F.concat(F.lit("On Monday Bob wrote:\n> "), wrapped, F.lit("\n>> nobody said so "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    return messages.withColumn("text", F.when((F.col("turn") % 3 == 2) & before.isNotNull(), quoting).otherwise(F.col("text")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def chat_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with quotes put in, since the driver's have none."""
    return conversations(with_quotes(table(spark, sf_dir, "conversations")))


def _sql(messages: str) -> str:
    """The same in SQL over the named table: lines, runs, passages."""
    return rf"""
WITH m AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {messages}
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
l AS (SELECT id, conv_id, turn, i, x[i] AS line FROM (SELECT *, string_split(text, chr(10)) AS x FROM m) t, unnest(range(1, len(x) + 1)) u(i)),
k AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ 	]*((?:>[ 	]?)+)', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(line, '^[ 	]*((?:>[ 	]?)+)', '')), '[ 	]+', ' ', 'g')) AS n FROM l),
c AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM k),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run FROM c),
w AS (SELECT id, conv_id, turn, run, level, string_agg(CASE WHEN n = '' THEN chr(1) ELSE n END, ' ' ORDER BY i) AS joined FROM r GROUP BY ALL),
s AS (SELECT id, conv_id, turn, run, level, trim(unnest(string_split(regexp_replace(joined, '([.!?])[ 	]+', '\1' || chr(1), 'g'), chr(1)))) AS p FROM w),
p AS (SELECT id, conv_id, turn, run, level, p FROM s WHERE p <> '' UNION SELECT id, conv_id, turn, run, level, n FROM r WHERE n <> ''),
o AS (SELECT conv_id, p, min(turn) AS first FROM p WHERE level = 0 GROUP BY 1, 2),
a AS (SELECT a.conv_id, a.turn, a.level, a.p, o.first FROM (SELECT DISTINCT conv_id, turn, level, p FROM p WHERE level > 0) a JOIN o USING (conv_id, p) WHERE o.first < a.turn),
v AS (SELECT conv_id, turn, first, count(*) AS c, min(level) AS level FROM a GROUP BY 1, 2, 3),
f AS (SELECT conv_id, turn, first FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, c DESC, first DESC) = 1),
d AS (SELECT DISTINCT conv_id, turn, p, true AS said FROM a),
g AS (SELECT id, run, bool_and(coalesce(said, false)) AS whole FROM s LEFT JOIN d USING (conv_id, turn, p) WHERE s.p <> '' GROUP BY 1, 2),
q AS (SELECT id, max(level) AS deepest FROM r GROUP BY 1),
b AS (SELECT r.id, string_agg(r.line, chr(10) ORDER BY r.i) AS body FROM r JOIN q USING (id) LEFT JOIN g USING (id, run) LEFT JOIN d ON d.conv_id = r.conv_id AND d.turn = r.turn AND d.p = r.n
      WHERE CASE WHEN level = 0 THEN deepest = 0 OR NOT regexp_matches(line, '(?i)^[ 	]*(on|am|le|el) .*(wrote|schrieb|écrit|escribió)[ 	]*:[ 	]*$')
            ELSE NOT coalesce(whole, true) AND n <> '' AND said IS NULL END GROUP BY 1),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m)),
z AS (SELECT m.*, f.first, coalesce(f.first, t.before) AS parent, regexp_replace(coalesce(b.body, ''), '^[ 	
]+|[ 	
]+$', '', 'g') AS body
      FROM m LEFT JOIN b USING (id) LEFT JOIN t USING (conv_id, turn) LEFT JOIN f USING (conv_id, turn))
SELECT conv_id, CAST(floor(turn / {PART}) AS BIGINT) AS part, count(*) AS n_messages, count(first) AS n_linked,
       string_agg(turn || ':' || coalesce(CAST(parent AS VARCHAR), ''), ',' ORDER BY turn, role, text) AS parents,
       string_agg('<|' || role || '|>' || chr(10) || body || chr(10), '' ORDER BY turn, role, text) AS chat
FROM z GROUP BY 1, 2
"""


ORACLE = _sql("conversations")
QUOTED_ORACLE = _sql(
    r"""(SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 AND t2 IS NOT NULL THEN 'On Monday Bob wrote:' || chr(10) || '> '
  || regexp_replace(replace(t2, chr(10), ' '), '(.{30}[^ ]*) ', '\1' || chr(10) || '> ', 'g') || chr(10) || '>> nobody said so ' || turn || chr(10) || text ELSE text END AS text
  FROM (SELECT *, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS t2 FROM conversations))"""
)
