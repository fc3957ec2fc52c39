"""A hashed maximum-entropy language model: n-gram and skip features, class-factored softmax, distributed gradients.

P(token | context) = P(super class) P(class | super class) P(cell | class) P(token | cell). The first three are softmaxes
that sum hashed weight rows of the last word, the two before it (skips) and the last two together; every word has hashed
features, however rare it is. The SINGLES most frequent tokens, the end token among them, are classes of their own; all
other words fall into classes by their last bytes and into cells of a class by the hash of the word. P(word | cell) is
from the counts of all training words, with a share for unseen words by Good and Turing (words seen once over all words
of the cell). Unseen words are one outcome per cell, so that the model is a distribution over the training tokens and
those outcomes.

Counts are gathered over all training documents and stay distributed; the HEAD most frequent tokens are broadcast and
the rest is joined by hash. Weight tables and rounds grow with the tokens (`scale`), the tables up to what a worker can
hold. Each document takes part in one round. A task walks its documents by Adagrad from the broadcast weights, and the
changes are averaged row by row, weighted by the tokens that used the row, in a tree of FAN blocks a step.

Documents to learn from: crc32(doc_id as text) mod 7 is not 2; without doc_id, none. Null texts are empty: they have
the end token alone. Each row is a document, also if doc_ids repeat. Without training documents c = N = V = 0.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, byte_hashes, hashed_words, slices, space_words, table

#: Tokens that are broadcast; those with a class of their own; classes by last bytes.
HEAD, SINGLES, SUFFIXES = 1 << 18, 128, 128
SIDE = 16
CELLS = SIDE**3
#: Rows of a weight table, in units, for the last word, the last two, and the two words before the last (skips); of each level.
SHARES, LEVELS = (2, 2, 1, 1), (1, 4, 4)
#: Least and most rows of a unit (57 MB of weights at the most), tokens for each of its rows.
LEAST_UNIT, MOST_UNIT, UNIT_TOKENS = 1 << 12, 1 << 14, 8192
#: Least count of a word that has features of its own; rarer ones share those of their class.
OFTEN = 8
#: Bits of a place within a batch of tokens.
PLACE = 15
BATCH, RATE, FIRST, TASK_TOKENS, BLOCK, FAN = 1 << PLACE, 0.1, 0.1, 1_000_000, 4096, 16
#: Tokens whose features are held at once.
PIECE = 1 << 17
END = ""


def scale(tokens: int) -> tuple[int, int, int]:
    """(rows of a unit, rounds, tokens of a task) for so many training tokens."""
    unit = min(MOST_UNIT, max(LEAST_UNIT, 1 << max(0, tokens // UNIT_TOKENS).bit_length()))
    return unit, max(3, (tokens >> 23).bit_length()), TASK_TOKENS * unit // LEAST_UNIT


def _train() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(False))


def cells_of(words: pa.Array) -> np.ndarray:
    """The cell of each word that has no class of its own."""
    suffix, whole = byte_hashes(pc.utf8_slice_codeunits(words, start=-3)), byte_hashes(words)
    return ((np.uint64(SINGLES) + (suffix >> np.uint64(20)) % np.uint64(SUFFIXES)) * np.uint64(SIDE) + (whole >> np.uint64(40)) % np.uint64(SIDE)).astype(np.int64)


def _mix(kind: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31)) ^ np.asarray(b).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Vocabulary:
    """The head tokens with their counts, classes, and what all classes hold."""

    def __init__(self, words: list[str], counts: list[int], totals: dict[int, tuple[int, int]]) -> None:
        self.words = pa.array(words, pa.string())
        self.counts = np.array(counts, np.int64)
        self.cell = cells_of(self.words)
        singles = list(range(min(SINGLES - 1, len(words))))
        self.end = words.index(END) if END in words else -1
        if self.end >= SINGLES - 1:
            singles.append(self.end)
        by_hash = self.cell[singles]
        self.cell[singles] = np.arange(len(singles)) * SIDE
        self.end_cell = int(self.cell[self.end]) if self.end >= 0 else (SINGLES - 1) * SIDE
        #: Of each cell: its training tokens, and how many of its words were seen once.
        self.total, once = np.zeros(CELLS), np.zeros(CELLS)
        for c, (n, n1) in totals.items():
            self.total[c], once[c] = n, n1
        for i, c in zip(singles, by_hash.tolist(), strict=True):
            self.total[c] -= counts[i]
            self.total[self.cell[i]] = counts[i]
            once[c] -= counts[i] == 1
        self.unseen = np.where(np.arange(CELLS) < SINGLES * SIDE, 0.0, (np.maximum(once, 0) + 0.5) / (np.maximum(self.total, 0) + 1.0))
        with np.errstate(divide="ignore"):
            own = np.log10(np.maximum(self.counts, 1) / np.maximum(self.total[self.cell], 1)) + np.log10(1 - self.unseen[self.cell])
        self.inside = np.where(self.cell < SINGLES * SIDE, 0.0, own)

    def encode(self, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of all tokens, a document's end included: head number (-1: none), cell, feature; then ends, words and their places."""
        codes, ends, words = space_words(part.column("text"), lower=True)
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        tail = known < 0
        cell = np.where(tail, 0, self.cell[np.maximum(known, 0)]) if len(self.counts) else np.zeros(len(known), np.int64)
        cell[tail] = cells_of(words.filter(pa.array(tail)))
        # Small numbers are classes; the words' hash values are as good as never among them.
        feature = cell // SIDE + 1
        own = ~tail & (self.counts[np.maximum(known, 0)] >= OFTEN) if len(self.counts) else ~tail
        feature[own] = byte_hashes(words.filter(pa.array(own))).view(np.int64)
        n = part.num_rows
        place = np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(ends))
        stops = ends[1:] + np.arange(n)
        out = []
        for values, end in ((known, self.end), (cell, self.end_cell), (feature, 0)):
            full = np.empty(len(codes) + n, np.int64)
            full[place], full[stops] = values[codes], end
            out.append(full)
        return (*out, ends + np.arange(n + 1), codes, words, place)


#: Sums of rows by a product.
_ONES = np.ones(SIDE, np.float32)
#: A weight row as one value.
_ROW = np.dtype((np.void, 4 * SIDE))


#: What a batch is worked out in, by name. New arrays of this size come from the system page by page, which takes longer than filling them.
_held: dict[str, np.ndarray] = {}


def _room(name: str, n: int) -> np.ndarray:
    """Rows for up to a batch; what was in them before is lost."""
    if name not in _held:
        _held[name] = np.empty((BATCH, SIDE), np.float32)
    return _held[name][:n]


def _rows(values: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
    """values[at] in the room of that name; every number is in range, so that nothing is copied twice."""
    return values.take(at, axis=0, mode="clip", out=_room(name, len(at)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of values[at] over (values, at): what goes into the softmax, far within what exp can do in single precision."""
    z = _rows(*parts[0], "sum")
    for part in parts[1:]:
        z += _rows(*part, "part")
    return np.clip(z, -60, 60, out=z)


class Used:
    """The distinct rows that a batch's tokens use: first those of one token, which most are, then the others, each in order."""

    def __init__(self, table: np.ndarray, row: np.ndarray, name: str) -> None:
        # Row and place in one number: sorting numbers is faster than sorting places by rows.
        both = np.sort((row.astype(np.int64) << PLACE) | np.arange(len(row)))
        order, ordered = both & (BATCH - 1), both >> PLACE
        new = ordered[1:] != ordered[:-1]
        first = np.append(True, new)
        lone = first & np.append(new, True)
        many = ~lone
        self.lone, self.shared, first = order[lone], order[many], first[many]
        #: Where the tokens of each shared row begin.
        self.first = np.flatnonzero(first)
        n = len(self.lone)
        self.row = np.concatenate([ordered[lone], ordered[many][self.first]])
        self.times = np.ones(len(self.row), np.int32)
        self.times[n:] = np.diff(self.first, append=len(self.shared))
        self.which = np.empty(len(order), np.intp)
        self.which[self.lone] = np.arange(n)
        self.which[self.shared] = n - 1 + np.cumsum(first)
        # Read once and in order; tokens then find their rows within what a cache holds.
        self.values = _rows(table, self.row, name)

    def sums(self, g: np.ndarray) -> np.ndarray:
        """Of each distinct row: the sum of its tokens' rows of g."""
        out, n = _room("sums", len(self.row)), len(self.lone)
        g.take(self.lone, axis=0, mode="clip", out=out[:n])
        if len(self.first):
            # Two numbers at a time: the sums of real and imaginary parts are apart.
            np.add.reduceat(_rows(g, self.shared, "part").view(np.complex64), self.first, axis=0, out=out[n:].view(np.complex64))
        return out


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about PIECE tokens: (first document, end)."""
    at = 0
    while at < len(ends) - 1:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
        yield at, end
        at = end


class Weights:
    """Weight rows of the three levels; level k + 1 is keyed by what level k has chosen."""

    def __init__(self, total: np.ndarray, unit: int) -> None:
        self.unit, self.bias = unit, []
        for level in range(3):
            c = np.maximum(total, 0).reshape(SIDE**level, SIDE, -1).sum(axis=2) + 0.5
            self.bias.append(np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32))
        self.rows = np.zeros((unit * sum(SHARES) * sum(LEVELS), SIDE), np.float32)

    def features(self, feature: np.ndarray, ends: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of each level: the tokens that it decides on, what is chosen before it, the truth, and the weight rows of each kind."""
        within = np.arange(len(feature)) - np.repeat(ends[:-1], np.diff(ends))
        back = []
        for k in (1, 2, 3):
            p = np.zeros(len(feature), np.int64)
            p[k:] = feature[:-k]
            p[within < k] = 0
            back.append(p)
        keys = [_mix(1, back[0]), _mix(2, back[0], back[1]), _mix(3, back[1]), _mix(4, back[2])]
        at = 0
        for level, times in enumerate(LEVELS):
            # Tokens with a class of their own have no cells.
            own = np.flatnonzero(cell >= SINGLES * SIDE) if level == 2 else np.arange(len(cell))
            before = cell[own] // SIDE ** (3 - level)
            rows = []
            for key, share in zip(keys, SHARES, strict=True):
                mixed = _mix(5 + level, key[own] >> np.uint64(8), before) if level else key[own]
                n = self.unit * share * times
                rows.append((mixed & np.uint64(n - 1)).astype(np.int32) + np.int32(at))
                at += n
            yield own, before, cell[own] // SIDE ** (2 - level) % SIDE, rows

    def log10(self, cell: np.ndarray, feature: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's cell."""
        return np.concatenate([np.zeros(0), *(self._log10(cell[ends[i] : ends[j]], feature[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) for i, j in _pieces(ends))])

    def _log10(self, cell: np.ndarray, feature: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell))
        for (own, before, truth, rows), bias in zip(self.features(feature, ends, cell), self.bias, strict=True):
            for at in range(0, len(own), BATCH):
                cut = slice(at, at + BATCH)
                z = _summed([*((self.rows, r[cut]) for r in rows), (bias, before[cut])])
                right = z[np.arange(len(z)), truth[cut]]
                np.exp(z, out=z)
                out[own[cut]] += (right - np.log(z @ _ONES)) / np.log(10)
        return out


class Trainer:
    """Adagrad over the tokens of one task; `used` counts the tokens of each row."""

    def __init__(self, weights: Weights) -> None:
        self.start, self.w = weights.rows, copy.copy(weights)
        self.w.rows = weights.rows.copy()
        #: Mean squares of a row's gradients so far, summed.
        self.sum = np.full(len(self.w.rows), FIRST, np.float32)
        self.used = np.zeros(len(self.w.rows), np.int32)

    def step(self, cell: np.ndarray, feature: np.ndarray, ends: np.ndarray) -> None:
        for (own, before, truth, rows), bias in zip(self.w.features(feature, ends, cell), self.w.bias, strict=True):
            for at in range(0, len(own), BATCH):
                cut = slice(at, at + BATCH)
                # Kinds and levels have rows of their own, so what is read here is as it was until it is written.
                used = [Used(self.w.rows, r[cut], f"values {k}") for k, r in enumerate(rows)]
                g = _summed([*((u.values, u.which) for u in used), (bias, before[cut])])
                np.exp(g, out=g)
                g /= (g @ _ONES)[:, None]
                g[np.arange(len(g)), truth[cut]] -= 1
                for u in used:
                    grad = u.sums(g)
                    square = self.sum[u.row] + np.einsum("ij,ij->i", grad, grad) / SIDE
                    self.sum[u.row] = square
                    grad *= (RATE / np.sqrt(square))[:, None]
                    # A row is copied whole.
                    self.w.rows.view(_ROW)[u.row] = np.subtract(u.values, grad, out=grad).view(_ROW)
                    self.used[u.row] += u.times

    def changes(self, task: int) -> Iterator[pa.RecordBatch]:
        """For each block of rows: the numbers of the rows that were used, how often, and their changes times that."""
        for block, at in enumerate(range(0, len(self.used), BLOCK)):
            row = np.flatnonzero(self.used[at : at + BLOCK])
            if len(row):
                change = self.w.rows[at + row] - self.start[at + row]
                yield _packed_block(task, block, row, self.used[at + row].astype(np.float32), change)


_CHANGES = "task long, block int, row binary, used binary, change binary"


def _packed_block(task: int, block: int, row: np.ndarray, used: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """Mean changes are small, so half precision holds them."""
    data = {"row": row.astype(np.uint16), "used": used.astype(np.float32), "change": change.astype(np.float16)}
    return pa.record_batch({"task": pa.array([task]), "block": pa.array([block], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in data.items()})


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each row over FAN tasks, weighted by its tokens; rows are sorted by task and block."""

    def closed(key: tuple, total: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        row = np.flatnonzero(weight)
        return _packed_block(*key, row, weight[row], total[row] / weight[row, None])

    key, total, weight = None, np.zeros((BLOCK, SIDE)), np.zeros(BLOCK)
    for batch in batches:
        for task, block, row, used, change in zip(*(batch.column(c).to_pylist() for c in ("task", "block", "row", "used", "change")), strict=True):
            if key != (task // FAN, block):
                if key:
                    yield closed(key, total, weight)
                key, total, weight = (task // FAN, block), np.zeros((BLOCK, SIDE)), np.zeros(BLOCK)
            row, used = np.frombuffer(row, np.uint16), np.frombuffer(used, np.float32)
            total[row] += np.frombuffer(change, np.float16).reshape(-1, SIDE) * used[:, None]
            weight[row] += used
    if key:
        yield closed(key, total, weight)


def _mean(changes: DataFrame, tasks: int) -> DataFrame:
    """Changes of all tasks, averaged in a tree: no task reads more than FAN blocks of a kind."""
    while True:
        group = F.floor(F.col("task") / FAN)
        changes = changes.withColumn("g", group).repartition("g", "block").sortWithinPartitions("g", "block").drop("g").mapInArrow(_averaged, _CHANGES)
        if tasks <= FAN:
            return changes
        tasks = -(-tasks // FAN)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _step() -> Column:
    return F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")


def counted(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(word, c) of the training tokens; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                codes, _, words = space_words(part.column("text"), lower=True)
                n = np.bincount(codes, minlength=len(words))
                seen = np.flatnonzero(n)
                yield pa.record_batch({"word": pa.concat_arrays([words.take(pa.array(seen)), pa.array([END])]), "c": pa.array(np.append(n[seen], part.num_rows))})

    return ws.save(_docs(docs).where(_train()).select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def train(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, Vocabulary, Weights, int, int]:
    """Counts of the words beyond the head, vocabulary, weights, number of training tokens and of distinct ones."""
    spark = ws.spark
    counts = counted(ws, docs)
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, once = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            c = batch.column("c").to_numpy()
            k = cells_of(batch.column("word"))
            np.add.at(n, k, c)
            np.add.at(once, k, c == 1)
        some = np.flatnonzero(n)
        yield pa.record_batch({"k": pa.array(some), "n": pa.array(n[some]), "n1": pa.array(once[some])})

    totals = {r["k"]: (r["n"], r["n1"]) for r in counts.mapInArrow(classes, "k long, n long, n1 long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).collect()}
    # Words from some count on, as many as HEAD holds; counts are compared by steps of a 32nd of a doubling.
    sizes = counts.groupBy(_step().alias("s")).count().orderBy(F.desc("s")).collect()
    fits = [r["s"] for r, n in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if n <= HEAD]
    least = min(fits, default=1 << 30)
    head = sorted(counts.where((_step() >= least) | (F.col("word") == END)).select("c", "word").toArrow().to_pylist(), key=lambda r: (-r["c"], r["word"]))
    vocabulary = Vocabulary([r["word"] for r in head], [r["c"] for r in head], totals)
    del head
    unit, rounds, task_tokens = scale(int(tokens))
    weights = Weights(vocabulary.total, unit)
    lexicon = spark.sparkContext.broadcast(vocabulary)
    tasks = max(1, -(-int(tokens) // (rounds * task_tokens)))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(sent.value)
            for batch in batches:
                for part in slices(batch, "text", 3 << 20):
                    _, cell, feature, ends, *_ = lexicon.value.encode(part)
                    for i, j in _pieces(ends):
                        trainer.step(cell[ends[i] : ends[j]], feature[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            yield from trainer.changes(TaskContext.get().partitionId())

        own = _docs(docs).where(_train() & (F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)).select("text")
        own = own.coalesce(tasks)
        # A partition at a time; the tasks have the weights as they were sent, so they may change here.
        for r in _mean(own.mapInArrow(walk, _CHANGES), tasks).toLocalIterator():
            row = np.frombuffer(r["row"], np.uint16).astype(np.int64) + r["block"] * BLOCK
            weights.rows[row] += np.frombuffer(r["change"], np.float16).reshape(-1, SIDE)
        sent.destroy()
    lexicon.destroy()
    return counts.where((_step() < least) & (F.col("word") != END)), vocabulary, weights, int(tokens), int(distinct)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "maxent")
    rest, vocabulary, weights, tokens, distinct = train(ws, docs)
    mass = float(tokens + distinct + 1)
    sent = spark.sparkContext.broadcast((vocabulary, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value
        base = np.append(np.log10((v.counts + 1) / mass), 0.0)
        inside = np.append(v.inside, 0.0)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", 3 << 20):
                known, cell, feature, ends, codes, words, place = v.encode(part)
                own = w.log10(cell, feature, ends) + inside[known]
                n = part.num_rows
                sums = [np.concatenate(([0.0], np.cumsum(x)))[ends] for x in (base[known], own)]
                head = np.concatenate(([0], np.cumsum(known >= 0)))[ends]
                # An end token that no training document had is unseen and has no words to be counted with.
                rest = known[place] < 0
                doc = np.repeat(np.arange(n), np.diff(ends) - 1)[rest]
                pair, times = np.unique(doc * max(1, len(words)) + codes[rest], return_counts=True)
                doc, code = np.divmod(pair, max(1, len(words)))
                at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                rare, which = np.unique(code, return_inverse=True)
                hashed = hashed_words(words.take(pa.array(rare))).view(np.int64)
                k = np.zeros(len(words), np.int64)
                k[codes] = cell[place]
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (hashed[which], times, k[code])]
                yield pa.record_batch(
                    {
                        "row": pa.array(row + np.arange(n)), "doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(ends)), "n_head": pa.array(np.diff(head)),
                        "base": pa.array(np.diff(sums[0])), "own": pa.array(np.diff(sums[1])), "h": lists[0], "n": lists[1], "k": lists[2],
                    }
                )
                row += n

    head = ws.save(
        _docs(docs).mapInArrow(score, "row long, doc_id long, n_tokens long, n_head long, base double, own double, h array<long>, n array<long>, k array<long>"), "head"
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"h": pa.array(hashed_words(batch.column("word")).view(np.int64)), "c": batch.column("c")})

    rare = rest.mapInArrow(keyed, "h long, c long")
    seen = head.select("row", F.explode(F.arrays_zip("h", "n", "k")).alias("t")).select("row", "t.h", "t.n", "t.k").join(rare, "h", "left")
    # CELLS rows: what an unseen word of the cell costs, and what a seen one does for each time it occurred.
    with np.errstate(divide="ignore"):
        costs = np.log10(vocabulary.unseen), np.log10((1 - vocabulary.unseen) / np.maximum(vocabulary.total, 1))
    cells = F.broadcast(spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(*costs, strict=True)) if k >= SINGLES * SIDE], "k long, unseen double, seen double"))
    seen = seen.join(cells, "k", "left")
    inside = F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.col("seen") + F.log10("c"))
    rest = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_rest"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(mass))).alias("base_rest"), F.sum(F.col("n") * inside).alias("own_rest"),
    )
    zero = F.lit(0.0)
    end = 0.0 if vocabulary.end >= 0 else float(np.log10(1 / mass))
    return head.select("row", "doc_id", "n_tokens", "n_head", "base", "own").join(rest, "row", "left").select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", zero) + F.lit(end)).alias("base_score"), (F.col("own") + F.coalesce("own_rest", zero)).alias("score"),
    )


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
