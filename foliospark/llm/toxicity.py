"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon: words and word beginnings that mark toxic rows, mined from a bounded sample of labelled rows (SAMPLE rows,
   chosen by a hash of doc_id; only rows that may be learnt from). A greedy cover keeps at most ENTRIES of the candidates.
2. Voters: each entry votes for rows that have it; four patterns vote as well: three entries or more, one word in a
   hundred, capitals, exclamation marks.
3. Label model: a class prior and, within each class, a tree of voters (the parent of a voter is the one that it agrees
   with most beyond chance), so that a voter's accuracy and its correlation with its parent are estimated together. It is
   fitted by EM on the vote patterns of all rows that may be learnt from, as sums over tasks. No label takes part in it;
   labels only give the prior, the share of toxic rows, which stays as it is. EM starts from the number of entries that
   vote and adds TRUST times the start's counts to each round's. A voter that does not vote abstains.
4. Classifier: logistic regression on the sample's text features (all candidates, hashed to BUCKETS; votes; counts of
   hits), trained on the label model's posteriors.

Rows that may be learnt from: crc32(doc_id as text) mod 3 is not 1. Inputs of a score are the text alone. Null and empty
texts get the score of a text without votes. Without labelled toxic rows nothing is learnt and every score is 0. A null
doc_id counts as held out. Labels that repeat count as toxic if any says so; null labels count as none.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, slices, space_words, table

#: Labelled rows that lexicon and classifier are fitted on at most (on average), lexicon entries, pattern voters, hashed text features.
SAMPLE, ENTRIES, PATTERNS, BUCKETS = 20_000, 192, 4, 256
#: Rounds of EM, and how many times the start's counts are added to those of a later round. Votes alone can't tell a voter that
#: agrees with no other from a bad one; the start, in which the lexicon's entries are good, keeps it.
ROUNDS, TRUST = 8, 2.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
#: Least number of toxic rows that have a candidate; an entry must add at least one less, or a share of the toxic rows.
MIN_SUPPORT, MIN_SHARE = 4, 0.003
#: Features that a task counts before it hands the counts on.
COUNTED = 1 << 19
#: Text bytes that a worker takes apart at once.
HELD = 1 << 20
#: Least log-odds of a candidate between toxic and other rows.
MIN_ODDS = 2.5

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(token: str) -> set[str]:
    """Words in a token (`=word`) and their beginnings (`^beg`). A text also has `^^beg` if two different tokens have `^beg`."""
    out = set()
    for w in _LETTERS.findall(token.lower()):
        out.add("=" + w)
        out.update("^" + w[:n] for n in PREFIXES if n < len(w))
    return out


def _learnable() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _starts(entries: dict[str, int]) -> set[str]:
    """The first letters of the entries; a word that starts otherwise needs no further look."""
    return {e.lstrip("=^")[: PREFIXES[0]] for e in entries}


def _hits(part: pa.RecordBatch, entries: dict[str, int], starts: set[str]) -> Iterator[tuple[int, Counter, int, float, float]]:
    """Of each text: (row, lexicon entries with counts, number of words, share of words in capitals, exclamation marks a word)."""
    codes, ends, words = space_words(part.column("text"), lower=False)
    tokens = words.to_pylist()
    found, twice = [], []
    for t in tokens:
        if not any(w[: PREFIXES[0]] in starts for w in _LETTERS.findall(t.lower())):
            found.append([])
            twice.append([])
            continue
        own = features_of(t)
        found.append([entries[f] for f in own if f in entries])
        twice.append([entries["^" + f] for f in own if f[0] == "^" and "^" + f in entries])
    marked = np.fromiter((bool(a or b) for a, b in zip(found, twice, strict=True)), bool, len(found))
    loud = np.fromiter((len(t) > 2 and t.isupper() for t in tokens), bool, len(tokens))
    bang = np.fromiter((t.count("!") for t in tokens), np.int64, len(tokens))
    is_marked, total_loud, total_bang = (np.concatenate(([0], np.cumsum(x[codes]))) for x in (marked, loud, bang))
    at = np.flatnonzero(marked[codes]) if len(codes) else np.zeros(0, np.int64)
    for i in range(part.num_rows):
        a, b = ends[i], ends[i + 1]
        own: Counter = Counter()
        seen = codes[at[is_marked[a] : is_marked[b]]].tolist()
        for c in seen:
            own.update(found[c])
        if len(seen) > 1:
            pairs: Counter = Counter()
            for c in set(seen):
                pairs.update(twice[c])
            own.update({e: k for e, k in pairs.items() if k > 1})
        n = int(b - a)
        yield i, own, n, (total_loud[b] - total_loud[a]) / max(1, n), (total_bang[b] - total_bang[a]) / max(1, n)


class Voters:
    """Candidates of the lexicon by number; which of them vote."""

    def __init__(self, names: list[str], entries: list[str]) -> None:
        self.candidates = {f: i for i, f in enumerate(names)}
        self.starts = _starts(self.candidates)
        number = {e: k for k, e in enumerate(entries)}
        self.voter = np.array([number.get(f, -1) for f in names], np.int64)
        self.bucket = np.array([zlib.crc32(f.encode()) % BUCKETS for f in names], np.int64)
        self.entries, self.size = entries, len(entries) + PATTERNS

    def of(self, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
        """Of each text: the voters that vote, the text features it has, and counts of its hits."""
        for _, own, n, loud, bang in _hits(part, self.candidates, self.starts):
            found = np.fromiter(own, np.int64, len(own))
            voters = self.voter[found]
            k = voters >= 0
            hits = int(np.fromiter(own.values(), np.int64, len(own))[k].sum())
            marks = (k.sum() >= 3, hits * 100 >= n > 0, loud > 0.2, bang > 0.05)
            votes = np.append(np.sort(voters[k]), len(self.entries) + np.flatnonzero(marks))
            yield votes, np.unique(self.bucket[found]), [min(int(k.sum()), 6) / 6, float(np.log1p(hits)), min(1.0, 20 * hits / max(n, 1))]


def _dense(lists: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(lists), size), bool)
    for i, x in enumerate(lists):
        out[i, x] = True
    return out


class LabelModel:
    """P(class) and, within a class, P(vote | vote of the parent voter); parents form a tree."""

    def __init__(self, prior: float, size: int) -> None:
        self.prior, self.parent = np.array([1 - prior, prior]), np.full(size, -1)
        #: given[class, voter, vote of the parent]: chance of a vote. Not yet there before the first round.
        self.given: np.ndarray | None = None

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Chance of toxicity of vote patterns (row, voter). Voters that don't vote abstain, which says nothing; without any vote it is a tenth of the prior."""
        if self.given is None:
            # Before anything is known, one entry of the lexicon is as good as another, and patterns say nothing.
            return np.choose(np.minimum(x[:, :-PATTERNS].sum(axis=1), 3), [self.prior[1] / 10, 0.9, 0.97, 0.99])
        above = np.where(self.parent >= 0, x[:, self.parent], False).astype(np.int64)
        odds = np.log(self.given[1] / self.given[0])[np.arange(x.shape[1]), above]
        log = np.log(self.prior[1] / self.prior[0]) + np.where(x, odds, 0.0).sum(axis=1)
        return np.where(x.any(axis=1), 1 / (1 + np.exp(-np.clip(log, -500, 500))), self.prior[1] / 10)

    def sums(self, x: np.ndarray, n: np.ndarray, pairs: bool) -> np.ndarray:
        """What a round needs of some patterns that occur n times: by class the weight, the votes, the votes together with the parent's; with `pairs`, with every voter's."""
        post = self.posterior(x)
        out = []
        for w in (n * (1 - post), n * post):
            both = (x * w[:, None]).T @ x if pairs else np.where(self.parent >= 0, (w[:, None] * (x & x[:, self.parent])).sum(axis=0), 0.0)
            out += [np.array([w.sum()]), w @ x, both.ravel()]
        return np.concatenate(out)

    def fit(self, total: np.ndarray, pairs: bool) -> None:
        """One round from the sums of all patterns."""
        size, given = len(self.parent), np.empty((2, len(self.parent), 2))
        halves = np.split(total, 2)
        if pairs:
            self.parent = _tree([(h[0], h[1 : 1 + size], h[1 + size :].reshape(size, size)) for h in halves])
        for c, h in enumerate(halves):
            weight, votes = h[0], h[1 : 1 + size]
            both = h[1 + size :].reshape(size, size)[np.arange(size), self.parent] * (self.parent >= 0) if pairs else h[1 + size :]
            base = (votes + 0.5) / (weight + 1.0)
            parent_votes = np.where(self.parent >= 0, votes[self.parent], 0.0)
            given[c, :, 1] = (both + 2 * base) / (parent_votes + 2)
            given[c, :, 0] = (votes - both + 2 * base) / (weight - parent_votes + 2)
        self.given = np.clip(given, 1e-9, 1 - 1e-9)


def _tree(classes: list[tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Maximum spanning tree of the voters' mutual information within the classes (weight, votes, votes of pairs); the first voter is the root."""
    size = len(classes[0][1])
    info = np.zeros((size, size))
    for weight, votes, both in classes:
        total = weight + 2.0
        one = (votes + 1.0) / total
        for a, b, joint in ((1, 1, both), (1, 0, votes[:, None] - both), (0, 1, votes[None] - both), (0, 0, weight - votes[:, None] - votes[None] + both)):
            p = np.maximum(joint + 0.5, 0.5) / total
            info += total * p * np.log(p / np.outer(one if a else 1 - one, one if b else 1 - one))
    parent, best, link = np.full(size, -1), info[0].copy(), np.zeros(size, np.int64)
    left = np.ones(size, bool)
    left[0] = False
    while left.any():
        j = int(np.where(left, best, -np.inf).argmax())
        parent[j], left[j] = link[j], False
        closer = left & (info[j] > best)
        best[closer], link[closer] = info[j][closer], j
    return parent


def _with_parents(total: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The sums of pairs cut down to those of voters and their parents."""
    size, out = len(parent), []
    for h in np.split(total, 2):
        both = h[1 + size :].reshape(size, size)[np.arange(size), parent] * (parent >= 0)
        out += [h[: 1 + size], both]
    return np.concatenate(out)


def label_model(patterns: DataFrame, prior: float, size: int, rounds: int = ROUNDS) -> LabelModel:
    """Fitted to patterns (votes binary, n long): sums of every task meet in an aggregation, so the driver gets as many numbers as the model has."""
    model, start = LabelModel(prior, size), np.zeros(0)
    for k in range(rounds):
        sent = patterns.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, pairs: bool = k == 0) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _dense([np.frombuffer(v, np.uint16) for v in part.column("votes").to_pylist()], size)
                    own = sent.value.sums(x, part.column("n").to_numpy().astype(float), pairs)
                    total = own if total is None else total + own
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.record_batch({"i": pa.array(some), "x": pa.array(total[some])})

        width = 1 + size + (size * size if k == 0 else size)
        total = np.zeros(2 * width)
        got = patterns.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        total[got["i"].to_numpy(np.int64)] = got["x"].to_numpy(float)
        model.fit(total if k == 0 else total + TRUST * start, k == 0)
        if k == 0:
            start = _with_parents(total, model.parent)
        sent.destroy()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights, the constant last, by Newton's method on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _least(n_toxic: int) -> float:
    """What an entry must add: toxic rows, less three times the others it hits."""
    return max(MIN_SUPPORT - 1, MIN_SHARE * n_toxic)


def _cover(rows: list[tuple[int, list[int]]], names: list[str]) -> list[str]:
    """Entries chosen one by one for the toxic rows they add (each row may be covered three times), less the others they hit."""
    toxic: dict[int, list[int]] = {}
    clean: Counter = Counter()
    n_toxic = sum(y for y, _ in rows)
    for i, (y, hits) in enumerate(rows):
        for f in hits:
            if y:
                toxic.setdefault(f, []).append(i)
            else:
                clean[f] += 1
    n_clean = len(rows) - n_toxic
    odds = {f: np.log((len(t) + 0.5) / (n_toxic + 1)) - np.log((clean[f] + 0.5) / (n_clean + 1)) for f, t in toxic.items()}
    left = [f for f in toxic if odds[f] > MIN_ODDS and len(toxic[f]) > 2 * clean[f]]
    covered: Counter = Counter()
    least = _least(n_toxic)
    kept: list[str] = []
    # A whole word goes before a beginning of the same gain, a long beginning before a short one.
    left.sort(key=lambda f: (names[f][0] == "=", len(names[f]), names[f]), reverse=True)
    queue = [(3 * clean[f] - len(toxic[f]), k, f) for k, f in enumerate(left)]
    heapq.heapify(queue)
    # By what `same` needs to agree: doubled or not, and the first letter.
    alike: dict[tuple[bool, str], set[int]] = {}
    for f in left:
        alike.setdefault((names[f].startswith("^^"), names[f].lstrip("=^")[0]), set()).add(f)
    gone: set[int] = set()
    while queue and len(kept) < ENTRIES:
        loss, k, best = heapq.heappop(queue)
        if best in gone:
            continue
        now = sum(covered[i] < 3 for i in toxic[best]) - 3 * clean[best]
        if now < -loss:
            if now >= least:
                heapq.heappush(queue, (-now, k, best))
            continue
        if now < least:
            break
        kept.append(names[best])
        covered.update(toxic[best])
        # Beginnings of a chosen word, and words behind a chosen beginning, say the same again.
        root = names[best].lstrip("=^")

        def same(name: str, root: str = root) -> bool:
            stem = name.lstrip("=^")
            return stem.startswith(root) or root.startswith(stem)

        group = alike[names[best].startswith("^^"), root[0]]
        out = {f for f in group if f == best or (same(names[f]) and len(toxic[f]) <= 1.1 * len(toxic[best]))}
        gone |= out
        group -= out
    return kept


class Model:
    """What scoring needs: voters, the label model and the classifier's weights. Small, whatever the corpus."""

    def __init__(self, voters: Voters | None = None, label: LabelModel | None = None, weights: np.ndarray | None = None) -> None:
        self.voters, self.label, self.weights = voters, label, weights
        self.entries = voters.entries if voters else []

    def scores(self, part: pa.RecordBatch, label: bool = False) -> np.ndarray:
        """Of each text the classifier's score, or with `label` what the label model says."""
        if self.voters is None:
            return np.zeros(part.num_rows)
        rows = list(self.voters.of(part))
        if label:
            return self.label.posterior(_dense([v for v, _, _ in rows], self.voters.size))
        x = _inputs(rows, self.voters.size)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _inputs(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], size: int) -> np.ndarray:
    """The classifier's inputs: text features, votes, counts."""
    return np.concatenate([_dense([b for _, b, _ in rows], BUCKETS), _dense([v for v, _, _ in rows], size), np.array([m for _, _, m in rows], float).reshape(-1, 3)], axis=1)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").where(_learnable()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    n = known.count()
    share = min(1.0, SAMPLE / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most SAMPLE rows of two numbers on average, by the line above.
    ws = Workspace(spark, "toxicity")
    sample = ws.save(docs.join(F.broadcast(chosen), "doc_id").select("text", "y"), "sample")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many toxic and other rows have each feature."""
        count: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(count[0].keys() | count[1].keys())
            out = pa.record_batch({"f": pa.array(names, pa.string()), "t": pa.array([count[1][f] for f in names], pa.int64()), "c": pa.array([count[0][f] for f in names], pa.int64())})
            for c in count:
                c.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text", HELD):
                codes, ends, words = space_words(part.column("text"), lower=False)
                own = [features_of(t) for t in words.to_pylist()]
                for i, y in enumerate(part.column("y").to_pylist()):
                    here = Counter(f for c in np.unique(codes[ends[i] : ends[i + 1]]).tolist() for f in own[c])
                    count[y].update([*here, *("^" + f for f, k in here.items() if k > 1 and f[0] == "^")])
                    if len(count[0]) + len(count[1]) > COUNTED:
                        yield counted()
        yield counted()

    of = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = of.get(1, 0), of.get(0, 0)
    t, c = F.col("t"), F.col("c")
    mined = sample.where("y in (0, 1)").select("text", "y").mapInArrow(mine, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    # The cover takes nothing that adds less at its start.
    passing = mined.where((t >= MIN_SUPPORT) & (t > 2 * c) & (odds > MIN_ODDS) & (t - 3 * c >= _least(n_toxic)))
    names = sorted(r["f"] for r in passing.select("f").collect())
    if not names:
        return Model()

    def look(batches: Iterator[pa.RecordBatch], sent=spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})) -> Iterator[pa.RecordBatch]:
        starts = _starts(sent.value)
        for batch in batches:
            for part in slices(batch, "text", HELD):
                hits = [np.array(sorted(own), np.uint32).tobytes() for _, own, *_ in _hits(part, sent.value, starts)]
                yield pa.record_batch({"y": part.column("y"), "hits": pa.array(hits, pa.binary())})

    rows = [(r["y"], np.frombuffer(r["hits"], np.uint32).tolist()) for r in sample.select("text", "y").mapInArrow(look, "y int, hits binary").toLocalIterator()]
    entries = _cover(rows, names)
    if not entries:
        return Model()
    voters = Voters(names, entries)
    sent = spark.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vote patterns with their counts, handed on whenever there are many."""
        count: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", HELD):
                count.update(v.astype(np.uint16).tobytes() for v, _, _ in sent.value.of(part))
                if len(count) > COUNTED:
                    yield pa.record_batch({"votes": pa.array(list(count), pa.binary()), "n": pa.array(list(count.values()), pa.int64())})
                    count.clear()
        yield pa.record_batch({"votes": pa.array(list(count), pa.binary()), "n": pa.array(list(count.values()), pa.int64())})

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HELD):
                got = list(sent.value.of(part))
                yield pa.record_batch({"votes": pa.array([v.tolist() for v, _, _ in got], pa.list_(pa.int32())), "buckets": pa.array([b.tolist() for _, b, _ in got], pa.list_(pa.int32())), "more": pa.array([m for _, _, m in got], pa.list_(pa.float64()))})

    patterns = ws.save(docs.where(_learnable()).select("text").mapInArrow(vote, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")), "patterns")
    label = label_model(patterns, (n_toxic + 0.5) / (n_toxic + n_clean + 1), voters.size)
    got = sample.select("text").mapInArrow(inputs, "votes array<int>, buckets array<int>, more array<double>").collect()
    rows = [(np.array(r["votes"], np.int64), np.array(r["buckets"], np.int64), r["more"]) for r in got]
    target = label.posterior(_dense([v for v, _, _ in rows], voters.size))
    return Model(voters, label, _logistic(_inputs(rows, voters.size), target))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HELD):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(sent.value.scores(part))})

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, score double")
        .select("doc_id", (~_learnable()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, whatever their doc_id; columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HELD):
                yield part.filter(pa.array(sent.value.scores(part) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
