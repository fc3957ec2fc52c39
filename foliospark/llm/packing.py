"""Packing into sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its own documents and packs them. Whole runs of `length` tokens are sequences of their own. The
rests are gathered for about GROUP windows at a time and dealt to the windows by differencing alone, which makes the
windows near equal; what they lack to the length is padding, about one part in 500. If a window exceeds the length, the
number of windows rises by up to one part in RISE; if that does not help, the items are too long for near-equal windows
and the longest are cut at five eighths. Apart from that only the one item at the border of two groups is cut. At the end of a task
whole windows are dealt as before, and less than a window is split into lengths that are powers of two, which need no
padding. Nothing is shuffled, and a task holds one group.

Null and empty texts consist of the end token. A doc_id may repeat or be null; each row is a document.
"""

from __future__ import annotations

import heapq
import itertools
import json
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import slices, space_words, table

LENGTH, END = 4096, 2
#: Windows that are packed together; rests shorter than BUNDLE tokens are first joined to bundles.
GROUP, BUNDLE = 256, 128
#: A window is left one part in SLACK short, so that differencing fits; the number of windows rises by one part in RISE at most.
SLACK, RISE = 512, 64
#: Words whose ids a worker remembers; when there are more, the ones that occurred in several slices stay, half as many at most.
REMEMBERED = 400_000
#: Words of a text that is encoded, texts that are encoded at once, words whose ids are put together at once.
WORDS, TEXTS, RUN = 512, 16, 1 << 16

_tokenizers: dict[str, WordIds] = {}


# The normaliser and the splitter of the tokenizer whose words can be looked up one by one.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(path: str) -> bool:
    """Whether a tokenizer drops white space and treats each run of letters by itself, in lower case."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = [x.get("type") for x in (own.get("normalizer") or {}).get("normalizers", ())]
    splits = [x.get("pattern", {}).get("Regex") for x in (own.get("pre_tokenizer") or {}).get("pretokenizers", ()) if x.get("type") == "Split"]
    return steps == _NORMALIZER and splits == [_SPLIT] and own["model"].get("end_of_word_suffix") == "</w>" and all("<|" in t["content"] for t in own["added_tokens"])


def _strings(column: pa.Array) -> list[str]:
    """The same as to_pylist, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Token ids of texts. Where the tokenizer treats words by themselves, a word is encoded once; other tokenizers get whole texts."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own, self.by_words = Tokenizer.from_file(path), _by_words(path)
        if not self.by_words:
            return
        # For words that are normalised already.
        with open(path, encoding="utf-8") as f:
            self.bare = Tokenizer.from_str(json.dumps(json.load(f) | {"normalizer": None}))
        vocab = self.own.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.forget()

    def normals(self, words: list[str]) -> list[str]:
        """The words as the tokenizer's splitter sees them."""
        one = self.own.normalizer.normalize_str
        other = [w for w in words if not w.isascii()]
        # Nothing composes with the blank between two words; white space within a word would be mistaken for it.
        whole = [w for w in other if w.split() == [w]]
        found = dict(zip(whole, one(" ".join(whole)).split(" "), strict=True)) if whole else {}
        return [w.lower() if w.isascii() else found[w] if w in found else one(w) for w in words]

    def forget(self) -> None:
        #: Number of each word, in this order; its ids are flat[first[number] : first[number] + size[number]]. Number 0 is no word.
        self.number: dict[str, int] = {"": 0}
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        #: In how many slices each word occurred.
        self.slices = np.zeros(1, np.int64)

    def keep_frequent(self) -> None:
        least = 2
        while (self.slices >= least).sum() > REMEMBERED // 2:
            least += 1
        kept = self.slices >= least
        kept[0] = True
        self.flat = self.flat[kept.repeat(self.size)]
        self.number = {w: i for i, w in enumerate(itertools.compress(self.number, kept.tolist()))}
        self.size, self.slices = self.size[kept], self.slices[kept] // 2
        self.first = np.cumsum(self.size) - self.size

    def learn(self, words: list[str]) -> None:
        plain, normal, odd = [], [], []
        for w, x in zip(words, self.normals(words), strict=True):
            if x.isalpha():
                plain.append(w)
                normal.append(x)
            else:
                odd.append(w)
        # Letters only: one word-end token a word, so that many words can be encoded as one text.
        order, flats, sizes = [], [self.flat], [self.size]
        for start in range(0, len(plain), WORDS * TEXTS):
            cuts = range(start, min(start + WORDS * TEXTS, len(plain)), WORDS)
            for at, x in zip(cuts, self.bare.encode_batch_fast([" ".join(normal[at : at + WORDS]) for at in cuts], add_special_tokens=False), strict=True):
                part, ids = plain[at : at + WORDS], np.array(x.ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part):
                    order += part
                    flats.append(ids)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    odd += part
        for w, x in zip(odd, self.own.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            order.append(w)
            flats.append(np.array(x.ids, np.uint32))
            sizes.append(np.array([len(x.ids)], np.int64))
        self.number.update(zip(order, range(len(self.size), len(self.size) + len(order)), strict=True))
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size
        self.slices = np.append(self.slices, np.zeros(len(order), np.int64))

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, first, size) of the words' ids. A word with closing ASCII punctuation after a letter is that word and the punctuation."""
        special = pc.match_substring(words, "<|")
        bare = pc.utf8_rtrim(words, string.punctuation)
        cut = pc.and_not(pc.and_(pc.not_equal(bare, words), pc.not_equal(bare, "")), special).to_numpy(zero_copy_only=False)
        last = pc.utf8_slice_codeunits(bare, -1)
        letter = pc.ascii_is_alpha(last).to_numpy(zero_copy_only=False)
        # Only scripts below U+0500 are known to end in a letter.
        other = np.flatnonzero(cut & ~letter & ~pc.string_is_ascii(last).to_numpy(zero_copy_only=False))
        letter[other] = [x[-1].isalpha() and ord(x[-1]) < 0x500 for x in self.normals(_strings(bare.take(pa.array(other))))]
        cut &= letter
        at = np.flatnonzero(cut)
        cores = pc.if_else(pa.array(cut), bare, words)
        cores = _strings(pc.if_else(pc.and_not(pc.string_is_ascii(cores), special), pc.ascii_lower(cores), cores))
        ends = [w[n:] for w, n in zip(_strings(words.take(pa.array(at))), pc.utf8_length(bare.take(pa.array(at))).to_numpy().tolist(), strict=True)]
        if len(self.number) > REMEMBERED:
            self.keep_frequent()
        number = self.number
        self.learn([x for x in {*cores, *ends} if x not in number])
        both = np.zeros(2 * len(words), np.int64)
        both[::2] = np.fromiter(map(number.__getitem__, cores), np.int64, len(words))
        both[2 * at + 1] = np.fromiter(map(number.__getitem__, ends), np.int64, len(ends))
        self.slices += np.bincount(both, minlength=len(self.slices)) > 0
        n = self.size[both]
        flat = self.flat[np.repeat(self.first[both] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        size = n[::2] + n[1::2]
        return flat, np.cumsum(size) - size, size


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, with the end token."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    if not _tokenizers[path].by_words:
        for x in _tokenizers[path].own.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False):
            yield np.array([*x.ids, END], np.uint32)
        return
    codes, ends, words = space_words(texts, lower=False)
    flat, first, size = _tokenizers[path].of(words)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, side="right")) - 1)
        own = codes[ends[at] : ends[end]]
        n = size[own]
        stop = np.concatenate(([0], n.cumsum()))
        stops = stop[ends[at + 1 : end + 1] - ends[at]] + np.arange(end - at)
        out = np.empty(stop[-1] + end - at, np.uint32)
        word = np.ones(len(out), bool)
        word[stops] = False
        out[stops] = END
        out[word] = flat[(first[own] - stop[:-1]).repeat(n) + np.arange(stop[-1])]
        yield from np.split(out, stops[:-1] + 1)
        at = end


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k parts of near-equal sums: the two partial partitions of largest spread are merged, the largest part of the one with the smallest of the other.

    A part is the number of a node: an item, counted from 1, or a pair of nodes; 0 is an empty part.
    """
    heap = []
    for i, s in enumerate(sizes):
        sums, parts = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], parts[0] = s, i + 1
        heap.append((-s, i, sums, parts))
    heapq.heapify(heap)
    count, nodes, left, right = itertools.count(len(heap)), len(sizes) + 1, [], []
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        y = y[::-1]
        parts = np.where(x, x, y)
        both = np.flatnonzero((x > 0) & (y > 0))
        if len(both):
            left.append(x[both])
            right.append(y[both])
            parts[both] = np.arange(nodes, nodes + len(both))
            nodes += len(both)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(count), sums, parts[order]))
    left, right = (np.concatenate(x).tolist() if x else [] for x in (left, right))
    out = []
    for node in heap[0][3].tolist():
        part, todo = [], [node] if node else []
        while todo:
            node = todo.pop()
            if node <= len(sizes):
                part.append(node - 1)
            else:
                todo += (left[node - len(sizes) - 1], right[node - len(sizes) - 1])
        out.append(sorted(part))
    return out


class Packer:
    """Collects pieces (document, start, length) and returns rows of finished sequences."""

    def __init__(self, base: int, length: int) -> None:
        self.next, self.length, self.rests, self.waiting, self.rows = base, length, [], 0, []

    def sequence(self, pieces: list[tuple]) -> None:
        offset, load = 0, sum(n for _, _, n in pieces)
        for (doc_id, ids), start, n in pieces:
            crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
            self.rows.append((doc_id, start, n, crc, len(ids), self.next, offset, load))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            self.sequence([((doc_id, ids), start, self.length)])
        if whole < len(ids):
            self.rests.append(((doc_id, ids), whole, len(ids) - whole))
            self.waiting += len(ids) - whole
        if self.waiting >= GROUP * self.length:
            self.flush()

    def take(self, room: int) -> list[tuple]:
        """The first waiting pieces that fill `room` tokens; the one at the border is cut."""
        own, at = [], 0
        while room and at < len(self.rests):
            doc, start, n = self.rests[at]
            now = min(n, room)
            own.append((doc, start, now))
            room -= now
            self.waiting -= now
            if now < n:
                self.rests[at] = (doc, start + now, n - now)
            else:
                at += 1
        del self.rests[:at]
        return own

    def windows(self, pieces: list[tuple], k: int) -> None:
        """Deals pieces to near-equal windows, k or a few more."""
        items: list[list[tuple]] = []
        small = 0
        for piece in pieces:
            if small and piece[2] < BUNDLE:
                items[-1].append(piece)
                small = small + piece[2] if small + piece[2] < BUNDLE else 0
            else:
                items.append([piece])
                small = piece[2] if piece[2] < BUNDLE else 0
        most = k + k // RISE
        while True:
            sizes = [sum(p[2] for p in x) for x in items]
            now = k
            while True:
                parts = differencing(sizes, now)
                over = max(sum(sizes[i] for i in x) for x in parts) - self.length
                if over <= 0 or now >= most:
                    break
                # As many more windows as make room for the excess in each.
                now = min(most, now + max(1, -(-over * now // self.length)))
            if over <= 0:
                break
            longest = max(sizes) * 5 // 8
            halved = []
            for item in items:
                if len(item) == 1 and item[0][2] > max(1, longest):
                    doc, start, n = item[0]
                    first = max(1, n * 5 // 8)
                    halved += [[(doc, start, first)], [(doc, start + first, n - first)]]
                elif len(item) > 1 and sum(p[2] for p in item) > longest:
                    halved += [[p] for p in item]
                else:
                    halved.append(item)
            items = halved
        for part in parts:
            if part:
                self.sequence([p for i in part for p in items[i]])

    def flush(self, end: bool = False) -> None:
        fill = self.length - max(1, self.length // SLACK)
        k = self.waiting // fill if end else GROUP
        if k:
            self.windows(self.take(k * fill), k)
        while end and self.waiting:
            self.sequence(self.take(1 << (min(self.waiting, self.length).bit_length() - 1)))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
        return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True) if rows else [()] * 8, strict=True)})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (of all its pieces)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, length)
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), token_ids(part.column("text"), path), strict=True):
                    packer.add(doc_id, ids)
                yield packer.taken()
        packer.flush(end=True)
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
