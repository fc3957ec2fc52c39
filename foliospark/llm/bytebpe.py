"""Byte-level BPE: encoding by a shuffle of the distinct words of the corpus, decoding by a join with the token-byte table.

A text is cut into pre-tokens (words), and every distinct word of the corpus is encoded once, wherever it occurs:

1. Tasks cut their texts and gather them in blocks of about BLOCK_BYTES. A block is one row: its distinct words as an
   array, and for each document the places of its words in that array, packed (so a word's text leaves a block once,
   and positions within documents never leave it). Blocks are written to the shared folder.
2. The words are exploded with their places and shuffled by word over all blocks. Where all places of a word meet, it is
   encoded once and its ids join its places; ids go back in packs, one for a task and block.
3. Packs and blocks meet by block, where each document is put together by position.

Decoding goes the same way with token ids for words and the table of tokens for the encoder: that table has a row a
token, so its size is the vocabulary's, and the join broadcasts it. `encoded(bytes=True)` decodes in the same pass: once
a block's ids are in order, each is looked up in the broadcast table.

A word that is in every block has a row a block, which a task reads one after the other. A task
holds one block, which is one document if that is larger. Null and empty texts have no ids. A doc_id may repeat or be
null: rows are told apart by their place in a block. Empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Workspace, slices, table

#: Text of a block.
BLOCK_BYTES = 16 << 20
#: Places that a task packs together, and elements that it puts in order at a time.
PACK, STEP = 1 << 20, 1 << 21
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)

_loaded: dict[str, object] = {}
_classes: list[np.ndarray] = []


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encoder(path: str):
    """The vocabulary's encoder, loaded once a Python worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})
    return _loaded[path]


def character_classes() -> np.ndarray:
    """The class of each code point as the encoder's own pattern engine sees it: what it finds by one class is kept, all else skipped."""
    if not _classes:
        import tiktoken

        points = np.setdiff1d(np.arange(0x110000, dtype=np.uint32), np.arange(0xD800, 0xE000, dtype=np.uint32))
        every, out = points.tobytes().decode("utf-32-le"), np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            found = bytes(own.encode_ordinary(every)).decode("utf-8")
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _classes.append(out)
    return _classes[0]


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each pre-token, first pre-token of each text with the end, distinct pre-tokens): the matches of

        's 't 're 've 'm 'll 'd, an optional space before letters, before numbers or before other characters,
        white space up to the last one before something else, white space

    worked out for all texts at once: runs of one class, corrected at white space and at apostrophes.
    """
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.string())
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = character_classes()[points]
    n = len(points)
    ends = np.searchsorted(at, offsets - offsets[0])
    opens = np.zeros(n + 1, bool)  # where a text begins, and behind the last
    opens[ends] = True
    starts = opens[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else is a pre-token of its own, or the start of the next if it is a space.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~opens[1:n]
    starts |= last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    starts[joined] = False
    # An apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it; what follows begins anew.
    mark = np.flatnonzero(starts & (points == 0x27))
    padded, closed = np.concatenate((points, np.zeros(2, np.uint32))), np.concatenate((opens, np.ones(2, bool)))
    one = np.isin(padded[mark + 1], [ord(c) for c in "stmd"]) & ~closed[mark + 1]
    a, b = padded[mark + 1], padded[mark + 2]
    two = np.zeros(len(mark), bool)
    for x, y in ("re", "ve", "ll"):
        two |= (a == ord(x)) & (b == ord(y))
    two &= ~closed[mark + 1] & ~closed[mark + 2]
    starts[mark[one | two] + 1] = False
    starts[mark[two] + 2] = False
    after = np.concatenate((mark[one] + 2, mark[two] + 3))
    starts[after[after < n]] = True
    first = np.flatnonzero(starts)
    cuts = np.append(at[first], len(raw)).astype(np.int32)
    cut = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
    return cut.indices.to_numpy().astype(np.int64), np.searchsorted(first, ends), cut.dictionary


def _packed(places: np.ndarray) -> bytes:
    """Numbers as bytes: low, middle and high ones apart, compressed."""
    return pa.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents of a block and the places of their parts (words or tokens) among the block's distinct ones, the most frequent first."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.codes, self.parts, self.bytes = [], [], [], [], 0

    def add(self, ids: pa.Array, codes: np.ndarray, ends: np.ndarray, parts: pa.Array, n_bytes: int) -> None:
        self.ids += ids.to_pylist()
        self.sizes.append(np.diff(ends))
        # Parts of several slices get common numbers when the block is closed.
        self.codes.append(codes + sum(map(len, self.parts)))
        self.parts.append(parts)
        self.bytes += n_bytes

    def row(self, number: int) -> pa.RecordBatch:
        every = pa.concat_arrays(self.parts).dictionary_encode()
        places = every.indices.to_numpy()[np.concatenate(self.codes)] if len(every) else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(places, minlength=len(every.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.concatenate(self.sizes)
        parts = every.dictionary.take(pa.array(order))
        listed = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
        # Two rows: what stays with the block, and what leaves it.
        return pa.record_batch(
            {
                "block": pa.array([number, number]), "leaves": pa.array([False, True]), "ids": pa.array([self.ids, None], pa.list_(pa.int64())), "sizes": pa.array([sizes, None], pa.list_(pa.int64())),
                "places": pa.array([_packed(rank[places]), None], pa.binary()), "parts": pa.concat_arrays([pa.nulls(1, listed.type), listed]),
            }
        )


def _blocks(rows: DataFrame, column: str, cut: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]], kind: str) -> DataFrame:
    """(block, ids, sizes, places, parts, leaves) of rows (doc_id, column): of each block a row with its documents and places, and one (leaves) with its distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, column):
                own.add(part.column("doc_id"), *cut(part.column(column)), pc.sum(pc.binary_length(part.column(column))).as_py() or 0)
                if own.bytes >= BLOCK_BYTES:
                    yield own.row(number)
                    own, number = _Block(), number + 1
        if own.ids:
            yield own.row(number)

    return rows.mapInArrow(run, f"block long, leaves boolean, ids array<long>, sizes array<long>, places binary, parts array<{kind}>")


def _gathered(flat: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, ends): values (`sizes` elements of flat each) at the places, one after another, and where each ends. Works on STEP elements at a time."""
    first, size = (np.cumsum(sizes) - sizes)[places], sizes[places]
    ends = np.cumsum(size)
    out, at = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype), 0
    while at < len(places):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + STEP, side="right")))
        n = size[at:stop]
        out[before : ends[stop - 1]] = flat[np.repeat(first[at:stop] - (ends[at:stop] - n - before), n) + np.arange(int(ends[stop - 1]) - before)]
        at = stop
    return out, ends


def _by_document(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each document, which is `sizes` values, and its number of elements."""
    edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int64)
    offsets = pa.py_buffer(edge * flat.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(flat.view(np.uint8))]).cast(pa.binary()), np.diff(edge)


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of binary values."""
    values = pa.concat_arrays([pc.fill_null(values, b"").cast(pa.large_binary())])
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(offsets)


def _packs(words: DataFrame, path: str) -> DataFrame:
    """(block, n, keys, sizes, ids): places of words (block, key, word) with the words' ids, in packs of n places of one block.

    The shuffle by word brings all places of a word together, wherever they are; sorted, each word is encoded once and
    its ids meet its places as they pass. A task holds PACK places.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, held, n = encoder(path), {}, [], 0

        def packed() -> pa.RecordBatch:
            block, key, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, block))
            flat, ends = _gathered(flat, size, order)
            block, key, size = block[order], key[order], size[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids = flat[ends[a - 1] if a else 0 : ends[b - 1]]
                rows.append((int(block[a]), b - a, _packed(np.diff(key[a:b], prepend=0)), _packed(size[a:b]), _packed(ids)))
            kinds = {"block": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "sizes": pa.binary(), "ids": pa.binary()}
            return pa.record_batch({name: pa.array(c, kinds[name]) for name, c in zip(kinds, zip(*rows, strict=True), strict=True)})

        for batch in batches:
            for part in slices(batch, "word"):
                cut = part.column("word").dictionary_encode()
                own_words = cut.dictionary.to_pylist()
                ids = [last[w] if w in last else own.encode_ordinary(w) for w in own_words]
                # The rows are in order: only the last word can come again.
                last = {own_words[-1]: ids[-1]}
                flat, ends = _gathered(np.array([k for x in ids for k in x], "<u4"), np.array([len(x) for x in ids], np.int64), cut.indices.to_numpy().astype(np.int64))
                held.append((part.column("block").to_numpy(), part.column("key").to_numpy(), np.diff(ends, prepend=0), flat))
                n += part.num_rows
                if n >= PACK:
                    yield packed()
                    held, n = [], 0
        if held:
            yield packed()

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "block long, n int, keys binary, sizes binary, ids binary")


def _assembled(blocks: DataFrame, found: DataFrame, column: str, tokens: Broadcast | None = None) -> DataFrame:
    """(doc_id, column) of all documents, from blocks and what was found for their places: packs of ids, or (block, key, bytes).

    With tokens (bytes and sizes of each id) also the bytes that the ids decode to.
    """

    def unpacked(packs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each place), by place."""
        keys, sizes, ids = [], [], []
        for r in packs.to_pylist():
            keys.append(np.cumsum(_unpacked(r["keys"], r["n"])))
            sizes.append(_unpacked(r["sizes"], r["n"]))
            ids.append(_unpacked(r["ids"], int(sizes[-1].sum())).astype("<u4"))
        size = np.concatenate(sizes)
        order = np.argsort(np.concatenate(keys), kind="stable")
        return _gathered(np.concatenate(ids), size, order)[0], size[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pydict()
        sizes = np.array(block["sizes"][0], np.int64)
        out = {"doc_id": pa.array(block["ids"][0], pa.int64())}
        if not sizes.sum():  # no document of the block has any part
            return pa.table(out | {c: pa.array([b""] * len(sizes), pa.binary()) for c in ([column, "bytes"] if tokens else [column])})
        places = _unpacked(block["places"][0], int(sizes.sum()))
        if column == "bytes":
            values = right.sort_by("key").column("bytes").combine_chunks()
            out["bytes"] = _by_document(*_gathered(*_binary(values), places), sizes)[0]
            return pa.table(out)
        out["ids"], each = _by_document(*_gathered(*unpacked(right), places), sizes)
        if tokens:
            ids = np.frombuffer(out["ids"].buffers()[2], "<u4") if each.sum() else np.zeros(0, "<u4")
            out["bytes"] = _by_document(*_gathered(*tokens.value, ids), each)[0]
        return pa.table(out)

    schema = f"doc_id long, {column} binary" + (", bytes binary" if tokens else "")
    own = blocks.where("not leaves").select(F.col("block").alias("own"), "ids", "sizes", "places")
    return own.groupBy("own").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def token_bytes(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, bytes): a row for each token of the vocabulary file."""
    ranks = ranks_of(vocabulary)
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))


def encoded(docs: DataFrame, vocabulary: str | None = None, bytes: bool = False) -> DataFrame:
    """(doc_id, ids[, bytes]) of every row: ids as little-endian unsigned 32-bit numbers, and the bytes that they decode to."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    ws = Workspace(spark, "bytebpe")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = ws.save(_blocks(rows, "text", pretokens, "string"), "blocks", by=("leaves",))
    words = blocks.where("leaves").select("block", F.posexplode("parts").alias("key", "word"))
    found = ws.save(_packs(words, path), "packs", alone=True)
    ws.drop(blocks, "leaves=true")
    if not bytes:
        return _assembled(blocks, found, "ids")
    ranks = {rank: token for token, rank in ranks_of(path).items()}
    tokens = _binary(pa.array([ranks.get(i, b"") for i in range(max(ranks) + 1)], pa.binary()))
    return _assembled(blocks, found, "ids", spark.sparkContext.broadcast(tokens))


def decoded(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids) as `encoded` returns them; an id that is not in the vocabulary decodes to nothing."""
    path = vocabulary or default_vocabulary()
    ws = Workspace(ids.sparkSession, "bytebpe")

    def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        flat, size = _binary(column)
        numbers, codes = np.unique(flat.view("<u4"), return_inverse=True)
        return codes, np.concatenate(([0], np.cumsum(size // 4))), pa.array(numbers.astype(np.int32))

    blocks = ws.save(_blocks(ids.select("doc_id", "ids"), "ids", cut, "int"), "blocks", by=("leaves",))
    tokens = blocks.where("leaves").select("block", F.posexplode("parts").alias("key", "id"))
    found = tokens.join(F.broadcast(token_bytes(ids.sparkSession, path)), "id", "left").select("block", "key", F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    return _assembled(blocks, found, "bytes")


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), bytes=True)
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
