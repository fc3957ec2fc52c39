"""ZIP bundles of documents, made as a stream: entries in order become chunks of bytes, of which a task holds one at a time.

An entry may come in parts (a document's Markdown block by block), so neither a document nor its bundle is ever whole in
memory. Bundles are rows (doc_id, chunk, bytes); joined in the order of their chunks they are a ZIP file.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: What an entry is packed as; names come back as they were, times are fixed so that a bundle is the same again.
_TIME = (1980, 1, 1, 0, 0, 0)


class _Out:
    """Takes what a ZIP writer writes; `taken` hands it on."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0

    def write(self, own: bytes) -> int:
        self.parts.append(bytes(own))
        self.size += len(own)
        return len(own)

    def flush(self) -> None:
        pass

    def taken(self) -> bytes:
        own, self.parts, self.size = b"".join(self.parts), [], 0
        return own


class _Bundle:
    """A document's ZIP file as it grows."""

    def __init__(self, doc_id: object) -> None:
        self.doc_id, self.chunk, self.out, self.name, self.entry = doc_id, 0, _Out(), None, None
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)

    def add(self, name: str, content: bytes) -> None:
        if name != self.name:
            self._close_entry()
            self.name = name
            info = zipfile.ZipInfo(name, _TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            self.entry = self.zip.open(info, "w", force_zip64=True)
        self.entry.write(content)

    def _close_entry(self) -> None:
        if self.entry is not None:
            self.entry.close()

    def close(self) -> None:
        self._close_entry()
        self.zip.close()

    def row(self) -> tuple:
        own = self.doc_id, self.chunk, self.out.taken()
        self.chunk += 1
        return own


def bundles(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, chunk, bytes) of entries (doc_id, place, name, part, content binary): by place and name, parts of a name one after another.

    Entries without content are left out; a document without any has no bundle. `place` and `part` are numbers. Two
    entries of one place and name become one.
    """
    kind = entries.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]), ("chunk", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Bundle | None = None

        def batch_of(row: tuple) -> pa.RecordBatch:
            return pa.record_batch([[v] for v in row], schema=schema)

        for batch in batches:
            for doc_id, name, content in zip(*(batch.column(c) for c in ("doc_id", "name", "content")), strict=True):
                if own is None or own.doc_id != doc_id.as_py():
                    if own is not None:
                        own.close()
                        yield batch_of(own.row())
                    own = _Bundle(doc_id.as_py())
                own.add(name.as_py(), content.as_py())
                if own.out.size >= chunk:
                    yield batch_of(own.row())
        if own is not None:
            own.close()
            yield batch_of(own.row())

    ordered = entries.where("content is not null and name is not null").repartition("doc_id").sortWithinPartitions("doc_id", "place", "name", "part")
    return ordered.select("doc_id", "name", "content").mapInArrow(run, f"doc_id {kind.simpleString()}, chunk int, bytes binary")


def entries_of(pieces: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Entries of Markdown pieces (doc_id, page, seq, piece), as translation.md, and of figures (doc_id, figure_id, png) under their names."""
    part = (F.col("page").cast("long") * (1 << 32) + F.col("seq")).alias("part")
    text = pieces.select("doc_id", F.lit(0).alias("place"), F.lit("translation.md").alias("name"), part, F.col("piece").cast("binary").alias("content"))
    if figures is None:
        return text
    return text.unionByName(figures.select("doc_id", F.lit(1).alias("place"), F.col("figure_id").alias("name"), F.lit(0).cast("long").alias("part"), F.col("png").alias("content")))


def read(chunks: DataFrame, doc_id: object) -> Iterator[bytes]:
    """The bytes of a document's bundle, chunk by chunk: what a server sends."""
    for r in chunks.where(F.col("doc_id") == F.lit(doc_id)).orderBy("chunk").toLocalIterator():
        yield bytes(r["bytes"])


def save(chunks: DataFrame, doc_id: object, path: str) -> None:
    """Writes a document's bundle as a file to any store that Spark writes to."""
    jvm, conf = chunks.sparkSession._jvm, chunks.sparkSession._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place, True)
    try:
        for own in read(chunks, doc_id):
            out.write(bytearray(own))
    finally:
        out.close()
