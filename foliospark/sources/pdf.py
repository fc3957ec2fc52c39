"""The number of pages of PDF files, read from their structure: cross-reference tables and streams, object streams, page tree.

A file is one row (binaryFile), so any store that Spark reads will do. What is read of a file: the chain of
cross-references from the end, the catalog, the root of the page tree. Where that is broken the objects are found by
looking through the file: the page tree's root again, and failing that the page objects themselves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
#: Largest size of an unpacked stream; a file that needs more is taken as broken.
MOST_BYTES = 1 << 28


class PdfError(ValueError):
    """What makes a file unreadable."""


class Name(str):
    """A PDF name."""


class Ref(tuple):
    """A reference: number and generation of an object."""


class Word(bytes):
    """A keyword such as obj, R or stream."""


class Parser:
    """Values at a place of a file: numbers, names, strings, arrays, dictionaries, references."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c == 0x25:  # a comment, up to the end of the line
                while self.at < len(self.data) and self.data[self.at] not in b"\r\n":
                    self.at += 1
            elif c in _SPACE:
                self.at += 1
            else:
                return

    def token(self):
        self.skip()
        d, i = self.data, self.at
        if i >= len(d):
            raise PdfError("unexpected end")
        two = d[i : i + 2]
        if two in (b"<<", b">>"):
            self.at += 2
            return Word(two)
        if d[i] in b"[]{}":
            self.at += 1
            return Word(d[i : i + 1])
        if d[i] == 0x28:
            return self._string()
        if d[i] == 0x3C:
            end = d.find(b">", i)
            if end < 0:
                raise PdfError("open string")
            self.at = end + 1
            return bytes(d[i + 1 : end])
        slash = d[i] == 0x2F
        j = i + 1
        while j < len(d) and d[j] not in _SPACE and d[j] not in _DELIMITERS:
            j += 1
        self.at = j
        if slash:
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), d[i + 1 : j]).decode("latin-1"))
        own = d[i:j]
        if re.fullmatch(rb"[+-]?\d+", own):
            return int(own)
        if re.fullmatch(rb"[+-]?\d*\.\d*", own):
            return float(own) if own.strip(b"+-.") else 0.0
        return Word(own)

    def _string(self) -> bytes:
        depth, i = 0, self.at
        while i < len(self.data):
            c = self.data[i]
            if c == 0x5C:
                i += 1
            elif c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    out, self.at = self.data[self.at + 1 : i], i + 1
                    return bytes(out)
            i += 1
        raise PdfError("open string")

    def value(self, depth: int = 0):
        if depth > 64:
            raise PdfError("nested too deep")
        t = self.token()
        if isinstance(t, Word):
            if t == b"<<":
                out = {}
                while True:
                    key = self.token()
                    if isinstance(key, Word) and key == b">>":
                        return out
                    if not isinstance(key, Name):
                        raise PdfError("a dictionary without a name")
                    out[str(key)] = self.value(depth + 1)
            if t == b"[":
                out = []
                while True:
                    self.skip()
                    if self.data[self.at : self.at + 1] == b"]":
                        self.at += 1
                        return out
                    out.append(self.value(depth + 1))
            return {b"true": True, b"false": False, b"null": None}.get(bytes(t), t)
        if isinstance(t, int) and not isinstance(t, bool) and t >= 0:
            back = self.at
            m = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(self.data, back)
            if m:
                self.at = m.end()
                return Ref((t, int(m[1])))
        return t


class Pdf:
    """The objects of a file, found by its cross-references."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.trailer, self.cache = data, {}, {}, {}
        # Offsets count from the header, which junk may precede.
        self.base = max(0, data[:1024].find(b"%PDF-"))

    def load(self) -> Pdf:
        tail = self.data.rfind(b"startxref")
        if tail < 0:
            raise PdfError("no startxref")
        at, seen = Parser(self.data, tail + 9).token(), set()
        queue = [at]
        while queue:
            at = queue.pop(0)
            if not isinstance(at, int) or at in seen or not 0 <= at + self.base < len(self.data):
                if at in seen:
                    continue
                raise PdfError("a cross-reference outside the file")
            seen.add(at)
            found = self._section(at + self.base)
            # What is newer comes first and stays.
            self.trailer = found | self.trailer
            queue += [found[k] for k in ("XRefStm", "Prev") if k in found]
        return self

    def _section(self, at: int) -> dict:
        p = Parser(self.data, at)
        p.skip()
        if self.data[p.at : p.at + 4] != b"xref":
            return self._stream_section(p.at)
        p.at += 4
        while True:
            t = p.token()
            if t == b"trailer":
                out = p.value()
                if not isinstance(out, dict):
                    raise PdfError("no trailer")
                return out
            n = p.token()
            if not isinstance(t, int) or not isinstance(n, int):
                raise PdfError("a broken table")
            for number in range(t, t + n):
                place, generation, kind = p.token(), p.token(), p.token()
                if kind == b"n" and isinstance(place, int):
                    self.places.setdefault(number, ("at", place + self.base))
                elif kind == b"f":
                    self.places.setdefault(number, None)
                elif kind != b"n":
                    raise PdfError("a broken table")

    def _stream_section(self, at: int) -> dict:
        own, rows = self._object_at(at)
        if not isinstance(own, dict) or own.get("Type") != "XRef" or rows is None:
            raise PdfError("no cross-reference")
        widths = own["W"]
        index = own.get("Index", [0, own["Size"]])
        size, k = sum(widths), 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + n):
                row, fields, i = rows[k * size : (k + 1) * size], [], 0
                if len(row) < size:
                    raise PdfError("a short cross-reference")
                for w in widths:
                    fields.append(int.from_bytes(row[i : i + w], "big"))
                    i += w
                kind = fields[0] if widths[0] else 1
                self.places.setdefault(number, ("at", fields[1] + self.base) if kind == 1 else ("in", fields[1], fields[2]) if kind == 2 else None)
                k += 1
        return own

    def _object_at(self, at: int, number: int | None = None) -> tuple:
        """(value, unpacked stream or None) of the object that begins there."""
        p = Parser(self.data, at)
        head = p.token(), p.token(), p.token()
        if head[2] != b"obj" or (number is not None and head[0] != number):
            raise PdfError("no object where the cross-reference says")
        out = p.value()
        p.skip()
        if not isinstance(out, dict) or self.data[p.at : p.at + 6] != b"stream":
            return out, None
        start = p.at + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1
        length = out.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        if not isinstance(length, int) or not self.data[start + length : start + length + 12].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", start)
            if end < 0:
                raise PdfError("an open stream")
            length = end - start
        return out, self._unpacked(out, self.data[start : start + length])

    def _unpacked(self, head: dict, raw: bytes) -> bytes | None:
        filters, parms = head.get("Filter", []), head.get("DecodeParms", [])
        filters = filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        if head.get("Type") not in ("XRef", "ObjStm"):
            return None
        for k, f in enumerate(filters):
            if f not in ("FlateDecode", "Fl"):
                raise PdfError(f"filter {f}")
            raw = zlib.decompressobj().decompress(raw, MOST_BYTES)
            parm = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
            if parm.get("Predictor", 1) >= 10:
                raw = _without_predictor(raw, parm.get("Columns", 1))
        return raw

    def get(self, ref: object, depth: int = 0):
        """The value of a reference; of anything else itself."""
        if not isinstance(ref, Ref):
            return ref
        if depth > 32:
            raise PdfError("references in a circle")
        place = self.places.get(ref[0])
        if place is None:
            return None
        if place[0] == "at":
            out = self._object_at(place[1], ref[0])[0]
        else:
            out = self._packed_objects(place[1]).get(ref[0])
        return self.get(out, depth + 1)

    def _packed_objects(self, number: int) -> dict:
        if number not in self.cache:
            place = self.places.get(number)
            if place is None or place[0] != "at":
                raise PdfError("no object stream")
            self.cache[number] = _objects_of(*self._object_at(place[1], number))
        return self.cache[number]

    def page_count(self) -> int:
        if "Encrypt" in self.trailer and any(p and p[0] == "in" for p in self.places.values()):
            raise PdfError("encrypted")
        root = self.get(self.trailer.get("Root"))
        tree = self.get(root.get("Pages")) if isinstance(root, dict) else None
        count = self.get(tree.get("Count")) if isinstance(tree, dict) else None
        if not isinstance(count, int) or count < 0:
            raise PdfError("no page tree")
        return count


def _objects_of(head: dict, raw: bytes | None) -> dict:
    """The objects of an object stream by number."""
    if not isinstance(head, dict) or raw is None or not isinstance(head.get("N"), int):
        raise PdfError("no object stream")
    p, out = Parser(raw), {}
    pairs = [(p.token(), p.token()) for _ in range(head["N"])]
    for number, at in pairs:
        out[number] = Parser(raw, head["First"] + at).value()
    return out


def _without_predictor(raw: bytes, columns: int) -> bytes:
    """Rows of PNG prediction, of which cross-references use none and up."""
    out, before = bytearray(), bytes(columns)
    for i in range(0, len(raw) - columns, columns + 1):
        kind, row = raw[i], raw[i + 1 : i + 1 + columns]
        if kind == 2:
            row = bytes((a + b) & 255 for a, b in zip(row, before, strict=True))
        elif kind == 1:
            own = bytearray(row)
            for k in range(1, columns):
                own[k] = (own[k] + own[k - 1]) & 255
            row = bytes(own)
        elif kind:
            raise PdfError("a predictor that cross-references don't use")
        out += row
        before = row
    return bytes(out)


def _rescued(data: bytes) -> int:
    """The number of pages from the objects themselves, wherever they are."""
    pdf, found = Pdf(data), {}
    for m in re.finditer(rb"(?<!\d)(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj", data):
        pdf.places[int(m[1])] = ("at", m.start())  # the last of a number is the newest
    for number, (_, at) in list(pdf.places.items()):
        try:
            own, raw = pdf._object_at(at)
            if isinstance(own, dict) and own.get("Type") == "ObjStm":
                found |= _objects_of(own, raw)
            else:
                found[number] = own
        except (PdfError, zlib.error, KeyError, TypeError, IndexError):
            continue
    dicts = {k: v for k, v in found.items() if isinstance(v, dict)}
    resolve = lambda v: found.get(v[0]) if isinstance(v, Ref) else v
    roots = [v for v in dicts.values() if v.get("Type") == "Pages" and "Parent" not in v and isinstance(resolve(v.get("Count")), int)]
    pages = sum(v.get("Type") == "Page" for v in dicts.values())
    if not roots and not pages:
        raise PdfError("no pages found")
    # A tree that says more than there is was cut off.
    return min(resolve(roots[-1]["Count"]), pages) if roots and pages else pages or resolve(roots[-1]["Count"])


def page_count(data: bytes) -> int:
    """The number of pages of a PDF file; PdfError if it has none that can be found."""
    if b"%PDF-" not in data[:1024]:
        raise PdfError("not a PDF file")
    try:
        return Pdf(data).load().page_count()
    except (PdfError, zlib.error, KeyError, TypeError, ValueError, IndexError, RecursionError) as e:
        if str(e) == "encrypted":
            raise
        return _rescued(data)


def with_page_count(files: DataFrame) -> DataFrame:
    """Files (task_id, filename, path, content) as tasks (task_id, filename, path, page_count, error): a file that is no PDF has an error and no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, errors = [], []
            for content in batch["content"]:
                try:
                    counts.append(page_count(bytes(content) if content is not None else b""))
                    errors.append(None)
                except (PdfError, zlib.error) as e:
                    counts.append(0)
                    errors.append(str(e))
            yield batch[["task_id", "filename", "path"]].assign(page_count=pd.array(counts, "int32"), error=errors)

    return files.select("task_id", "filename", "path", "content").mapInPandas(run, "task_id string, filename string, path string, page_count int, error string")
