"""PNG pixels: figures cut out of page images, in numpy within tasks.

All colour types and bit depths, plain and interlaced. Rows are unpacked only down to the lowest edge that is asked for.
A cut keeps the page's colour type, depth, palette and transparency, so its pixels are the page's; what lies
outside the page is 0.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.blocks import crop_box

# The signature, samples of each colour type, the seven passes (first column, first row, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Most bytes of the rows of one image that are held at a time.
MOST_BYTES = 1 << 29


class PngError(ValueError):
    """What makes an image unreadable."""


@dataclass
class Image:
    width: int
    height: int
    depth: int
    colour: int
    #: rows x columns x samples; of 16 bits uint16, else uint8. Rows may end early.
    pixels: np.ndarray
    palette: bytes = b""
    transparency: bytes = b""


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of filtered bytes (n, width) as they were before; `step`: bytes from a pixel to the one left of it.

    A byte follows from those left, above and above left of it, so the bytes of an anti-diagonal do not depend on each
    other: each diagonal is worked out at once.
    """
    n, width = rows.shape
    if not n or not width:
        return rows
    if np.isin(kinds, (0, 2)).all():
        # Nothing looks to the left: sums down the columns, begun anew at rows that stand for themselves.
        out = np.empty_like(rows)
        starts = np.flatnonzero(np.append(kinds == 0, True))
        first = 0
        for s in starts[starts > 0].tolist():
            out[first:s] = np.cumsum(rows[first:s], axis=0, dtype=np.uint8)
            first = s
        return out
    across = -(-width // step)
    # With a row above and a column to the left of zeros; a pixel is `step` bytes.
    held = np.zeros((n + 1, across + 1, step), np.int16)
    held[1:, 1:] = np.pad(rows, ((0, 0), (0, across * step - width))).reshape(n, across, step)
    flat, pitch = held.reshape(-1, step), across + 1
    for t in range(n + across - 1):
        low, high = max(0, t - across + 1), min(n, t + 1)
        # Row r, column t - r: one pitch less one apart.
        begin, span = (low + 1) * pitch + t - low + 1, (high - low - 1) * (pitch - 1) + 1
        pick = lambda shift: flat[begin + shift : begin + shift + span : pitch - 1]  # noqa: B023, E731
        own, left, up, corner = pick(0), pick(-1), pick(-pitch), pick(-pitch - 1)
        kind = kinds[low:high, None]
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        own += np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        own &= 255
    return held[1:, 1:].reshape(n, -1)[:, :width].astype(np.uint8)


def _samples(rows: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """Bytes of rows as samples (n, width, samples)."""
    n = len(rows)
    if depth == 16:
        return rows.reshape(n, -1).view(">u2").astype(np.uint16).reshape(n, width, samples)
    if depth == 8:
        return rows.reshape(n, width, samples)
    bits = np.unpackbits(rows, axis=1)[:, : width * samples * depth].reshape(n, -1, depth)
    return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8).reshape(n, width, samples)


def size_of(png: Column) -> tuple[Column, Column]:
    """(width, height) of a PNG, null for what is none."""
    number = lambda at: F.conv(F.hex(F.substring(png, at, 4)), 16, 10).cast("int")
    good = F.hex(F.substring(png, 1, 8)) == SIGNATURE.hex().upper()
    return F.when(good, number(17)), F.when(good, number(21))


def decode(data: bytes, rows: int | None = None) -> Image:
    """The image, its pixels down to `rows`."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG file")
    at, head, parts, palette, transparency = 8, None, [], b"", b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(own) == 13:
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"PLTE":
            palette = own
        elif kind == b"tRNS":
            transparency = own
        elif kind == b"IDAT":
            parts.append(own)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise PngError("no header")
    width, height, depth, colour, packing, filtering, interlace = head
    if colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or packing or filtering or interlace > 1 or not width or not height or (depth < 8 and colour in (2, 4, 6)) or (colour == 3 and depth == 16):
        raise PngError("a header that no PNG file has")
    samples = SAMPLES[colour]
    wanted = height if rows is None else max(0, min(rows, height))
    bits = samples * depth
    stride = lambda w: -(-w * bits // 8)
    passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in PASSES] if interlace else [(0, 0, 1, 1, width, wanted)]
    passes = [p for p in passes if p[4] > 0 and p[5] > 0]
    total = sum((stride(w) + 1) * h for *_, w, h in passes)
    if total > MOST_BYTES:
        raise PngError("too large")
    try:
        raw = zlib.decompressobj().decompress(b"".join(parts), total) if total else b""
    except zlib.error as e:
        raise PngError(f"broken data: {e}") from e
    if len(raw) < total:
        raise PngError("data that ends early")
    pixels, at = np.zeros((height if interlace else wanted, width, samples), np.uint16 if depth == 16 else np.uint8), 0
    for x, y, dx, dy, w, h in passes:
        n = (stride(w) + 1) * h
        own = np.frombuffer(raw, np.uint8, n, at).reshape(h, -1)
        at += n
        if (own[:, 0] > 4).any():
            raise PngError("a filter that is none")
        pixels[y::dy, x::dx] = _samples(unfiltered(own[:, 0].astype(np.int16), np.ascontiguousarray(own[:, 1:]), max(1, bits // 8)), w, depth, samples)
    return Image(width, height, depth, colour, pixels[:wanted], palette, transparency)


def encode(image: Image) -> bytes:
    """A PNG file of the image's pixels."""
    n, width, samples = image.pixels.shape
    if image.depth == 16:
        rows = np.ascontiguousarray(image.pixels.astype(">u2")).view(np.uint8).reshape(n, -1)
    elif image.depth == 8:
        rows = np.ascontiguousarray(image.pixels, np.uint8).reshape(n, -1)
    else:
        bits = (image.pixels.reshape(n, width * samples, 1) >> np.arange(image.depth - 1, -1, -1, dtype=np.uint8)) & 1
        rows = np.packbits(bits.reshape(n, -1).astype(np.uint8), axis=1)
    # Differences to the row above, but for palettes and few bits, where they don't help.
    if image.depth >= 8 and image.colour != 3:
        rows = np.concatenate((np.full((n, 1), 2, np.uint8), np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8))), axis=1)
    else:
        rows = np.concatenate((np.zeros((n, 1), np.uint8), rows), axis=1)
    chunk = lambda kind, own: struct.pack(">I", len(own)) + kind + own + struct.pack(">I", zlib.crc32(kind + own))
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, n, image.depth, image.colour, 0, 0, 0))
    if image.palette:
        out += chunk(b"PLTE", image.palette)
    if image.transparency:
        out += chunk(b"tRNS", image.transparency)
    return out + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def cropped(image: Image, x1: int, y1: int, x2: int, y2: int) -> Image:
    """The pixels of a box; 0 outside the image."""
    if x2 <= x1 or y2 <= y1:
        raise PngError("a box without area")
    own = image.pixels[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
    out = np.zeros((y2 - y1, x2 - x1, own.shape[2]), own.dtype)
    top, left = max(0, -y1), max(0, -x1)
    out[top : top + own.shape[0], left : left + own.shape[1]] = own
    return Image(x2 - x1, y2 - y1, image.depth, image.colour, out, image.palette, image.transparency)


def figure_images(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, figure_id, png, error) of figures (doc_id, page, figure_id, x1, y1, x2, y2 in model space) on page images (doc_id, page, png).

    The boxes of a page are few and go to its image together, so it is unpacked once. A figure whose page is missing or
    broken, or whose box has no area in pixels, has an error and no image.
    """
    place = F.struct("figure_id", "x1", "y1", "x2", "y2")
    asked = figures.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(place)).alias("boxes"))
    joined = asked.join(pages.select("doc_id", "page", "png"), ["doc_id", "page"], "left")
    width, height = size_of(F.col("png"))
    boxes = F.transform("boxes", lambda b: F.struct(b["figure_id"].alias("figure_id"), crop_box(b, width, height).alias("at")))
    kind = figures.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, page, png, boxes_ in batch.itertuples(index=False):
                rows, image, error = [], None, None
                # Without a size the box has no pixels.
                wanted = [(b["figure_id"], *(int(v) if v is not None and v == v else 0 for v in (b["at"][k] for k in ("x1", "y1", "x2", "y2")))) for b in boxes_]
                try:
                    if png is None:
                        raise PngError("no page image")
                    image = decode(bytes(png), max(w[4] for w in wanted))
                except (PngError, struct.error) as e:
                    error = str(e)
                for name, *box in wanted:
                    try:
                        rows.append((doc_id, page, name, encode(cropped(image, *box)) if image is not None else None, error))
                    except PngError as e:
                        rows.append((doc_id, page, name, None, str(e)))
                yield pd.DataFrame(rows, columns=["doc_id", "page", "figure_id", "png", "error"])

    page_kind = figures.schema["page"].dataType.simpleString()
    return joined.select("doc_id", "page", "png", boxes.alias("boxes")).mapInPandas(run, f"doc_id {kind}, page {page_kind}, figure_id string, png binary, error string")
