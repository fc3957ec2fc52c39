"""PNG pixels: every colour type, depth and filter, plain and interlaced; figures cut out of pages."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.sources import png

KINDS = [(c, d) for c, depths in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))) for d in depths]


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def filtered(rows, step, rng):
    """Rows of bytes, each filtered in a way of its own, byte by byte."""
    out, before = b"", bytes(len(rows[0]))
    for row in rows:
        kind = int(rng.integers(5))
        guess = [(0, (row[i - step] if i >= step else 0), before[i], ((row[i - step] if i >= step else 0) + before[i]) // 2, paeth(row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0))[kind] for i in range(len(row))]
        out += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        before = row
    return out


def packed(pixels, depth):
    if depth == 16:
        return [r.astype(">u2").tobytes() for r in pixels]
    bits = "".join
    rows = [bits(format(int(v), f"0{depth}b") for v in r.ravel()) for r in pixels]
    return [bytes(int(r[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(r), 8)) for r in rows]


def written(pixels, colour, depth, rng, interlace):
    height, width, samples = pixels.shape
    step = max(1, samples * depth // 8)
    if interlace:
        parts = [pixels[y::dy, x::dx] for x, y, dx, dy in png.PASSES]
        raw = b"".join(filtered(packed(p, depth), step, rng) for p in parts if p.size)
    else:
        raw = filtered(packed(pixels, depth), step, rng)
    chunk = lambda kind, own: struct.pack(">I", len(own)) + kind + own + struct.pack(">I", zlib.crc32(kind + own))
    data = zlib.compress(raw)
    head = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlace)))
    extra = chunk(b"PLTE", bytes(range(48))) + chunk(b"tRNS", b"\x00\xff") if colour == 3 else b""
    return head + extra + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"tEXt", b"x") + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize(("colour", "depth"), KINDS)
def test_round_trip(colour, depth, interlace):
    rng = np.random.default_rng(depth + colour)
    for height, width in ((1, 1), (1, 9), (9, 1), (13, 11), (3, 40)):
        pixels = rng.integers(0, 2**depth, (height, width, png.SAMPLES[colour])).astype(np.uint16 if depth == 16 else np.uint8)
        image = png.decode(written(pixels, colour, depth, rng, interlace))
        assert (image.pixels == pixels).all() and (image.width, image.height) == (width, height)
        again = png.decode(png.encode(image))
        assert (again.pixels == pixels).all() and (again.palette, again.transparency) == (image.palette, image.transparency)
        assert (png.decode(written(pixels, colour, depth, rng, interlace), 2).pixels == pixels[:2]).all()
        cut = png.cropped(image, -1, 0, width // 2 + 1, height + 2)
        want = np.zeros((height + 2, width // 2 + 2, pixels.shape[2]), pixels.dtype)
        want[:height, 1:] = pixels[:, : width // 2 + 1]
        assert (png.decode(png.encode(cut)).pixels == want).all()


def test_broken_images():
    rng = np.random.default_rng(1)
    good = written(rng.integers(0, 256, (5, 5, 3)).astype(np.uint8), 2, 8, rng, False)
    for data in (b"", b"x" * 50, good[:20], good[:60], good.replace(b"IDAT", b"xDAT"), good[:24] + b"\x07" + good[25:]):
        with pytest.raises(png.PngError):
            png.decode(data)


def test_figures_of_pages(spark):
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (64, 128, 3)).astype(np.uint8)
    pages = spark.createDataFrame([("d", 1, bytearray(written(pixels, 2, 8, rng, False))), ("d", 2, bytearray(b"broken"))], "doc_id string, page int, png binary")
    boxes = [("d", 1, "p0_f0.png", 0, 0, 512, 1024), ("d", 1, "p0_f1.png", 256, 128, 1024, 300), ("d", 2, "p1_f2.png", 0, 0, 9, 9), ("d", 3, "p2_f3.png", 0, 0, 9, 9), ("d", 1, "p0_f4.png", 5, 5, 6, 6)]
    figures = spark.createDataFrame(boxes, "doc_id string, page int, figure_id string, x1 int, y1 int, x2 int, y2 int")
    got = {r["figure_id"]: r for r in png.figure_images(figures, pages).collect()}
    assert (png.decode(bytes(got["p0_f0.png"]["png"])).pixels == pixels[:, :64]).all()
    assert (png.decode(bytes(got["p0_f1.png"]["png"])).pixels == pixels[8:18, 32:128]).all()
    assert {k: r["error"] for k, r in got.items() if r["png"] is None} == {"p1_f2.png": "not a PNG file", "p2_f3.png": "no page image", "p0_f4.png": "a box without area"}
    assert [tuple(r) for r in pages.select(*png.size_of(F.col("png"))).collect()] == [(128, 64), (None, None)]
