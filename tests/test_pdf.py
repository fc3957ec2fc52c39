"""Page counts of PDF files in all the ways that their structure is written down."""

import zlib

import pytest

from foliospark.sources import files, pdf


def objects(n, tree="2 0"):
    kids = " ".join(f"{i + 3} 0 R" for i in range(n))
    return {1: b"<< /Type /Catalog /Pages 2 0 R /Note (a \\) b (c) 9 0 obj) >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode()} | {
        i + 3: f"<< /Type /Page /Parent {tree} R /MediaBox [0 0 612.0 -.5] >>".encode() for i in range(n)
    }


def body(objs, head=b"%PDF-1.7\n%\xe2\xe3\n"):
    out, at = bytearray(head), {}
    for k, v in objs.items():
        at[k] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    return out, at


def classic(objs, more=b"", out=None, at=None):
    if out is None:
        out, at = body(objs)
    start, size = len(out), max(at) + 1
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for k in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (k, at[k])
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, more, start))


def predicted(rows, width):
    out, before = bytearray(), bytes(width)
    for r in rows:
        out += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before))
        before = r
    return zlib.compress(bytes(out))


def streamed(n, pack=True, predictor=True):
    """Everything but the streams themselves in an object stream, found by a cross-reference stream."""
    objs = objects(n)
    inside, places, at = b"", [], 0
    for k, v in objs.items():
        places.append(b"%d %d" % (k, len(inside)))
        inside += v + b" "
    head = b" ".join(places) + b"\n"
    packed = zlib.compress(head + inside)
    number = max(objs) + 1
    out = bytearray(b"%PDF-1.5\n")
    first = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\r\n%s\nendstream\nendobj\n" % (number, len(objs), len(head), len(packed), packed)
    start = len(out)
    rows = [bytes([0, 0, 0, 0, 255])]
    rows += [bytes([2]) + number.to_bytes(3, "big") + bytes([i]) for i in range(len(objs))]
    rows += [bytes([1]) + first.to_bytes(3, "big") + b"\0", bytes([1]) + start.to_bytes(3, "big") + b"\0"]
    data = predicted(rows, 5) if predictor else zlib.compress(b"".join(rows))
    parms = b"/DecodeParms << /Predictor 12 /Columns 5 >>" if predictor else b""
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 3 1] /Root 1 0 R /Filter /FlateDecode %s /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (number + 1, number + 2, parms, len(data), data, start)
    return bytes(out)


def updated(n, m):
    """A file with n pages that was saved again with m: a second table over the first."""
    old = classic(objects(n))
    first = old.rfind(b"xref\n0 1")
    out, at = bytearray(old), {}
    for k, v in objects(m).items():
        if k == 2 or k > n + 2:
            at[k] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    return classic(None, b"/Prev %d" % first, out, at)


def linearised(n):
    """The first page's table in front, with the rest as its /Prev."""
    objs = objects(n)
    out, at = body({k: v for k, v in objs.items() if k > 3})
    rest = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for k in at:
        out += b"%d 1\n%010d 00000 n \n" % (k, at[k])
    out += b"trailer\n<< /Size %d >>\n" % (max(objs) + 1)
    front = {}
    for k in (1, 2, 3):
        if k in objs:
            front[k] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, objs[k])
    return classic(None, b"/Prev %d" % rest, out, front)


CASES = {
    "classic": (classic(objects(4)), 4), "no pages": (classic(objects(0)), 0), "junk in front": (b"junk\r\n" + classic(objects(3)), 3), "streams": (streamed(5), 5), "without predictor": (streamed(7, predictor=False), 7),
    "saved again": (updated(2, 6), 6), "linearised": (linearised(9), 9), "many": (classic(objects(2000)), 2000), "no startxref": (classic(objects(4)).replace(b"startxref", b"nothing"), 4),
    "wrong offset": (classic(objects(4)).replace(b"startxref\n", b"startxref\n99"), 4), "cut off within the pages": (classic(objects(6))[:-400], 4), "streams without reference": (streamed(5).replace(b"startxref", b"nothing"), 5),
    "pages in a lost object": (b"".join(classic(objects(4)).partition(b"5 0 obj")[:1]), 2), "length wrong": (streamed(5).replace(b"/Length ", b"/Length 9"), 5),
    "indirect count": (classic(objects(3) | {2: b"<< /Type /Pages /Kids [3 0 R] /Count 9 0 R >>", 9: b"3"}), 3), "circle": (classic(objects(3), b"/Prev 15 "), 3),
}


@pytest.mark.parametrize("name", CASES)
def test_page_count(name):
    data, want = CASES[name]
    assert pdf.page_count(data) == want


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4", b"hello", b"%PDF-1.4\n(((", bytes(5000)])
def test_what_is_no_pdf(data):
    with pytest.raises(pdf.PdfError):
        pdf.page_count(data)


def test_tasks_and_pages_of_files(spark, tmp_path):
    for name, data in (("a.pdf", streamed(3)), ("b.pdf", b"no"), ("c.PDF", classic(objects(2))), ("d.pdf", classic(objects(2)))):
        (tmp_path / name).write_bytes(data)
    tasks = pdf.with_page_count(files.pdf_files(spark, str(tmp_path)))
    assert sorted((r["filename"], r["page_count"], r["error"]) for r in tasks.collect()) == [("a.pdf", 3, None), ("b.pdf", 0, "not a PDF file"), ("d.pdf", 2, None)]
    assert sorted((r["filename"], r["page"]) for r in files.pages(tasks, end=2).collect()) == [("a.pdf", 0), ("a.pdf", 1), ("d.pdf", 0), ("d.pdf", 1)]
