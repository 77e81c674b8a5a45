"""PDF documents: page images out of generated and damaged files."""

import re
import zlib

import pytest

from folioflow.sinks.pdf import pdf_of
from folioflow.sources import files, pdf

IMAGES = [b"\xff\xd8 one endstream 3 0 obj \xff\xd9", b"", b"\xff\xd8" + bytes(range(256)) * 40 + b"\n"]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("n", [1, 3, 40])
def test_round_trip(compressed, n):
    images = [IMAGES[k % 3] + b"%d" % k for k in range(n)]
    assert pdf.page_images(pdf_of(images, compressed)) == images


@pytest.mark.parametrize("compressed", [False, True])
def test_damaged_references_are_searched(compressed):
    images = [b"image %d" % k for k in range(5)]
    whole = pdf_of(images, compressed)
    assert pdf.page_images(re.sub(rb"startxref\s+\d+", b"startxref 7", whole)) == images
    assert pdf.page_images(whole[: whole.rindex(b"startxref")]) == images
    assert pdf.page_images(b"junk before the header\n" + whole) == images


@pytest.mark.parametrize("compressed", [False, True])
def test_halves_are_errors(compressed):
    whole = pdf_of([b"x" * 500] * 4, compressed)
    for data in (b"", b"%PDF-1.4", whole[: len(whole) // 2], whole[:100], b"\x00" * 1000, whole.replace(b"/DCTDecode", b"/JPXDecode")):
        with pytest.raises(pdf.Damaged):
            pdf.page_images(data)


def test_updates_inheritance_forms_and_filters():
    """Newer sections win; resources come from above; a JPEG may stand in a form and be deflated; the largest counts."""
    parts, places = [b"%PDF-1.4\n"], {}

    def add(number, body):
        places[number] = sum(map(len, parts))
        parts.append(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def jpeg(body, width, filters=b"/DCTDecode"):
        return b"<< /Subtype /Image /Width %d /Height 10 /Filter %s /Length 99 0 R >>\nstream\r\n%s\nendstream" % (width, filters, body)

    add(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    add(2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /XObject << /A 5 0 R /B 6 0 R >> >> >> % a note")
    add(3, b"<</Type/Page/Parent 2 0 R/Title(a \\) b (c))/Count -.5/Old <00 ff>>>")
    add(4, b"<< /Type /Page /Resources << /XObject << /F 7 0 R >> >> >>")
    add(5, jpeg(b"small", 10))
    add(6, jpeg(zlib.compress(b"large"), 20, b"[/FlateDecode /DCTDecode]"))
    add(7, b"<< /Subtype /Form /Resources << /XObject << /I 8 0 R >> >> /Length 0 >>\nstream\n\nendstream")
    add(8, jpeg(b"old", 5))

    def section(numbers, prev=b""):
        at = sum(map(len, parts))
        parts.append(b"xref\n" + b"".join(b"%d 1\n%010d 00000 n\r\n" % (k, places[k]) for k in numbers) + b"trailer\n<< /Size 9 /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (prev, at))
        return at

    first = section(range(1, 9))
    assert pdf.page_images(b"".join(parts)) == [b"large", b"old"]
    add(8, jpeg(b"new", 5))
    section([8], b"/Prev %d" % first)
    assert pdf.page_images(b"".join(parts)) == [b"large", b"new"]
    encrypted = b"".join(parts).replace(b"/Root 1 0 R /Prev", b"/Root 1 0 R /Encrypt 9 0 R /Prev")
    with pytest.raises(pdf.Damaged, match="encrypted"):
        pdf.page_images(encrypted)


def test_loops_end():
    for kids in (b"[2 0 R]", b"[3 0 R]"):
        data = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids " + kids + b" >> endobj 3 0 obj 3 0 R endobj"
        with pytest.raises(pdf.Damaged):
            pdf.page_images(data)


def test_render_is_a_lateral_join(spark):
    images = [b"page %d" % k for k in range(3)]
    rows = [("a", pdf_of(images)), ("b", pdf_of(images[:1], True)), ("broken", pdf_of(images)[:300]), ("text", b"one\ftwo"), ("empty", None), ("bytes", b"\xff\xfe")]
    pages = files.render(spark.createDataFrame(rows, "doc_stem string, content binary"))
    assert "PythonUDTF" in pages._jdf.queryExecution().toString()
    got = {(r["doc_stem"], r["page_number"]): bytes(r["image"]) for r in pages.collect()}
    assert got == {("a", 1): images[0], ("a", 2): images[1], ("a", 3): images[2], ("b", 1): images[0], ("text", 1): b"one", ("text", 2): b"two"}
