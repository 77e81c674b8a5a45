"""Page images as a PDF document, for collections that are kept as single files."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pdf_of(images: Sequence[bytes], compressed: bool = False, size: tuple[int, int] = (1000, 1414)) -> bytes:
    """A document of one JPEG a page, with a cross-reference table; ``compressed``: with object and cross-reference streams."""
    width, height = size
    n = len(images)
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(n)))}
    streams = {}
    for k, image in enumerate(images):
        plain[3 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /XObject << /Im0 %d 0 R >> >> >>" % (4 + 2 * k)
        streams[4 + 2 * k] = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>" % (width, height, len(image)), bytes(image)
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def stream(number: int, head: bytes, body: bytes) -> None:
        places[number] = (1, len(out), 0)
        out.extend(b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (number, head, body))

    for number, (head, body) in streams.items():
        stream(number, head, body)
    last = 3 + 2 * n
    if not compressed:
        for number, body in plain.items():
            places[number] = (1, len(out), 0)
            out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))
        start = len(out)
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % last + b"".join(b"%010d 00000 n \n" % places[k][1] for k in range(1, last)))
        out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (last, start))
        return bytes(out)
    offsets, bodies = [], b""
    for k, (number, body) in enumerate(plain.items()):
        offsets.append(b"%d %d" % (number, len(bodies)))
        bodies += body + b"\n"
        places[number] = (2, last, k)
    head = b" ".join(offsets) + b"\n"
    packed = zlib.compress(head + bodies)
    stream(last, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>" % (len(plain), len(head), len(packed)), packed)
    start = len(out)
    places[last + 1] = (1, start, 0)
    rows = [bytes(11)] + [bytes([places[k][0]]) + places[k][1].to_bytes(6) + places[k][2].to_bytes(4) for k in range(1, last + 2)]
    above, filtered = bytes(11), b""
    for row in rows:
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    packed = zlib.compress(filtered)
    stream(last + 1, b"<< /Type /XRef /Size %d /Root 1 0 R /W [1 6 4] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 11 >> /Length %d >>" % (last + 2, len(packed)), packed)
    out.extend(b"startxref\n%d\n%%%%EOF\n" % start)
    return bytes(out)


def documents(pages: DataFrame, compressed: Column | None = None) -> DataFrame:
    """(doc_stem, file_name, content): a PDF of the images of each document's pages in order."""

    @F.pandas_udf("binary")
    def write(images: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([pdf_of([bytes(x) for x in own], bool(p)) for own, p in zip(images, packed, strict=True)], dtype=object)

    own = pages.groupBy("doc_stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "image"))), lambda x: x["image"]).alias("images"))
    return own.select("doc_stem", F.concat("doc_stem", F.lit(".pdf")).alias("file_name"), write("images", F.lit(False) if compressed is None else compressed).alias("content"))
