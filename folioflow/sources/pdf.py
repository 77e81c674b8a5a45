"""Scanned documents in PDF: of every page the JPEG stream that it shows, sliced out of the file.

Read are classic cross-reference tables, cross-reference and object streams, and files that
have both; where they are damaged, the objects are found by their headers. Nothing is
drawn: a page without a JPEG, and an encrypted document, cannot be taken.
"""

from __future__ import annotations

import re
import zlib
from typing import Any, NamedTuple

#: White space, what ends a token, and tokens, as the format defines them.
BLANK = rb"[\x00\t\n\x0c\r ]"
TOKEN = re.compile(rb"(?:" + BLANK + rb"+|%[^\r\n]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z]+)")
REFERENCE = re.compile(BLANK + rb"+(\d+)" + BLANK + rb"+R(?![A-Za-z])")
HEADER = re.compile(rb"(?<!\d)(\d+)" + BLANK + rb"+\d+" + BLANK + rb"+obj")
ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])")
#: References that lead to references, forms within forms, and pages below pages, at most.
DEPTH = 50


class Damaged(ValueError):
    """The file cannot be read as far as its pages need it."""


class Reference(NamedTuple):
    number: int


class Stream(NamedTuple):
    head: dict
    start: int


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, from behind the first one. Escapes stay as they are."""
    depth, start = 1, at
    for m in re.compile(rb"\\.|[()]", re.S).finditer(data, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return data[start : m.start()], m.end()
    raise Damaged("a string does not end")


def parse(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """A value and where it ends. Names keep their slash; a word that is no value is itself."""
    m = TOKEN.match(data, at)
    if not m or depth > DEPTH:
        raise Damaged(f"no value at byte {at}")
    token, at = m[1], m.end()
    if token == b"(":
        return literal(data, at)
    if token in (b"<<", b"["):
        items, end = [], b">>" if token == b"<<" else b"]"
        while True:
            m = TOKEN.match(data, at)
            if m and m[1] == end:
                break
            item, at = parse(data, at, depth + 1)
            items.append(item)
        return (dict(zip(items[::2], items[1::2], strict=False)) if token == b"<<" else items), m.end()
    if token[:1].isdigit() and (r := REFERENCE.match(data, at)):
        return Reference(int(token)), r.end()
    if token[:1] in b"+-.0123456789":
        return (float(token) if b"." in token else int(token)), at
    return {b"true": True, b"false": False, b"null": None}.get(token, token), at


def unpredicted(data: bytes, parameters: dict) -> bytes:
    """Undo the row filters of PNG, of which only none and up stand in cross-reference streams."""
    if parameters.get(b"/Predictor", 1) < 10:
        return data
    width, out, above = parameters.get(b"/Columns", 1) * parameters.get(b"/Colors", 1) * parameters.get(b"/BitsPerComponent", 8) // 8, [], None
    for at in range(0, len(data), width + 1):
        kind, row = data[at], data[at + 1 : at + 1 + width]
        if kind == 2 and above is not None:
            row = bytes((a + b) & 255 for a, b in zip(row, above, strict=False))
        elif kind not in (0, 2):
            raise Damaged("a row filter that is not known")
        out.append(row)
        above = row
    return b"".join(out)


class Document:
    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        self._held: dict[int, Any] = {}
        try:
            ends = [int(x) for x in re.findall(rb"startxref\s+(\d+)", data[-2048:])]
            self.sections(ends[-1])
            self.get(self.trailer[b"/Root"])[b"/Pages"]
        except (Damaged, IndexError, KeyError, TypeError, ValueError, zlib.error):
            self.search()
        if b"/Encrypt" in self.trailer:
            raise Damaged("the document is encrypted")

    def sections(self, at: int) -> None:
        """Cross-references from the newest section back; what is known already is newer."""
        todo, seen = [at], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            m = TOKEN.match(self.data, at)
            if m and m[1] == b"xref":
                head = self.table(m.end())
            else:
                head = self.stream_section(at)
            for key, value in head.items():
                self.trailer.setdefault(key, value)
            todo += [head[k] for k in (b"/XRefStm", b"/Prev") if isinstance(head.get(k), int)]

    def table(self, at: int) -> dict:
        while (m := TOKEN.match(self.data, at)) and m[1] != b"trailer":
            first, at = int(m[1]), m.end()
            count, at = parse(self.data, at)
            for k in range(count):
                entry = ENTRY.search(self.data, at, at + 40)
                if not entry:
                    raise Damaged("a cross-reference is missing")
                if entry[3] == b"n":
                    self.places.setdefault(first + k, int(entry[1]))
                at = entry.end()
        return parse(self.data, m.end())[0] if m else {}

    def stream_section(self, at: int) -> dict:
        stream = self.object_at(at)
        if not isinstance(stream, Stream):
            raise Damaged("no cross-references where they should be")
        rows, widths = self.decoded(stream), stream.head[b"/W"]
        index, size, at = stream.head.get(b"/Index", [0, stream.head[b"/Size"]]), sum(widths), 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + count):
                fields, left = [], rows[at : at + size]
                for w in widths:
                    fields.append(int.from_bytes(left[:w]) if w else None)
                    left = left[w:]
                kind = 1 if fields[0] is None else fields[0]
                if kind in (1, 2):
                    self.places.setdefault(number, fields[1] if kind == 1 else (fields[1], fields[2] or 0))
                at += size
        return stream.head

    def search(self) -> None:
        """Objects by their headers, the last of a number; those in object streams too."""
        self._held.clear()
        self.places = {int(m[1]): m.start() for m in HEADER.finditer(self.data)}
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= parse(self.data, m.end())[0]
            except (Damaged, TypeError, ValueError):
                continue
        for number in list(self.places):
            try:
                found = self.get(Reference(number))
                head = found.head if isinstance(found, Stream) else found
                kind = head.get(b"/Type") if isinstance(head, dict) else None
                if kind == b"/ObjStm":
                    numbers = [int(x) for x in self.decoded(found)[: head[b"/First"]].split()[::2]]
                    self.places = {n: (number, k) for k, n in enumerate(numbers)} | self.places
                elif kind == b"/XRef":
                    self.trailer |= {k: v for k, v in head.items() if k in (b"/Root", b"/Encrypt")}
            except (Damaged, KeyError, TypeError, ValueError, zlib.error):
                continue
        if not isinstance(self.get(self.trailer.get(b"/Root")), dict):
            roots = [n for n in self.places if isinstance(x := self.get(Reference(n)), dict) and x.get(b"/Type") == b"/Catalog"]
            if not roots:
                raise Damaged("no catalog")
            self.trailer[b"/Root"] = Reference(roots[-1])

    def object_at(self, at: int) -> Any:
        m = HEADER.search(self.data, at, at + 64)
        if not m:
            raise Damaged(f"no object at byte {at}")
        value, end = parse(self.data, m.end())
        start = re.compile(BLANK + rb"*stream(\r\n|\n|\r)").match(self.data, end)
        return Stream(value, start.end()) if start and isinstance(value, dict) else value

    def get(self, value: Any, depth: int = 0) -> Any:
        """The value that a reference leads to; null for none."""
        if not isinstance(value, Reference):
            return value
        if value.number not in self._held:
            place = self.places.get(value.number)
            if depth > DEPTH or place is None:
                return None
            if isinstance(place, tuple):
                holder = self.get(Reference(place[0]), depth + 1)
                data = self.decoded(holder)
                offsets = [int(x) for x in data[: holder.head[b"/First"]].split()[1::2]]
                self._held[value.number] = parse(data, holder.head[b"/First"] + offsets[place[1]])[0]
            else:
                self._held[value.number] = self.object_at(place)
        found = self._held[value.number]
        return self.get(found, depth + 1) if isinstance(found, Reference) else found

    def raw(self, stream: Stream) -> bytes:
        length = self.get(stream.head.get(b"/Length"))
        if isinstance(length, int) and re.compile(BLANK + rb"*endstream").match(self.data, stream.start + length):
            return self.data[stream.start : stream.start + length]
        end = self.data.find(b"endstream", stream.start)
        if end < 0:
            raise Damaged("a stream does not end")
        return re.sub(rb"(\r\n|\n|\r)\Z", b"", self.data[stream.start : end])

    def filters(self, stream: Stream) -> list[bytes]:
        found = self.get(stream.head.get(b"/Filter"))
        return [self.get(f) for f in found] if isinstance(found, list) else [found] if found else []

    def decoded(self, stream: Stream) -> bytes:
        """The stream without its filters; a JPEG stays one."""
        data, parameters = self.raw(stream), self.get(stream.head.get(b"/DecodeParms")) or {}
        names = self.filters(stream)
        for k, name in enumerate(names):
            if name == b"/FlateDecode":
                own = (self.get(parameters[k]) if isinstance(parameters, list) else parameters) or {}
                data = unpredicted(zlib.decompressobj().decompress(data), own)
            elif name != b"/DCTDecode":
                raise Damaged(f"filter {name.decode(errors='replace')}")
        return data

    def jpegs(self, resources: Any, depth: int = 0) -> list[tuple[int, Stream]]:
        """(pixels, stream) of the JPEGs among resources, and among those of forms."""
        found = []
        held = self.get((self.get(resources) or {}).get(b"/XObject")) or {}
        for name in sorted(held):
            item = self.get(held[name])
            if not isinstance(item, Stream):
                continue
            if item.head.get(b"/Subtype") == b"/Image" and b"/DCTDecode" in self.filters(item)[-1:]:
                found.append(((self.get(item.head.get(b"/Width")) or 0) * (self.get(item.head.get(b"/Height")) or 0), item))
            elif item.head.get(b"/Subtype") == b"/Form" and depth < 4:
                found += self.jpegs(item.head.get(b"/Resources"), depth + 1)
        return found

    def pages(self) -> list[dict]:
        """Pages in order with the resources that they inherit."""
        out, todo, seen = [], [(self.get(self.trailer[b"/Root"]).get(b"/Pages"), None)], set()
        while todo:
            reference, resources = todo.pop()
            node = self.get(reference)
            if reference in seen or not isinstance(node, dict):
                raise Damaged("the page tree is broken")
            if isinstance(reference, Reference):
                seen.add(reference)
            resources = node.get(b"/Resources", resources)
            kids = self.get(node.get(b"/Kids"))
            if isinstance(kids, list):
                todo += [(k, resources) for k in reversed(kids)]
            else:
                out.append(node | {b"/Resources": resources})
        return out


def page_images(data: bytes) -> list[bytes]:
    """The largest JPEG of every page, the first of equal ones, in the order of the pages; an error unless every page has one."""
    try:
        document = Document(data)
        out = []
        for number, page in enumerate(document.pages(), 1):
            found = document.jpegs(page[b"/Resources"])
            if not found:
                raise Damaged(f"page {number} has no JPEG")
            out.append(document.decoded(max(found, key=lambda x: x[0])[1]))
        return out
    except (AttributeError, IndexError, KeyError, RecursionError, TypeError, zlib.error) as e:
        raise Damaged(f"not a whole document: {e}") from e
