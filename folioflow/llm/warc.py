"""WARC archives: written with segmentation and chunked framing, read back and reassembled.

The writer gives every page a record. Payloads that occurred before become revisits
of the page with the smallest id. A block longer than a segment goes out as a first
record and continuations that name it as their origin. The reader parses archives one
record at a time, groups continuations by origin, orders them by segment number,
checks the total length, decodes the chunked framing and verifies the digest. It also
reads archives of others: WARC/1.0, every record type, several records in a member,
files that are not compressed, digests of other kinds.

Archives go to the shared folder through pyarrow's file systems. A task writes below
names of its own attempt, and the committed manifest names the files that count, so a
repeated or lost task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import Scratch, bounded_batches, table, text_or_empty

#: Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
GZIP = b"\x1f\x8b"
#: Bytes that the reader takes at once, as they are stored and unpacked.
PIECE = 1 << 20


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body. Extensions and trailers are skipped; a body that ends early is an error."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n:
            raise ValueError("chunked body ends early")
        out.append(part)
        at = end + 4 + n


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return CRLF.join([*head, b"", block, b"", b""])


def _line(value: str) -> str:
    """A header value keeps to its line."""
    return "".join(c if c >= " " else " " for c in value)


def page_records(origin: str, page_id, url: str | None, payload: bytes, refers_to, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a whole response, or a response and its continuations."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{origin}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("WARC-Page-ID", quote(str(page_id))))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", quote(str(refers_to)))]
        yield record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + to_chunks(payload, chunk)
    if len(block) <= segment:
        yield record(fields, block)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield record([*fields, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{origin}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Segment-Number", str(k))]
        yield record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, segment: int = 32 << 10, chunk: int = 8 << 10, archive: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the manifest is (file, records, bytes)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    html = text_or_empty(pages["html"])
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    seen = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(seen, ["sha1", "size"], "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", "html", first.alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        mine = uuid.uuid4().hex
        files, out, n, written, row = [], None, 0, 0, 0
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{base}/{mine}-{len(files):05d}.warc.gz"
                    out, n, written = store.open_output_stream(name, compression=None), 0, 0
                row += 1
                for r in page_records(f"urn:uuid:{uuid.UUID(mine)}:{row}", page_id, url, html.encode(), refers_to, segment, chunk):
                    member = gzip.compress(r, level, mtime=0)
                    out.write(member)
                    n, written = n + 1, written + len(member)
                if written >= archive:
                    out.close()
                    files.append((posixpath.basename(name), n, written))
                    out = None
        if out is not None:
            out.close()
            files.append((posixpath.basename(name), n, written))
        yield pa.RecordBatch.from_pylist([{"file": f, "records": n, "bytes": w} for f, n, w in files], schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return rows.mapInArrow(work, "file string, records long, bytes long")


def unpacked(stream) -> Iterator[bytes]:
    """The bytes of a stream, its gzip members opened one after another, in pieces of bounded size."""
    rest = stream.read(PIECE)
    packed = rest.startswith(GZIP)
    while rest and not packed:
        yield rest
        rest = stream.read(PIECE)
    while rest:
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            rest = rest or stream.read(PIECE)
            if not rest:
                raise ValueError("archive ends within a member")
            yield unzip.decompress(rest, PIECE)
            rest = unzip.unconsumed_tail or unzip.unused_data
        rest = rest or stream.read(PIECE)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, lower-cased names, and the block of each record, wherever the pieces begin and end."""
    held, at = bytearray(), 0

    def more(what: str) -> None:
        nonlocal at
        del held[:at]
        at = 0
        piece = next(pieces, None)
        if piece is None:
            raise ValueError(f"archive ends within {what}")
        held.extend(piece)

    while True:
        while at == len(held):
            piece = next(pieces, None)
            if piece is None:
                return
            held, at = bytearray(piece), 0
        while (end := held.find(CRLF + CRLF, at)) < 0:
            more("a header")
        head = bytes(held[at:end])
        at = end + 4
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        # A line that begins with a blank continues the one before.
        for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(CRLF)[1:]:
            k, _, v = line.decode(errors="replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        while len(held) - at < n + 4:
            more("a block")
        if held[at + n : at + n + 4] != CRLF + CRLF:
            raise ValueError("record length differs from its header")
        block, at = bytes(held[at : at + n]), at + n + 4
        yield fields, block


def payload_of(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP headers, the body as it stands, and with its framing removed. A body said to be framed that is not stays as it is."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = {}
    for line in head.split(CRLF)[1:]:
        k, _, v = line.decode("latin-1").partition(":")
        fields[k.lower()] = v.strip()
    plain = body
    if fields.get("transfer-encoding", "").lower() == "chunked":
        try:
            plain = from_chunks(body)
        except ValueError:  # the digest tells whether this is damage
            pass
    return fields, body, plain


RECORD = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("block", T.BinaryType()),
        T.StructField("intact", T.BooleanType()),
    ]
)


def _arrow() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(RECORD)


def read_records(manifest: DataFrame, folder: str, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """Parsed records of the archives below ``folder`` that the column ``file`` names, all record types.

    A record that is whole is checked on the spot and keeps no block (its payload, if
    ``keep_payload``); a segment keeps its part of the block for reassembly. The payload of HTTP
    messages is the body, with chunked framing removed, of other records the block. ``payload_digest``
    is computed for whole payloads and copied for revisits. ``intact`` tells whether the record's own
    SHA-1 agrees, with the body or the unframed one; it is null if the record has none. A digest that
    differs is an error if ``strict``. A record that ends early or has no length is always one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        arrow = _arrow()
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in parse(unpacked(stream)):
                        row = _row(fields, block, keep_payload, strict)
                        rows.append(row)
                        held += len(row["block"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("file").mapInArrow(work, RECORD)


def _row(fields: dict[str, str], block: bytes, keep_payload: bool, strict: bool) -> dict:
    number = fields.get("warc-segment-number")
    kind = fields["warc-type"]
    total = fields.get("warc-segment-total-length")
    ids = {name: fields.get(key) for name, key in (("page_id", "warc-page-id"), ("refers_to", "warc-refers-to-page-id"))}
    row = {
        "origin": fields["warc-segment-origin-id" if kind == "continuation" else "warc-record-id"],
        "segment": int(number) if number else None,
        "total": int(total) if total else None,
        "record_type": kind,
        "url": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest"),
        "payload_bytes": None,
        "block": block,
        "intact": None,
    } | {name: None if x is None else unquote(x) for name, x in ids.items()}
    return row if number else _whole(row, keep_payload, strict)


def _whole(row: dict, keep_payload: bool, strict: bool) -> dict:
    """A complete block decoded and held against the record's digest."""
    http, body, payload = payload_of(row["block"]) if row["block"].startswith(b"HTTP/") or row["record_type"] == "revisit" else ({}, row["block"], row["block"])
    if row["record_type"] == "request":
        body = payload = row["block"]
    kind, _, given = (row["payload_digest"] or "").rpartition(":")
    if row["record_type"] == "revisit":
        length = http.get("content-length", "")
        return row | {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": given or None, "block": None}
    sha1 = digest_of(payload)
    intact = None
    if given and kind.lower() in ("", "sha1", "sha-1"):
        intact = given.upper() == sha1 or any(given.upper() in (digest_of(x), hashlib.sha1(x).hexdigest().upper()) for x in (payload, body))
    if strict and intact is False:
        raise ValueError(f"payload of page {row['page_id']} differs from its digest")
    return row | {"payload_bytes": len(payload), "payload_digest": sha1, "block": payload if keep_payload else None, "intact": intact}


def reassemble(segments: DataFrame, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """Segments grouped by origin, put in order and checked: no gap, and the total length of the last one."""
    parts = segments.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, F.struct("record_type", "payload_digest", "page_id", "refers_to", "url"))).alias("head"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                block = b"".join(p["block"] for p in r["parts"])
                if [p["segment"] for p in r["parts"]] != list(range(1, len(r["parts"]) + 1)) or r["parts"][-1]["total"] != len(block):
                    raise ValueError(f"segments of {r['origin']} are not whole")
                row = {"origin": r["origin"], "segment": None, "total": len(block), "block": block} | r["head"]
                rows.append(_whole(row, keep_payload, strict))
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    return parts.mapInArrow(work, RECORD)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives and read them back: one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, and ``block``,
    the payload of responses, with ``keep_payload``.

    * A null html counts as empty. Equal payloads of at least ``min_bytes`` bytes: those with the smallest page_id are
      responses, the others revisit it. A row without page_id revisits if any equal payload has one, else it is a response.
    * A null url is written as an empty target. An empty table writes no archive and gives no rows.
    * Ids may be numbers or strings; very long pages go out in segments. Only page_id, url and html are read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    manifest = scratch.put(write(pages, folder, min_bytes), "manifest")
    n = manifest.count()
    records = scratch.put(read_records(manifest.repartition(max(1, n)), folder, keep_payload), "records")
    whole = records.where(F.col("segment").isNull())
    joined = reassemble(records.where(F.col("segment").isNotNull()), keep_payload)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["block"] * keep_payload
    found = whole.select(columns).unionAll(joined.select(columns))
    ids = pages.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(ids) for c in ("page_id", "refers_to")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


#: Base32 of the hex digest: each five hex digits are four letters.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, octet_length(encode(html)) as payload_bytes, min(page_id) over (partition by hex) as first_id,
         list_transform(range(8), lambda g: list_reduce(list_transform(range(5), lambda k: strpos('0123456789abcdef', hex[5 * g + k + 1]) - 1), lambda x, y: 16 * x + y)) as parts
  from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (parts[1 + i // 4] // (1 << (5 * (3 - i % 4)))) % 32]), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from d
"""
