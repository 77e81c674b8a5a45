"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is cut into pre-tokens by the vocabulary's pattern. Each pre-token's UTF-8
bytes become characters by the byte-to-character table of byte-level BPE, the BPE
model of the library merges them, and decoding reverses the table. Pre-tokens are
encoded once and remembered in two generations of bounded entries of bounded length,
so that memory does not grow with the corpus, nor with texts that have no spaces.

Cutting at spaces first is exact: where a single space stands between two
characters that are not white space, every supported pattern starts a new match at
that space, and no match looks past it. A text with any other white space next to a
space is cut only where that holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import bounded_batches, table, text_or_empty

#: Entries of one generation of the memory of encoded pieces, in each Python worker, and characters of a piece that is remembered.
MEMORY = 400_000
LONGEST = 64
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The character of each byte: itself where it prints in Latin-1, else the next one from U+0100."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD):
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Codec:
    """One vocabulary: ``ids_of`` encodes a pre-token, ``bytes_of`` holds the bytes of each id."""

    def __init__(self, model, vocab: dict[str, int], pattern: str):
        import regex

        self.model = model
        self.find = regex.compile(pattern).findall
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.space = chars[ord(" ")]
        back = {ord(c): b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(ord(c) in back for c in token):
                self.bytes_of[i] = token.translate(back).encode("latin-1")
        self._words: dict[str, array] = {}
        self._old: dict[str, array] = {}

    def made(self, word: str) -> array:
        """Ids of one pre-token, by the model."""
        if word.isascii() and word.isprintable():
            mapped = word.replace(" ", self.space)
        else:
            mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        return array("I", [t.id for t in self.model.tokenize(mapped)])

    def ids_of(self, word: str) -> array:
        """Ids of one pre-token, remembered unless it is long."""
        found = self._words.get(word)
        if found is None:
            found = self._old.get(word)
            if found is None:
                found = self.made(word)
                if len(word) > LONGEST:
                    return found
            if len(self._words) >= MEMORY:
                self._old, self._words = self._words, {}
            self._words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.find(text):
            out.extend(self.ids_of(word))
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def spans(self, text: str, ids) -> tuple[list[int], list[int]]:
        """First character and end of each token. Tokens that split a character all report that character."""
        owner = [i for i, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]
        starts, ends, at = [], [], 0
        for i in ids:
            size = len(self.bytes_of[i])
            starts.append(owner[at])
            ends.append(owner[at + size - 1] + 1)
            at += size
        return starts, ends


def codec_from_ranks(path: str, pattern: str) -> Codec:
    """From a file of ranks. A token has a merge for every way of joining it from two tokens; a lower rank merges first."""
    from tokenizers.models import BPE

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        ways = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        ways.sort(key=lambda way: (ranks[way[0]], ranks[way[1]]))
        merges += [(shown[a], shown[b]) for a, b in ways]
    vocab = {shown[token]: rank for token, rank in ranks.items()}
    return Codec(BPE(vocab=vocab, merges=merges, ignore_merges=True), vocab, pattern)


def codec_from_json(path: str, pattern: str) -> Codec:
    """From a tokenizer file of the library itself; special tokens are ordinary text."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return Codec(whole.model, whole.get_vocab(with_added_tokens=False), pattern)


_OPEN: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, kept for the life of a Python worker."""
    if (path, pattern) not in _OPEN:
        load = codec_from_json if path.endswith(".json") else codec_from_ranks
        _OPEN[path, pattern] = load(path, pattern)
    return _OPEN[path, pattern]


class _Uneven(Exception):
    """A piece that touches white space other than the single space it was cut at."""


class Pieces(dict):
    """What ``make`` gives for each piece of a text, remembered.

    ``of(text)`` is the list of these values for the text's pieces in order. A piece is
    what stands between two cuts, with the space it begins with.
    """

    def __init__(self, made_by: Codec, make: Callable[[array], object]):
        super().__init__()
        self.codec, self.make, self.old = made_by, make, {}

    def _value(self, piece: str):
        words = self.codec.find(piece)
        if len(words) == 1:  # the piece itself is remembered
            return self.make(self.codec.made(words[0]))
        ids = array("I")
        for word in words:
            ids.extend(self.codec.ids_of(word))
        return self.make(ids)

    def __missing__(self, rest: str):
        if not rest or rest[0].isspace() or rest[-1].isspace():
            raise _Uneven
        value = self.old.get(rest)
        if value is None:
            value = self._value(" " + rest)
            if len(rest) > LONGEST:
                return value
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[rest] = value
        return value

    def of(self, text: str) -> list:
        if not text:
            return []
        parts = text.split(" ")
        try:
            if not parts[0] or parts[0][-1].isspace():
                raise _Uneven
            rest = list(map(self.__getitem__, parts[1:]))
        except _Uneven:
            parts = SAFE_SPACE.split(text)
            return [self._value(parts[0]), *(self._value(" " + p) for p in parts[1:])]
        return [self._value(parts[0]), *rest]


#: Remembered pieces of each vocabulary, in a Python worker.
_PIECES: dict[tuple[str, str], Pieces] = {}


def digest_pieces(path: str, pattern: str) -> Pieces:
    """Of each piece: how many ids, their decimals joined by commas, and the bytes they decode to."""
    if (path, pattern) not in _PIECES:
        c = codec(path, pattern)
        _PIECES[path, pattern] = Pieces(c, lambda ids: (len(ids), ",".join(map(str, ids)).encode(), c.decode_bytes(ids)))
    return _PIECES[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, starts, ends (character offsets of each token).

    A null text counts as empty and gives empty arrays. Rows repeated with the same id stay repeated. Long texts are encoded
    whole, one row at a time. An empty table gives no rows. Only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "starts", "ends"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [c.encode(t) for t in texts]
            spans = [c.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, [s[0] for s in spans], [s[1] for s in spans])]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=schema.names)

    return docs.select(docs[id_col], text_or_empty(docs[text_col]).alias("text")).mapInArrow(work, schema)


def decode(ids: str | Column, path: str, pattern: str) -> Column:
    """Bytes of an array of ids. A character split over several ids is whole again; null gives null."""

    @F.pandas_udf(T.BinaryType())
    def work(batch):
        c = codec(path, pattern)
        return batch.map(lambda x: None if x is None else c.decode_bytes(x))

    return work(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Null texts count as empty: no tokens, and digests of nothing. Repeated rows stay, long texts count whole, an empty table
    gives no rows. Only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = digest_pieces(path, pattern)
        for b in batches:
            n, shown, plain = [], [], []
            for text in b.column(1).to_pylist():
                found = pieces.of(text)
                n.append(sum(x[0] for x in found))
                shown.append(hashlib.sha256(b",".join([x[1] for x in found])).hexdigest())
                plain.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(plain, pa.string())], names=schema.names)

    return docs.select(docs[id_col], text_or_empty(docs[text_col]).alias("text")).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
