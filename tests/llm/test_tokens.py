"""BPE round trip and packing against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import bpe, packing

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ROWS = [(1, "Hello  world, it's 12345 and\n\n more \t tabs "), (2, None), (3, ""), (4, " lead"), (5, "中文😀 é\u00a0x\x1c y"), (5, "again <|endoftext|>"), (None, "no id"), (7, "word " * 6000), (8, "   "), (9, "a\n b")]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_round_trip(documents, extra, reference):
    got = sorted((tuple(r) for r in bpe.round_trip(extra(documents(ROWS)).repartition(3), RANKS, PATTERN).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(documents([]), RANKS, PATTERN).collect() == []


def test_any_text(reference, library):
    ranked, given_json = bpe.codec(RANKS, PATTERN), bpe.codec(JSON, PATTERN)
    pieces = bpe.Pieces(ranked, list), bpe.Pieces(given_json, list)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'\u00a0ab.,!1é中\U0001f600\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def check(t):
        ids = reference.encode_ordinary(t)
        assert ranked.encode(t) == ids == [i for p in pieces[0].of(t) for i in p]
        assert ranked.decode_bytes(ids) == t.encode()
        assert [i for p in pieces[1].of(t) for i in p] == library.encode(t, add_special_tokens=False).ids
        starts, ends = ranked.spans(t, ids)
        assert all(s < e <= len(t) for s, e in zip(starts, ends, strict=True)) and starts == sorted(starts)

    check()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    c = bpe.codec(JSON, PATTERN)
    pieces = bpe.Pieces(c, list)
    text = " ".join(f"w{k}" for k in range(100))
    assert [i for p in pieces.of(text) for i in p] == c.encode(text)
    assert len(pieces) <= 10 and len(pieces.old) <= 10


def test_encode_and_decode_columns(documents):
    rows = bpe.encode(documents(ROWS), RANKS, PATTERN)
    plain = {(r["doc_id"], bytes(r["plain"])) for r in rows.withColumn("plain", bpe.decode("ids", RANKS, PATTERN)).collect()}
    assert plain == {(i, (t or "").encode()) for i, t in ROWS}


def check_packing(rows, got, encode, size):
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["start"] == 0 and 0), []).append(r)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    want = []
    for i, t in rows:
        ids = np.array(encode(t or "") + [0], dtype="<u4")
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        cuts = sorted(set(cuts))
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    return len(places)


def test_packing(documents, extra, library):
    rows = ROWS + [(100 + k, "some words here " * (k % 40)) for k in range(200)]
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    got = packing.pack(extra(documents(rows)).repartition(7), JSON, PATTERN).collect()
    n = check_packing(rows, got, encode, 2048)
    assert n == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(documents([]), JSON, PATTERN).collect() == []


def test_small_sequences_against_best_fit(documents, library):
    rows = [(k, "x " * (k % 23)) for k in range(300)]
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    got = packing.pack(documents(rows), JSON, PATTERN, size=16).collect()
    n = check_packing(rows, got, encode, 16)
    room = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fit = min((k for k, left in enumerate(room) if left >= length), key=lambda k: room[k], default=None)
        if fit is None:
            room.append(16 - length)
        else:
            room[fit] -= length
    assert n <= len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_places_all(lengths):
    counts = np.bincount(lengths, minlength=33) if lengths else np.zeros(33, np.int64)
    bins = packing.plan(counts.astype(np.int64), 32)
    got = np.zeros(33, np.int64)
    for held, n in bins:
        assert sum(a * b for a, b in held) <= 32
        for a, b in held:
            got[a] += n * b
    assert (got == counts).all() and sum(n for _, n in bins) >= -(-sum(lengths) // 32)
