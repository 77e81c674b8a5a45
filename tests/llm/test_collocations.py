import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(rows, longest=4, least=30, inside=80, top=2000):
    """All phrases counted in plain loops, from (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            own = f.setdefault(lang or "und", Counter()) if lang is not None else f.setdefault("und", Counter())
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(n, seed=0, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"{'W' if k % 3 else 'w'}{k}é" for k in range(14)]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(rng.choice(langs), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))) for _ in range(n)]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_against_plain_counts(frame, extra):
    rows = texts(300)
    for parts, size in ((1, 1 << 21), (6, 90)):
        assert found(C.collocations(extra(frame(rows)).repartition(parts), shard=size)) == model(rows)


def test_other_lengths_and_limits(frame):
    rows = texts(200, 2, ("en",))
    assert found(C.collocations(frame(rows).repartition(3), longest=2, least=7, inside=50, top=9, shard=300)) == model(rows, 2, 7, 50, 9)
    assert found(C.collocations(frame(rows).repartition(3), longest=5, least=12, shard=300)) == model(rows, 5, 12)


def test_edges(frame):
    rows = [(None, None), ("en", None), ("en", ""), ("en", ".;!\n\t "), ("und", "a b " * 20), (None, "A B " * 20), ("xx", "x\x1fy \x85 " * 40), ("xx", "x\x1fy \x85," * 40), ("fr", "ÉTÉ été " * 40), ("fr", "\x00 q " * 35)]
    rows += [("en", "one word. " * 40), ("en", "new york city hall " * 31), ("en", "new york " * 4), ("yy", "z" * 200_000 + " tail, " + "k " * 9000)]
    got = found(C.collocations(frame(rows).repartition(4)))
    assert got == model(rows)
    assert {r[0] for r in got} == {"und", "xx", "fr", "en", "yy"}  # "A B" of the null language and of "und" are one


def test_phrases_of_no_shard_alone(frame):
    """Counts reach the least count only when the shards are summed."""
    rows = [("en", "rare pair here")] * 30
    assert found(C.collocations(frame(rows).repartition(10), shard=1)) == model(rows) != []


def test_same_scores_rank_by_count_and_bytes(frame):
    rows = [("en", f"{w}1 {w}2.") for w in ("b", "a", "é", "z", "Z") for _ in range(30)]
    assert [r[2] for r in found(C.collocations(frame(rows), top=3))] == [r[2] for r in model(rows, top=3)] == ["z1 z2", "a1 a2", "b1 b2"]


def test_nothing(frame):
    assert C.collocations(frame([])).collect() == []
    assert C.collocations(frame([("en", None), ("en", "a b")])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def shard_of(n, kinds, seed):
    rng = np.random.default_rng(seed)
    return np.append(np.minimum(rng.geometric(0.25, n), kinds) - 1 - (rng.random(n) < 0.1) * 100, -1).clip(-1).astype(np.int32)


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
@pytest.mark.parametrize("batch", [1, 50, 1 << 18])
def test_bitmaps_count_phrases(dense, batch):
    """Bits, positions and both, against phrases counted one by one."""
    words = shard_of(3000, 12, 5)
    names = np.arange(12) * 5 + 2
    pairs = Counter((a, b) for a, b in zip(words, words[1:], strict=False) if min(a, b) >= 0)
    threes = Counter((a, b, c) for a, b, c in zip(words, words[1:], words[2:], strict=False) if min(a, b, c) >= 0)
    bitmaps = C.Bitmaps(words, 12, dense)
    assert (len(bitmaps.dense) > 2) == (dense < 1)
    keys, counts = C.phrase_counts(bitmaps, names, 8, [], batch)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {int(names[a]) << 8 | int(names[b]): n for (a, b), n in pairs.items()}
    known = sorted((int(names[a]) << 8 | int(names[b]), 1000 + k) for k, ((a, b), n) in enumerate(pairs.items()) if n >= 5)
    number = {k: v for k, v in known}
    keys, counts = C.phrase_counts(bitmaps, names, 8, [tuple(np.array(x, np.int64) for x in zip(*known, strict=True))], batch)
    want = {number[int(names[a]) << 8 | int(names[b])] << 8 | int(names[c]): n for (a, b, c), n in threes.items() if pairs[a, b] >= 5}
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want


def test_packed_numbers():
    for values in ([], [0], [5, 5, 7, 1 << 62], [9, 1, -3]):
        assert C.unpack(C.pack(np.array(values, np.int64)), len(values)).tolist() == values
