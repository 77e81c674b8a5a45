import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import language_id, lexical_search

DIR = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search


def ranked(docs, items, k=50):
    """Every document scored against every item, in plain loops."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, own in asked.items():
        scored = []
        for i, t in terms:
            m = 100 - 50 + (50 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in own if x in t)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def corpus(n, seed=0, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(n)]


def test_search_against_all_documents(documents, items, extra):
    docs = corpus(400)
    asked = [(k, " ".join(f"W{j}" for j in range(k, k + 9))) for k in range(0, 50, 3)]
    for parts in (1, 7):
        got = lexical_search.search(extra(documents(docs)).repartition(parts), items(asked), k=10)
        assert found(got) == ranked(docs, asked, 10)


def test_search_in_small_shards_and_blocks(documents, items, monkeypatch):
    docs = corpus(300, 1)
    asked = [(k, f"w{k} w{k + 1} w{k + 2}") for k in range(12)]
    want = ranked(docs, asked, 5)
    monkeypatch.setattr(lexical_search, "FAN", 2)
    assert found(lexical_search.search(documents(docs).repartition(9), items(asked), k=5, most_queries=5, most_terms=7)) == want


def test_search_edges(documents, items):
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "Straße ÉTÉ été x1"), (5, "straße"), (6, "x" * 100_000 + " " + "longest " * 5000), (7, "a b"), (7, "a b"), (None, "a b"), (8, "a B"), (9, "été\x7fx1")]
    asked = [(1, None), (2, ""), (3, "zzz"), (4, "STRAßE été"), (5, "a b a B"), (6, "longest"), (6, "a"), (None, "b"), (7, "x1 ÉTÉ")]
    assert found(lexical_search.search(documents(docs), items(asked))) == ranked(docs, asked)
    assert found(lexical_search.search(documents(docs), items(asked), k=2)) == ranked(docs, asked, 2)


def test_search_ties_at_the_end(documents, items):
    """Of documents that score alike those with the smallest ids rank, wherever they stand."""
    docs = [(i, "alpha beta") for i in range(200)] + [(i, "gamma") for i in range(200, 260)]
    asked = [(1, "alpha"), (2, "gamma alpha")]
    assert found(lexical_search.search(documents(docs[::-1]).repartition(6), items(asked), k=7)) == ranked(docs, asked, 7)


def test_search_of_nothing(documents, items):
    assert lexical_search.search(documents([]), items([(1, "a")])).collect() == []
    assert lexical_search.search(documents([(1, "a")]), items([])).collect() == []
    assert lexical_search.search(documents([(1, None)]), items([(1, "a")])).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_ends_early():
    """The lists are not read to their ends, once no unseen document can rank."""
    n = 4000
    owner, terms = np.repeat(np.arange(n), 2), np.tile(np.arange(2), n)
    impacts = np.where(owner < 20, 1000, 1)
    shard = lexical_search.Shard(list(range(n)), owner, terms, impacts, 2)
    looked, score = [], shard.score
    shard.score = lambda d, t: looked.extend(d.tolist()) or score(d, t)
    assert [-s for s, _, _ in shard.search(np.array([0, 1]), 10, [])] == [2000] * 10
    assert len(looked) < 100


# language identification


def test_kernel_is_shared_ngrams():
    texts = ["The cat sat", "the CAT, sat?", "été à la mer", "x", "", "12 34"]
    bits = language_id.bits_of(texts)

    def grams(t):
        raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in t.lower().encode())
        return {raw[k : k + n] for n in range(1, language_id.LONGEST + 1) for k in range(len(raw) - n + 1)}

    for a, x in zip(texts, bits, strict=True):
        for b, y in zip(texts, bits, strict=True):
            assert int((x & y).sum()) == len(grams(a) & grams(b))  # no two of these n-grams share a bucket


def test_long_text_in_steps(monkeypatch):
    text = " ".join(f"wort{k}ä" for k in range(300))
    whole = language_id.bits_of([text])
    monkeypatch.setattr(language_id, "STEP", 100)
    assert (language_id.bits_of([text]) == whole).all()


def labelled(seed=3, n=60):
    rng = random.Random(seed)
    words = {"en": "the and of with this that from".split(), "de": "der und das nicht für über ein".split(), "fr": "le et les dans où être une".split()}
    return [(lang, " ".join(rng.choices(own, k=rng.randint(3, 12)))) for lang, own in words.items() for _ in range(n if lang == "en" else n // 3)]


def test_scores_are_ridge_regression_on_landmarks():
    """The model against an augmented least-squares problem on explicit Nyström features."""
    rows = labelled()
    texts, labels = [t for _, t in rows], [x for x, _ in rows]
    packed = [np.packbits(b).tobytes() for b in language_id.bits_of(texts)]
    model = language_id.train(packed, labels, landmarks=12, ridge=1e-2)
    bits = language_id.bits_of(texts).astype(float)
    unit = bits / np.sqrt(bits.sum(1, keepdims=True))
    turn = sorted((sum(y == x for y in labels[:i]), x, i) for i, x in enumerate(labels))[:12]
    marks = unit[[i for *_, i in turn]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    fine = values > 1e-9 * values.max()
    features = unit @ marks.T @ vectors[:, fine] / np.sqrt(values[fine])
    share = np.array([1 / (3 * labels.count(x)) for x in labels])
    design = np.concatenate([features, np.ones((len(texts), 1))], axis=1)
    ridge = np.concatenate([np.eye(features.shape[1]) * 0.1, np.zeros((features.shape[1], 1))], axis=1)
    for k, name in enumerate(model.languages):
        y = np.array([float(x == name) for x in labels])
        solved = np.linalg.lstsq(np.concatenate([design * np.sqrt(share)[:, None], ridge]), np.concatenate([y * np.sqrt(share), np.zeros(len(ridge))]), rcond=None)[0]
        assert np.allclose(design @ solved, model.scores(texts)[:, k], atol=1e-4)


@pytest.fixture
def speakers(spark):
    rows = [(i, t, x) for i, (x, t) in enumerate(labelled())]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 !? 34", "fr"), (1003, "der und das", None), (None, "the and of", "en"), (0, "le et les", "fr"), (1004, "the of and " * 30_000, "en"), (1005, "日本語", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_identify_edges(speakers, extra):
    docs = extra(speakers.drop("lang"))
    model = language_id.fit(speakers)
    got = {(r["doc_id"], r["lang_pred"]): r for r in language_id.identify(docs, model).collect()}
    for i in (1000, 1001, 1002):
        assert got[i, "und"]["score"] == 0
    assert (1003, "de") in got and (1004, "en") in got and (None, "en") in got and (0, "fr") in got and (0, "en") in got
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "und") for r in got.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for (i, _), r in got.items())
    assert language_id.identify(docs.limit(0), model).collect() == []
    assert sum(1 for _ in got) == docs.count()


def test_fit_reads_a_bounded_sample_in_turn(speakers):
    model = language_id.fit(speakers, sample=6, landmarks=6)
    assert model.languages == ["de", "en", "fr"] and model.landmarks.shape[0] <= 6
    none = language_id.fit(speakers.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(speakers, none).collect()} == {"und"}


def test_held_out_labels_are_not_read(speakers):
    wrong = speakers.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language_id.fit(wrong).languages == ["de", "en", "fr"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    both = language_id.query(spark, DIR).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
