"""Quality on held-out rows, the pipeline against its stages, and the entry's guard."""

import os
import shutil
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import quality

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def sample(n=400):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    rows, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        words = [word() for _ in range(int(rng.integers(5, 400)))]
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, documents, extra):
    rows, labels = sample()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(documents(rows), marks)
    odd = [(1000, None), (1001, ""), (1001, ""), (None, "x"), (1002, "word " * 50_000)]
    got = quality.score(extra(documents(rows + odd)), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_labels_held_out_are_not_read(spark, documents):
    rows, labels = sample(150)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    ddl = "doc_id long, quality int, toxic int"
    a, b = (quality.fit(documents(rows), spark.createDataFrame(x, ddl)) for x in (labels, turned))
    assert all(np.array_equal(p, q) for p, q in zip(a.parts, b.parts, strict=True))


def test_no_labels(spark, documents):
    ddl = "doc_id long, quality int, toxic int"
    assert quality.fit(documents([(1, "a")]), spark.createDataFrame([], ddl)).share == 0.5
    one = quality.fit(documents([(1, "a"), (3, "b")]), spark.createDataFrame([(i, 1, 0) for i in (1, 3)] + [(None, 0, 0), (1, None, 0)], ddl))
    assert one.share in (1.0, 0.5) and quality.score(documents([]), one).collect() == []


def test_labels_in_doubt(spark, documents):
    """Two labels of a document are averaged, of several texts with one id one is read, and the whole of it."""
    ddl = "doc_id long, quality int, toxic int"
    rows, labels = sample(120)
    doubled = labels + [(i, q, t) for i, q, t in labels if i % 2]
    a, b = (quality.fit(documents(rows), spark.createDataFrame(x, ddl)) for x in (labels, doubled))
    assert all(np.array_equal(p, q) for p, q in zip(a.parts, b.parts, strict=True))
    c, d = (quality.fit(documents(x).repartition(n), spark.createDataFrame(labels, ddl)) for x, n in ((rows + rows[:50] * 3, 3), (rows[:50] * 2 + rows, 7)))
    assert all(np.array_equal(p, q) for p, q in zip(c.parts, a.parts, strict=True)) and all(np.array_equal(p, q) for p, q in zip(c.parts, d.parts, strict=True))


def test_gradient_matches_differences():
    """Every part's gradient against differences of the loss in some of its places; and training lowers the loss."""
    rng = np.random.default_rng(0)
    x, counts, labels = rng.normal(size=(7, quality.WIDTH)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    x[:, -1] = 1
    before = quality.train(x.astype(np.float32), counts, labels, epochs=1, rate=0.0, decay=0.0)
    after = quality.train(x.astype(np.float32), counts, labels, epochs=60, decay=0.0)

    def loss(model, rows):
        p = model.forward(rows, counts)[-1]
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    assert loss(after, after.scaled(x)) < 0.2 * loss(before, before.scaled(x))
    exact = quality.Model([p.astype(np.float64) for p in before.parts], before.mean, before.scale)
    rows = exact.scaled(x).astype(np.float64)
    for part, found in zip(exact.parts, quality.gradients(exact, rows, counts, labels), strict=True):
        flat, grads = part.reshape(-1), np.asarray(found).reshape(-1)
        for k in rng.choice(len(flat), min(12, len(flat)), replace=False):
            kept, step = flat[k], 1e-5
            flat[k] = kept + step
            up = loss(exact, rows)
            flat[k] = kept - step
            down = loss(exact, rows)
            flat[k] = kept
            assert grads[k] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8)


def plain_score(model, text):
    """The score by loops over passages, n-grams and units."""
    import math

    data, vectors = text.encode(), []
    for at in range(0, max(1, len(data)), quality.PASSAGE):
        part = data[at : at + quality.PASSAGE]
        x = [0.0] * quality.WIDTH
        grams = {}
        for a, b, c in zip(part, part[1:], part[2:], strict=False):
            mixed = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
            mixed = (mixed ^ mixed >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            grams[mixed >> 24] = grams.get(mixed >> 24, 0) + 1
        total = sum(grams.values())
        for g, n in grams.items():
            x[g] = math.sqrt(n / total)
            x[quality.TRIGRAMS] -= n / total * math.log(n / total)
        for b in part:
            x[quality.TRIGRAMS + 1 + quality.KINDS[b]] += 1 / len(part)
        drawn = len(part) / (len(part) + quality.HALF)
        vectors.append([(v - m) / s * drawn for v, m, s in zip(x, model.mean, model.scale, strict=True)][:-1] + [0.0])
    W, b, V, U, w, c, d = (p.astype(float).tolist() for p in model.parts)
    hidden = [[math.tanh(b[j] + sum(x[i] * W[i][j] for i in range(len(x)))) for j in range(len(b))] for x in vectors]
    weights = []
    for h in hidden:
        gated = [math.tanh(sum(h[i] * V[i][j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * U[i][j] for i in range(len(h))))) for j in range(len(w))]
        weights.append(math.exp(sum(g * v for g, v in zip(gated, w, strict=True))))
    bag = [sum(a * h[j] for a, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(b))]
    return 1 / (1 + math.exp(-(sum(z * v for z, v in zip(bag, c, strict=True)) + d[0])))


def test_scores_by_plain_loops(spark, documents):
    rows, labels = sample(150)
    model = quality.fit(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [t for _, t in rows[:12]] + ["", "a", "é" * 900, "x" * quality.PASSAGE, "short TEXT!! " * 200]
    got = quality.score(documents(list(enumerate(texts))), model).collect()
    assert all(r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-4) for r in got)


def test_sample_is_bounded_in_bytes(spark, documents):
    """Texts count by the order of their ids' hashes, until the bytes are used up."""
    rows, labels = sample(150)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = quality.fit(documents(rows), marks)
    same = quality.fit(documents(rows), marks, most_bytes=1 << 30)
    less = quality.fit(documents(rows), marks, most_bytes=20_000)
    assert all(np.array_equal(p, q) for p, q in zip(whole.parts, same.parts, strict=True)) and not np.array_equal(whole.mean, less.mean)
    assert quality.fit(documents(rows), marks, most_bytes=1).share == 0.5


def test_clashing_names_stay(spark, documents):
    from folioflow.llm import jaccard_join

    rows, labels = sample(60)
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("__score", "__text_key", "key", "row", "its_id")})
    good = quality.keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert good.columns == df.columns and {r["__score"] for r in good.collect()} == {"mine"}
    one = jaccard_join.keep_one(df)
    assert one.columns == df.columns and {(r["__text_key"], r["key"], r["row"], r["its_id"]) for r in one.collect()} == {("mine",) * 4}


def test_stages_on_nasty_documents(spark, documents, tmp_path):
    """All stages take nulls, empty texts, repeated rows and empty tables; their columns are those of documents."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "x"), (5, "A b c d e f g!"), (6, "w " * 5000)]
    for start in (documents(rows), documents([])):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
            docs = spark.createDataFrame(docs.collect(), start.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
def test_run_against_its_stages(spark):
    from itertools import combinations

    from folioflow.llm import jaccard_join

    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "length").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, good, SMALL).collect()}
    sets = {i: set(jaccard_join.shingles(t).tolist()) for i, t in lines.items()}
    root = {i: i for i in sets}
    for a, b in sorted(combinations(sorted(sets), 2)):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r["doc_id"] for r in got} == {i for i, r in root.items() if i == r}


def test_entry_without_these_operators(tmp_path):
    """The entry imports without corpus_pipeline.py and the llm folders."""
    for name in ("folioflow", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "folioflow" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'doc_date_vote' in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
