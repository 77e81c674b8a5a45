"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, consecutive windows that cover its whole text. Every
passage is encoded as hashed byte trigrams and character classes, mapped to a hidden
vector, and weighted by gated attention within its document; the weighted sum is
scored. Only documents carry labels. The model is small, fitted on the driver with a
bounded sample of labelled rows, and shipped to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, table, text_or_empty

#: Bytes of a passage, and buckets of its trigrams.
PASSAGE = 768
TRIGRAMS = 256
CLASSES = 10
WIDTH = TRIGRAMS + CLASSES + 2
#: A passage of this many bytes counts half; the encoding of a shorter one is drawn further towards the mean.
HALF = 400
#: Bytes encoded at a time.
STEP = 4 << 20


def byte_classes() -> np.ndarray:
    kinds = np.full(256, 9, np.int64)
    kinds[ord("a") : ord("z") + 1] = 0
    kinds[ord("A") : ord("Z") + 1] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[ord(" ")] = 3
    kinds[[9, 10, 11, 12, 13]] = 4
    kinds[[ord(c) for c in ".,;:'\"-"]] = 5
    kinds[[ord(c) for c in "!?"]] = 6
    kinds[[ord(c) for c in "#$%&*|<>{}[]()=+/\\@^_~`"]] = 7
    kinds[128:] = 8
    return kinds


KINDS = byte_classes()


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts as rows, and the number of passages of each text: one at least, an empty text has an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    lengths = np.full(counts.sum(), PASSAGE, np.int64)
    last = np.cumsum(counts) - 1
    lengths[last] = sizes - (counts - 1) * PASSAGE
    n = len(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(owner * CLASSES + KINDS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        mixed = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA6B)) ^ (wide[2:] * np.uint32(0xC2B2AE35))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        whole = owner[:-2] == owner[2:]
        grams = np.bincount(owner[:-2][whole] * TRIGRAMS + (mixed[whole] >> np.uint32(24)), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        part = grams / np.maximum(1, grams.sum(1, keepdims=True))
        out[:, :TRIGRAMS] = np.sqrt(part)
        out[:, TRIGRAMS] = -(part * np.log(np.where(part > 0, part, 1))).sum(1)
    out[:, TRIGRAMS + 1 : TRIGRAMS + 1 + CLASSES] = kinds / np.maximum(1, lengths)[:, None]
    out[:, WIDTH - 1] = lengths / PASSAGE
    return out, counts


@dataclass
class Model:
    """Gated-attention pooling: ``parts`` holds W, b, V, U, w, c, d; ``mean`` and ``scale`` the encoding's."""

    parts: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    share: float | None = None  # the score of every document, where the sample had not both labels

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Encodings centred, scaled and drawn to the mean by their passages' lengths, which are no input themselves."""
        n = x[:, -1:] * PASSAGE
        out = ((x - self.mean) / self.scale * (n / (n + HALF))).astype(np.float32)
        out[:, -1] = 0
        return out

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        W, b, V, U, w, c, d = self.parts
        first = np.cumsum(counts) - counts
        H = np.tanh(x @ W + b)
        T, G = np.tanh(H @ V), 1 / (1 + np.exp(-(H @ U)))
        s = (T * G) @ w
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
        a = s / np.repeat(np.add.reduceat(s, first), counts)
        z = np.add.reduceat(a[:, None] * H, first)
        p = 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))
        return first, H, T, G, a, z, p

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A score in 0..1 for every text, whatever its length."""
        if self.share is not None:
            return np.full(len(texts), self.share)
        out, at = [], 0
        raw = [(t or "").encode() for t in texts]
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= STEP):
                size += len(raw[end])
                end += 1
            x, counts = encode(raw[at:end])
            out.append(self.forward(self.scaled(x), counts)[-1])
            at = end
        return np.concatenate(out) if out else np.empty(0)

    def column(self, text: Column) -> Column:
        """The score as a column."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model.score(texts.tolist()), dtype="float64")

        return scored(text)


def gradients(model: Model, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of some documents, by the model's parts; ``x`` is scaled."""
    W, b, V, U, w, c, d = model.parts
    first, H, T, G, a, z, p = model.forward(x, counts)
    dy = ((p - labels) / len(labels)).astype(x.dtype)
    dz = np.repeat(dy[:, None] * c, counts, axis=0)
    da = (H * dz).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
    dTG = ds[:, None] * w
    dT, dG = dTG * G * (1 - T * T), dTG * T * G * (1 - G)
    dA = (a[:, None] * dz + dT @ V.T + dG @ U.T) * (1 - H * H)
    return [x.T @ dA, dA.sum(0), H.T @ dT, H.T @ dG, (T * G).T @ ds, z.T @ dy, dy.sum(keepdims=True)]


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, hidden: int = 32, attention: int = 16, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam on the cross-entropy of documents at a rate that falls to nothing; seeded, so that equal samples give equal models."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model([], np.zeros(1), np.ones(1), share)
    rng = np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    W, V, U = (rng.normal(0, 1 / np.sqrt(n), (n, m)) for n, m in ((x.shape[1], hidden), (hidden, attention), (hidden, attention)))
    parts = [W, np.zeros(hidden), V, U, rng.normal(0, 1 / np.sqrt(attention), attention), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    parts = [p.astype(np.float32) for p in parts]
    m1, m2 = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    model, start, step = Model(parts, mean, scale), np.cumsum(counts) - counts, 0
    x = model.scaled(x)
    steps = epochs * -(-len(labels) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            bags = order[at : at + batch]
            n = counts[bags]
            rows = np.repeat(start[bags] - np.cumsum(n) + n, n) + np.arange(n.sum())
            grads = gradients(model, x[rows], n, labels[bags])
            grads[0] += decay * parts[0]
            step += 1
            for p_, g, u, v in zip(parts, grads, m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p_ -= rate * (1 - (step - 1) / steps) * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 6000, most_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, chosen by a hash of the id, on their whole texts.

    Texts are taken in the order of that hash as long as they have ``most_bytes`` in all, so that what reaches the driver is
    bounded: less than a byte for each byte of them. A document with several labels has their mean; of several texts with one
    id, the first in the order of their encodings is read. Labels that are null or have no document are left out. A sample
    without both labels, or an empty table, gives a model that scores its share of ones, or 0.5.
    """
    spark = docs.sparkSession
    chosen = labels.select(labels[id_col].alias("its_id"), labels[label_col].cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("its_id").isNotNull())
    chosen = chosen.where(~held_out(F.col("its_id"))).groupBy("its_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("its_id"), "its_id").limit(sample)
    sized = docs.select(docs[id_col].alias("id"), F.octet_length(text_or_empty(docs[text_col])).cast("long").alias("bytes")).join(F.broadcast(chosen), F.col("id") == F.col("its_id"))
    sized = sized.groupBy(F.xxhash64("its_id").alias("place"), "its_id").agg(F.min("label").alias("label"), F.sum("bytes").alias("bytes"))
    found, total = [], 0
    for r in sorted(sized.collect(), key=lambda r: (r["place"], str(r["its_id"]))):  # ``sample`` rows of four numbers
        if total + r["bytes"] > most_bytes:
            break
        total += r["bytes"]
        found.append((r["its_id"], r["label"]))
    chosen = spark.createDataFrame(found, chosen.schema)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("its_id"))
    rows = rows.select("id", "label", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [encode([t.encode()])[0].astype(np.float16).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(out, pa.binary())], names=["id", "label", "x"])

    found = rows.mapInArrow(work, "id string, label double, x binary").groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()
    found.sort(key=lambda r: r["id"])
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in found]
    y = np.array([r["label"] for r in found])
    return train(np.concatenate(bags) if bags else np.empty((0, WIDTH)), np.array([len(x) for x in bags], np.int64), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A null text counts as empty, and an empty text has a score like any other. Very long texts are scored whole. Repeated
    rows score alike; an empty table gives no rows. Only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)
    scored = docs.select(docs[id_col].alias("id"), model.column(text_or_empty(docs[text_col])).alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that score below ``least``; all columns stay."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, text_col=text_col, **options)
    return docs.where(model.column(text_or_empty(docs[text_col])) >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
