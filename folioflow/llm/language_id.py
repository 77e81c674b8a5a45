"""Language identification by a string kernel: presence of n-grams, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the blended spectrum's presence kernel: how many n-grams of
one to ``LONGEST`` bytes they have in common, divided by the root of what each has by
itself. N-grams are taken from the whole lower-cased text, in which everything in ASCII
that is no letter is a space, and stand for their hash in ``BUCKETS``, so that a text of
any length is that many bits.

Some of the labelled texts are landmarks, in turn from every language. A text is mapped
to its kernel with the landmarks times the inverse root of the landmarks' own kernel
(Nyström), and one ridge regression per language against the rest is fitted on that. Texts
are scored in batches: one matrix product for the kernel, a second one for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import bounded_batches, table, text_or_empty

LONGEST = 3
BUCKETS = 1 << 16
#: Odd multipliers of the hash of an n-gram.
SPREAD, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Bytes of a text that are hashed at a time, and texts of one matrix product.
STEP, ROWS = 4 << 20, 128
UNDETERMINED = "und"
#: Parts of a language's labelled documents whose first ones are found apart.
PARTS = 256
#: ASCII letters in lower case, spaces for the rest of ASCII; other bytes stand for themselves.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def present(text: str, row: np.ndarray) -> None:
    """Sets the buckets of the text's n-grams in ``row``."""
    data = np.frombuffer(text.lower().encode().translate(LETTERS), np.uint8)
    for at in range(0, len(data), STEP):
        part = data[max(0, at - LONGEST + 1) : at + STEP].astype(np.uint32)
        mixed = np.zeros(len(part), np.uint32)
        for n in range(1, min(LONGEST, len(part)) + 1):
            mixed = (mixed[: len(part) - n + 1] ^ part[n - 1 :] + np.uint32(n << 8)) * SPREAD
            mixed ^= mixed >> np.uint32(15)
            row[(mixed * MIX) >> np.uint32(16)] = 1


def bits_of(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    for row, text in zip(out, texts, strict=True):
        present(text, row)
    return out


@dataclass
class Model:
    """``landmarks``: their n-grams as rows over the ``columns`` that any has; ``weights``: of the scaled kernel, and the intercept last."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        own = np.maximum(1, bits.sum(axis=1, dtype=np.int64)) ** -0.5
        return (bits[:, self.columns].astype(np.float32) @ self.landmarks.T) * own[:, None] * self.scale

    def scores(self, texts: list[str]) -> np.ndarray:
        """One column a language."""
        out = [np.zeros((0, len(self.languages)))]
        for at in range(0, len(texts), ROWS):
            k = self.kernel(bits_of(texts[at : at + ROWS]))
            out.append(k @ self.weights[:-1] + self.weights[-1])
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with the highest score, the first of equal ones by name, and its score within 0 to 1."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        found = self.scores(texts)
        best = found.argmax(axis=1)
        return [self.languages[k] for k in best], np.clip(found[np.arange(len(best)), best], 0, 1)


def train(packed: list[bytes], labels: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """From n-grams as packed bits. Every language weighs the same, however many texts it has."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((1, 0)))
    bits = lambda rows: np.stack([np.unpackbits(np.frombuffer(packed[i], np.uint8)) for i in rows])
    by = {name: [i for i, x in enumerate(labels) if x == name] for name in languages}
    turn = sorted((n, name, i) for name, rows in by.items() for n, i in enumerate(rows))
    chosen = bits([i for *_, i in turn[: max(landmarks, len(languages))]])
    columns = np.flatnonzero(chosen.any(axis=0))
    model = Model(languages, columns, chosen[:, columns].astype(np.float32), np.maximum(1, chosen.sum(axis=1, dtype=np.int64)) ** -0.5, np.zeros(0))
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    fine = values > 1e-9 * values.max()
    root = vectors[:, fine] * values[fine] ** -0.5
    mapped = np.concatenate([model.kernel(bits(range(at, min(at + ROWS, len(packed))))) @ root for at in range(0, len(packed), ROWS)])
    mapped = np.concatenate([mapped, np.ones((len(mapped), 1))], axis=1)
    wanted = np.array([[float(x == name) for name in languages] for x in labels])
    share = np.array([1 / (len(languages) * len(by[x])) for x in labels])
    penalty = np.full(mapped.shape[1], ridge)
    penalty[-1] = 1e-12  # the intercept is free
    solved = np.linalg.solve(mapped.T @ (mapped * share[:, None]) + np.diag(penalty), mapped.T @ (wanted * share[:, None]))
    model.weights = np.concatenate([root @ solved[:-1], solved[-1:]])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Fit on at most ``sample`` texts with a letter and a language that are not held out, in turn from every language, chosen by a hash of the id.

    Of several rows with one id, the first in the order of language and n-grams is read. What reaches the driver is
    ``BUCKETS`` bits a text, whatever its length. Without such texts the model knows no language.
    """
    labelled = docs.select(docs[id_col].alias("its_id"), docs[lang_col].alias("its_lang")).where(F.col("its_lang").isNotNull() & F.col("its_id").isNotNull())
    turn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("its_id"), "its_id"))
    # The first of a language are among the first of its parts, so that no task has more than so many of each part.
    parted = labelled.where(~held_out(F.col("its_id"))).withColumn("part", F.pmod(F.hash("its_id"), F.lit(PARTS)))
    chosen = parted.withColumn("turn", turn("its_lang", "part")).where(F.col("turn") <= sample).withColumn("turn", turn("its_lang")).where(F.col("turn") <= sample)
    chosen = chosen.orderBy("turn", "its_lang").limit(sample).select("its_id").distinct()
    text = text_or_empty(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("its_id")).select(F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("id"), "lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.packbits(bits_of([t])[0]).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], names=["place", "id", "lang", "bits"])

    found = rows.mapInArrow(work, "place long, id string, lang string, bits binary").groupBy("place", "id").agg(F.min(F.struct("lang", "bits")).alias("first")).collect()
    found.sort(key=lambda r: (r["place"], r["id"]))
    return train([r["first"]["bits"] for r in found], [r["first"]["lang"] for r in found], **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    A null text, and one without a letter, is ``und`` with score 0. Whole texts count, however long. Repeated rows have equal
    results; an empty table gives no rows. Only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            some = [k for k, t in enumerate(texts) if t is not None]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if some:
                found, best = model.predict([texts[k] for k in some])
                scores[some] = best
                for k, name in zip(some, found, strict=True):
                    names[k] = name
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), F.when(has_letter(text), text).alias("text"))
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("held_out boolean, lang_pred string, score double").fields])
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
