"""Best-fit packing of token sequences by length patterns.

The plan is made from the histogram of piece lengths alone, whose size is bounded by
the sequence length: patterns of a few lengths that fill a sequence exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least squares
and rounded, the largest remainders up, as far as the histogram has pieces, and what
the patterns leave, the residuals, is packed best-fit decreasing, again on counts. Pieces then take their places by their rank among the pieces of their
length, a look-up in a plan of bounded size, so that no task ever holds a group.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe
from folioflow.llm.common import Scratch, bounded_batches, table, text_or_empty

SEQUENCE = 2048
#: Patterns of three lengths have one of this many of the most frequent lengths as their smallest, so that there are at most
#: COMMON * size of them; lengths that no pattern has are residuals.
COMMON = 96
#: Steps of the fit, and the relative change of the fitted histogram at which it ends before.
ROUNDS = 500
SETTLED = 1e-4


def patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths (0: none) that are present and fill ``size`` exactly."""
    there = counts > 0
    out = [(size, 0, 0)] if there[size] else []
    have = np.flatnonzero(there[1:size]) + 1
    a = have[2 * have <= size]
    a = a[there[size - a]]
    out += [(int(size - x), int(x), 0) for x in a]
    often = np.sort(have[np.argsort(-counts[have], kind="stable")[:COMMON]])
    x, y = np.meshgrid(often, have, indexing="ij")
    z = size - x - y
    fits = (x <= y) & (y <= z) & (z > 0)
    fits &= there[np.where(fits, z, 0)]
    out += list(zip(z[fits].tolist(), y[fits].tolist(), x[fits].tolist(), strict=True))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by multiplicative steps."""
    h = counts.astype(float)
    h[0] = 0.0
    wide = len(counts)
    back = lambda v: np.where(rows > 0, v[rows], 0.0).sum(1)
    want = back(h)
    x = np.full(len(rows), h.sum() / max(1, 3 * len(rows)))
    before = np.zeros(wide)
    for _ in range(ROUNDS):
        made = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=wide)
        made[0] = 0.0
        if np.abs(made - before).sum() <= SETTLED * h.sum():
            break
        before = made
        x *= want / np.maximum(back(made), 1e-12)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats of the patterns and what they leave of the histogram: the fit rounded down, then its largest remainders
    up, then further repeats in the order of the fit, as long as there are pieces."""
    left, times = counts.copy(), np.zeros(len(rows), np.int64)
    held = [np.unique(r[r > 0], return_counts=True) for r in rows]

    def take(k: int, most: int) -> None:
        lengths, each = held[k]
        n = min(most, int((left[lengths] // each).min()))
        if n > 0:
            left[lengths] -= n * each
            times[k] += n

    whole = np.floor(x).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        take(k, int(whole[k]))
    for k in np.argsort(whole - x, kind="stable"):
        take(k, 1)
    for k in np.argsort(-x, kind="stable"):
        take(k, int(counts.sum()))
    return times, left


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: (((length, times), ...), repeats), in equal bins at once."""
    open_bins: dict[int, list] = {}
    rooms = 0  # bit r: a bin with room r is open
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            wide = rooms >> length
            if not wide:
                each = size // length
                fresh, rest = divmod(left, each)
                for times, n in ((each, fresh), (rest, 1)):
                    if times and n:
                        open_bins.setdefault(size - times * length, []).append((((length, times),), n))
                        rooms |= 1 << (size - times * length)
                left = 0
                continue
            room = length + (wide & -wide).bit_length() - 1
            held, n = open_bins[room].pop()
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n:
                open_bins[room].append((held, n - used))
            if not open_bins[room]:
                rooms &= ~(1 << room)
            open_bins.setdefault(room - each * length, []).append(((*held, (length, each)), used))
            rooms |= 1 << (room - each * length)
            left -= used * each
    return [b for held in open_bins.values() for b in held]


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins for a histogram of lengths 0..size: contents and repeats, patterns first. Every piece has a place."""
    rows, out, left = patterns(counts, size), [], counts
    if len(rows):
        times, left = rounded(rows, fit(rows, counts), counts)
        for k in np.flatnonzero(times):
            lengths, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
            out.append((tuple(zip(lengths[::-1].tolist(), each[::-1].tolist(), strict=True)), int(times[k])))
    return out + best_fit(left, size)


def places(bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence, offset and times of every slot group. A rank finds its slot by bisection."""
    slots: dict[int, list] = {}
    first = 0
    for held, n in bins:
        at = 0
        for length, times in held:
            slots.setdefault(length, []).append((n * times, first, at, times))
            at += length * times
        first += n
    out = {}
    for length, rows in slots.items():
        n, seq, at, times = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        out[length] = (np.cumsum(n) - n, n, seq, at, times)
    return out


#: Remembered pieces of each vocabulary, in a Python worker.
_PIECES: dict[tuple[str, str], bpe.Pieces] = {}


def little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def id_pieces(path: str, pattern: str) -> bpe.Pieces:
    """Of each piece: its ids, four little-endian bytes each."""
    if (path, pattern) not in _PIECES:
        _PIECES[path, pattern] = bpe.Pieces(bpe.codec(path, pattern), little)
    return _PIECES[path, pattern]


def pieces_of(docs: DataFrame, path: str, pattern: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Encoded documents cut to pieces, with the rank of each piece among those of its length in its task."""
    bounded_batches(docs.sparkSession)
    fields = [("doc_id", docs.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("rank", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = id_pieces(path, pattern)
        end = little(array("I", [end_id]))
        seen = [0] * (size + 1)
        for b in batches:
            who, cols = [], ([], [], [], [], [])
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = b"".join([*known.of(text), end])
                total = len(ids) // 4
                start, piece = 0, 0
                length = total % size or size
                while start < total:
                    who.append(k)
                    for c, v in zip(cols, (piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]), strict=True):
                        c.append(v)
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, size
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return docs.select(docs[id_col], text_or_empty(docs[text_col]).alias("text")).mapInArrow(work, schema)


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * A document is its ids and ``end_id``. Only one longer than ``size`` is cut: its
      first piece takes what is over, the others are full.
    * A null text counts as empty: one piece of length 1. Long texts are encoded whole and cut. Repeated rows are packed as often as they occur.
    * Sequences are gapless from offset 0 and hold at most ``size`` ids. An empty table gives no rows.
    * Only the two named columns are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.put(pieces_of(docs, path, pattern, end_id, size, id_col, text_col).withColumn("task", F.spark_partition_id()), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # a row for each length, ``size`` at most
        counts[length] = n
    found = places(plan(counts, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for x in np.unique(lengths):
            mine = lengths == x
            first, n, sequence, offset, times = found[int(x)]
            slot = np.searchsorted(first, ranks[mine], side="right") - 1
            turn, which = np.divmod(ranks[mine] - first[slot], times[slot])
            seq[mine] = sequence[slot] + turn
            at[mine] = offset[slot] + which * x
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    placed = cut.join(offsets, ["task", "length"]).withColumn("place", place(F.col("length"), F.col("rank") + F.col("before")))
    return placed.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"))
