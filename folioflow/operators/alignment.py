"""Samples of one page merged by alignment: a confusion network, a vote at each of its places, and a confidence from it.

Samples are aligned word by word, one after the other, to the network of those before: a
place is free for a sample that has one of its readings there, and costs one otherwise, as
does a word without a place and a place without a word. Memory is linear in the words: a
long alignment is cut in halves where its best path crosses the middle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.prompts import CONFIDENCE

WORD = re.compile(r"(\s*)(\S+)")
EDGE = re.compile(r"^[^\w%]+|[^\w%]+$")
#: Cells of an alignment that is solved at once.
CELLS = 1 << 21
#: Weights of a figure or a unit, and of any other word.
CRITICAL, OTHER = 5, 1
#: Units of measurement, whose change changes a finding.
UNITS = ("%", "bpm", "cm", "dl", "g", "kg", "l", "mcg", "mg", "ml", "mm", "mmhg", "mmol", "ng", "ui", "µg")
#: Shares of disagreement, by weight, at which the ranges of the rubric end.
SHARES = (0.1, 0.3, 0.6)

#: Of a place, for each sample, its reading: white space before the word, and the word; None where it has none.
Place = list[tuple[str, str] | None]


@lru_cache(1 << 16)
def key_of(word: str) -> str:
    """A word without case and without punctuation around it, which change no meaning; punctuation alone is itself."""
    key = word.casefold()
    return key if key.isalnum() else EDGE.sub("", key) or word


@lru_cache(1 << 16)
def is_critical(word: str) -> bool:
    key = key_of(word)
    return key in UNITS or not key.isalpha() and any(c.isdigit() for c in key)


def path(same: np.ndarray) -> list[tuple[int | None, int | None]]:
    """A cheapest alignment of places (rows) and words (columns), as pairs in order; of equal ones that with pairs from the end."""
    n, m = same.shape
    cost = np.empty((n + 1, m + 1), np.int64)
    steps = np.arange(m + 1)
    cost[0] = steps
    for i, hits in enumerate(same):
        best = cost[i] + 1
        best[1:] = np.minimum(best[1:], cost[i, :-1] + ~hits)
        cost[i + 1] = np.minimum.accumulate(best - steps) + steps
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (not same[i - 1, j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def edges_of(rows, m: int) -> np.ndarray:
    """The last row of costs, from rows of hits that are made as they are used."""
    steps = np.arange(m + 1, dtype=np.int64)
    row = steps
    for hits in rows:
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + ~hits)
        row = np.minimum.accumulate(best - steps) + steps
    return row


def ahead(same: np.ndarray) -> int:
    """How many are true before the first that is not."""
    return len(same) if same.all() else int(same.argmin())


def ends_of(places: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """How many words at the start fit the places there, and how many of the rest at the end."""
    least = min(len(places), len(words))
    fits = lambda p, w: (p == w[:, None]).any(axis=1)
    start = ahead(fits(places[:least], words[:least]))
    least -= start
    return start, ahead(fits(places[len(places) - least :], words[len(words) - least :])[::-1])


def align(places: np.ndarray, words: np.ndarray) -> list[tuple[int | None, int | None]]:
    """Pairs of a place and a word, from numbers of readings (place, sample; -1 for none) and of words."""
    start, end = ends_of(places, words)
    head = [(k, k) for k in range(start)]
    tail = [(len(places) - end + k, len(words) - end + k) for k in range(end)]
    mid_places, mid_words = places[start : len(places) - end], words[start : len(words) - end]
    n, m = len(mid_places), len(mid_words)
    if n < 2 or n * m <= CELLS:
        found = path((mid_places[:, :, None] == mid_words[None, None, :]).any(axis=1))
    else:
        half = n // 2
        row_by_row = lambda p, w: ((row[:, None] == w[None, :]).any(axis=0) for row in p)
        left = edges_of(row_by_row(mid_places[:half], mid_words), m)
        right = edges_of(row_by_row(mid_places[half:][::-1], mid_words[::-1]), m)[::-1]
        cut = int((left + right).argmin())
        found = align(mid_places[:half], mid_words[:cut])
        found += [(None if i is None else i + half, None if j is None else j + cut) for i, j in align(mid_places[half:], mid_words[cut:])]
    return head + [(None if i is None else i + start, None if j is None else j + start) for i, j in found] + tail


@dataclass
class Network:
    """The places of all samples. ``at`` (place, sample) numbers a sample's words, ``spelled`` those of all, ``keys`` what they mean; -1 for none."""

    words: list[str]
    critical: np.ndarray
    at: np.ndarray
    spelled: np.ndarray
    keys: np.ndarray


def aligned(samples: list[str]) -> Network:
    words = [s.split() for s in samples]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    of = lambda own, numbered: np.fromiter(map(numbered.__getitem__, own), np.int64, len(own))
    spelled = [of(own, numbers) for own in words]
    meant = [key_of(w) for w in numbers]
    meanings = of(meant, {key: k for k, key in enumerate(dict.fromkeys(meant))})
    at = np.arange(len(spelled[0]))[:, None]
    keys = meanings[spelled[0]][:, None]
    for sample in spelled[1:]:
        own = meanings[sample]
        start, end = ends_of(keys, own)
        n, m = len(keys) - end, len(own) - end
        middle = [(-1 if i is None else i + start, -1 if j is None else j + start) for i, j in align(keys[start:n], own[start:m])]
        old, new = np.array(middle, np.int64).reshape(-1, 2).T
        old, new = np.concatenate([np.arange(start), old, np.arange(n, n + end)]), np.concatenate([np.arange(start), new, np.arange(m, m + end)])
        at, keys = np.column_stack([taken(at, old), new]), np.column_stack([taken(keys, old), taken(own, new)])
    critical = np.array([*map(is_critical, numbers), False])
    return Network(list(numbers), critical, at, np.column_stack([taken(s, at[:, k]) for k, s in enumerate(spelled)]), keys)


def taken(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The rows by their numbers; -1 for those of -1."""
    return np.concatenate([rows, np.full((1, *rows.shape[1:]), -1)])[numbers]


def network(samples: list[str]) -> list[Place]:
    """The places of all samples, each with a reading of every sample."""
    words = [WORD.findall(s) for s in samples]
    return [[None if j < 0 else words[k][j] for k, j in enumerate(row)] for row in aligned(samples).at.tolist()]


def elect(words: list[str | None]) -> int | None:
    """The sample with the reading of the majority, spelled as most of it spell it; None if that has no word there.

    Without a majority, the word that more samples have than any other, else the longest one. The first of equal ones.
    A word that is left out beside its equal may be missed at either of their places, and there be one reading less besides
    another error: what is left of its samples is still the most.
    """
    own = [None if w is None else key_of(w) for w in words]
    key, n = Counter(own).most_common(1)[0]
    if 2 * n <= len(words):
        (key, n), *others = Counter(k for k in own if k is not None).most_common(2)
        if others and others[0][1] == n:
            return max((k for k, w in enumerate(words) if w is not None), key=lambda k: len(words[k]))
    if key is None:
        return None
    spelled = Counter(w for w, k in zip(words, own, strict=True) if k == key)
    return max((k for k in range(len(words)) if own[k] == key), key=lambda k: spelled[words[k]])


def text_of(elected: list[tuple[str, str] | None]) -> str:
    return "".join(before + word for before, word in filter(None, elected)).strip()


def certainty(net: Network, keys: np.ndarray, spelled: np.ndarray, chosen: np.ndarray) -> float:
    """The rubric's figure for the share of disagreement, by weight, among the words of the elected text.

    ``chosen`` has the elected text's meaning at each place, ``keys`` and ``spelled`` the samples' readings. Full agreement but for
    case, blanks and punctuation is 1. Each share in ``SHARES`` ends a range of the rubric, within which the figure falls evenly;
    a figure or unit that samples disagree on leaves no more than the third range.
    """
    critical = net.critical[spelled].any(axis=1)
    weight = np.where(critical, CRITICAL, OTHER)
    off = (keys != chosen[:, None]).sum(axis=1)
    total, apart = int(weight[chosen >= 0].sum()), int((weight * off).sum()) / keys.shape[1]
    if not apart:
        return CONFIDENCE[0][0]
    share = min(1.0, apart / total) if total else 1.0
    ranges = [(0.0, CONFIDENCE[1][1]), (SHARES[0], CONFIDENCE[1][0]), (SHARES[1], CONFIDENCE[2][0]), (SHARES[2], CONFIDENCE[3][0]), (1.0, CONFIDENCE[4][0])]
    value = float(np.interp(share, [x for x, _ in ranges], [y for _, y in ranges]))
    return min(value, CONFIDENCE[2][1]) if (off[critical] > 0).any() else value


def merge(samples: list[str]) -> tuple[str, float]:
    """The voted text and its confidence. No samples give an empty text without confidence, equal ones themselves with full confidence."""
    if not samples:
        return "", 0.0
    if len(set(samples)) == 1:
        return samples[0], 1.0
    net = aligned(samples)
    by = np.zeros(len(net.at), np.int64)
    for row in np.flatnonzero((net.spelled != net.spelled[:, :1]).any(axis=1)).tolist():
        found = elect([None if w < 0 else net.words[w] for w in net.spelled[row].tolist()])
        by[row] = -1 if found is None else found
    rows, said = np.flatnonzero(by >= 0), by[by >= 0]
    at = net.at[rows, said]
    chosen = np.full(len(by), -1)
    chosen[rows] = net.keys[rows, said]
    sure = certainty(net, net.keys, net.spelled, chosen)
    if not len(rows):
        return "", sure
    # Words that follow each other in a sample are taken together, with the white space before them.
    starts = np.flatnonzero(np.append(True, (np.diff(said) != 0) | (np.diff(at) != 1)))
    lasts = np.append(starts[1:], len(rows)) - 1
    ends = {k: [0, *(m.end() for m in WORD.finditer(samples[k]))] for k in set(said.tolist())}
    return "".join(samples[k][ends[k][i] : ends[k][j + 1]] for k, i, j in zip(said[starts].tolist(), at[starts].tolist(), at[lasts].tolist(), strict=True)).strip(), sure


def score(merged: str, samples: list[str]) -> float:
    """The confidence of any merged text from the samples that it was made of."""
    net = aligned([merged, *samples])
    return certainty(net, net.keys[:, 1:], net.spelled[:, 1:], net.keys[:, 0])


def merged(samples: DataFrame, keys: tuple[str, ...] = ("doc_stem", "page_number")) -> DataFrame:
    """keys, transcription, transcription_confidence from (keys, sample_idx, text). A null text counts as empty; samples are few a page."""

    @F.pandas_udf("text string, confidence double")
    def work(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merge([t or "" for t in own]) for own in texts], columns=["text", "confidence"])

    grouped = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample_idx", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    found = grouped.select(*keys, work(F.transform("s", lambda x: x["text"])).alias("m"))
    return found.select(*keys, F.col("m.text").alias("transcription"), F.col("m.confidence").alias("transcription_confidence"))
