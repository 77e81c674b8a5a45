"""Aligned votes against plain alignments, and the rubric's cases."""

import random

import numpy as np
import pytest

from folioflow.operators import alignment as A
from folioflow.prompts import CONFIDENCE


def distance(places, words):
    """Edit distance of a list of sets and a list of words, cell by cell."""
    row = list(range(len(words) + 1))
    for i, p in enumerate(places, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w not in p)))
        row = new
    return row[-1]


def cost(pairs, places, words):
    return sum(i is None or j is None or words[j] not in places[i] for i, j in pairs)


@pytest.mark.parametrize("cells", [1, 4, 1 << 21])
def test_alignments_are_cheapest(cells, monkeypatch):
    """Whole, and cut in halves."""
    monkeypatch.setattr(A, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(300):
        places = np.array([[rng.randint(-1, 4) for _ in range(2)] for _ in range(rng.randint(0, 9))], np.int64).reshape(-1, 2)
        words = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 9))], np.int64)
        pairs = A.align(places, words)
        assert [i for i, _ in pairs if i is not None] == list(range(len(places))) and [j for _, j in pairs if j is not None] == list(range(len(words)))
        sets = [set(p.tolist()) - {-1} for p in places]
        assert cost(pairs, sets, words.tolist()) == distance(sets, words.tolist())


def test_networks_hold_their_samples():
    rng = random.Random(5)
    for _ in range(100):
        samples = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        places = A.network(samples)
        assert [A.text_of([p[k] for p in places]) for k in range(len(samples))] == samples


def test_majority_at_each_place():
    said = "Left kidney 10 mm cyst\nno stones seen"
    samples = [said.replace("cyst", "cist"), said.replace("Left ", ""), said.replace("seen", "seen today")]
    assert A.merge(samples)[0] == said
    assert A.merge(["a b c", "a x c", "a y c"])[0] == "a b c"  # none agree: the longest, the first of equal ones
    assert A.merge(["a b", "a bbb", "a cc"])[0] == "a bbb" and A.merge(["a", "a b"])[0] == "a b"
    assert A.merge(["Dose: 5 mg", "dose 5 mg", "dose 5 mg."])[0] == "dose 5 mg"  # spelled as most of the majority do


@pytest.mark.parametrize("said", ["mentear la. La la los asezado", "eran of. Of of thenheea the", "so la la la la la los"])
def test_word_missed_beside_its_equals(said):
    """It may be missed at the place of any of them, one of which another sample has wrong."""
    words = said.split()
    for at in range(len(words)):
        samples = [list(words) for _ in range(4)]
        samples[1][at] = "qqa"
        samples[3][(at + 4) % len(words)] = "qqb"
        del samples[2][(at + 2) % len(words)]
        texts = [" ".join(s) for s in samples]
        merged, value = A.merge(texts)
        assert merged == said and A.score(merged, texts) == pytest.approx(value)


def test_no_samples_and_equal_ones():
    assert A.merge([]) == ("", 0.0) and A.merge(["  x \n"]) == ("  x \n", 1.0) and A.merge(["", ""]) == ("", 1.0)
    assert A.merge(["", "", "a b"]) == ("", 0.0) and A.merge(["a b", "a b", ""])[0] == "a b"


WORDS = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(100)]


def certainty(samples):
    return A.merge(samples)[1]


def test_rubric():
    """Each range of the rubric has a case of its kind."""
    said = " ".join([*WORDS[:60], "size", "12", "mm"])
    assert certainty([said, said.upper(), said.replace(" ", "\n").replace("size", "size,")]) == 1.0
    detail = certainty([said, said, said.replace(WORDS[3], "other")])
    assert CONFIDENCE[1][0] <= detail < CONFIDENCE[1][1]
    figure = certainty([said, said, said.replace("12", "17")])
    assert CONFIDENCE[2][0] <= figure <= CONFIDENCE[2][1]
    unit = certainty([said, said, said.replace("mm", "cm")])
    assert CONFIDENCE[2][0] <= unit <= CONFIDENCE[2][1]
    third = [" ".join([*WORDS[:40]]), " ".join([*WORDS[:20], *WORDS[40:60]]), " ".join(WORDS[60:])]
    assert CONFIDENCE[3][0] <= certainty(third) <= CONFIDENCE[3][1]
    assert certainty([" ".join(WORDS[:30]), " ".join(WORDS[30:60]), " ".join(WORDS[60:90])]) < CONFIDENCE[3][0]


@pytest.mark.parametrize("kind", ["other", "missing", "added", "figure"])
def test_more_errors_never_raise_it(kind):
    base = [w if k % 5 else str(k) for k, w in enumerate(WORDS)]
    rng, erring, last = random.Random(2), list(base), 1.0
    for k in rng.sample(range(100), 60):
        if kind == "missing":
            erring[k] = ""
        elif kind == "added":
            erring[k] = f"{base[k]} extra"
        else:
            erring[k] = "zzz" if kind == "other" else "999"
        now = certainty([" ".join(base), " ".join(base), " ".join(x for x in erring if x)])
        assert now <= last
        last = now
    assert last < CONFIDENCE[1][0]


def test_score_of_any_merged_text():
    samples = ["a b 5 d", "a b 5 d", "a b 6 d"]
    merged, value = A.merge(samples)
    assert A.score(merged, samples) == pytest.approx(value)
    assert A.score("nothing of it", samples) < 0.1


def test_long_samples_in_linear_memory():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 3000)}x" for _ in range(6000)]
    samples = []
    for k in range(3):
        own = list(words)
        for at in range(k, 6000, 60):
            own[at] = f"wrong{k}"
        samples.append("\n".join(own))
    assert A.merge(samples)[0] == "\n".join(words)


def test_columns(spark):
    rows = [("d", 1, 1, "a x c"), ("d", 1, 0, "a b c"), ("d", 1, 2, "a b c"), ("d", 2, 0, None), ("e", 1, 0, "same"), ("e", 1, 1, "same")]
    got = {(r[0], r[1]): (r[2], r[3]) for r in A.merged(spark.createDataFrame(rows, "doc_stem string, page_number int, sample_idx int, text string")).collect()}
    assert got["d", 1][0] == "a b c" and 0 < got["d", 1][1] < 1 and got["d", 2] == ("", 1.0) and got["e", 1] == ("same", 1.0)
