"""Similarity operators against all pairs on small tables."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import embedding_dedup, jaccard_join, line_dedup


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(n=60, copies=120, words=40):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(words)] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for k in range(copies):
        b = list(base[0] if k % 3 else base[rng.randrange(n)])
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = f"new{rng.randint(0, 9)}"
        out.append(" ".join(b) + ("." if k % 5 == 0 else ""))
    return out + ["", None, "one", "one", "One!", "a b c", "?!", "long " * 20_000]


def test_jaccard_matches_all_pairs(documents, extra):
    rows = list(enumerate(texts()))
    sets = {i: set(jaccard_join.shingles(t or "").tolist()) for i, t in rows}
    linked = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = classes(sets, linked)
    got = {r["doc_id"]: r for r in jaccard_join.join(extra(documents(rows)).repartition(5)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["n_links"] == sum(i in p for p in linked) for i, r in got.items())
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())
    assert len(linked) > 200


def test_jaccard_edges(documents):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "other words in here now"), (4, "A b, c d e f")]
    got = sorted(jaccard_join.join(documents(rows)).collect(), key=str)
    assert [r["kept"] for r in got].count(True) == 2 and {r["class_id"] for r in got} == {3, 4}
    left = jaccard_join.keep_one(documents(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(3, "a b c d e f"), (4, "other words in here now")]
    assert jaccard_join.join(documents([])).collect() == []


def test_prefixes_end_at_different_depths():
    stop = lambda n, **o: jaccard_join.depth(n, **({"trees": 20, "longest": 8, "similarity": 0.8, "recall": 0.999} | o))
    assert [stop(n) for n in (1, 3, 4, 6, 7, 500)] == [None, None, 5, 6, 7, 5] and stop(500, trees=1) == 1
    for n in range(1, 40):
        found = [i / (n + m - i) for m in range(1, 80) for i in range(min(n, m) + 1) if (i < n or m > n) and 10 * i >= 8 * (n + m - i)]
        assert jaccard_join.least_similarity(n, 0.8) == (min(found) if found else None)


FOREST = {"trees": 20, "longest": 8, "similarity": 0.8, "recall": 0.999}


def test_prefixes_are_shortened_by_what_they_match():
    """From the matched lengths down, the longest first, until the recall holds; never below the floor."""
    miss = lambda lengths, s=0.8: np.prod([1 - s**d for d in lengths]) * (1 - s**5) ** (20 - len(lengths))
    assert jaccard_join.shortened(270, [], **FOREST) == [] and jaccard_join.shortened(270, [5, 5], **FOREST) == [5, 5]
    assert jaccard_join.shortened(270, [8, 5, 6], **FOREST) == [8, 5, 6] and miss([8, 5, 6]) < 0.001
    assert jaccard_join.shortened(270, [8] * 20, **FOREST)[0] < 8 and miss([8] * 20) > 0.001
    rng = random.Random(3)
    for _ in range(200):
        matched = [rng.randint(5, 8) for _ in range(rng.randint(0, 20))]
        got = jaccard_join.shortened(270, matched, **FOREST)
        assert all(5 <= d <= m for d, m in zip(got, matched, strict=True)) and miss(got) <= 0.001
        if got != matched:  # one step less would not do
            k = min((k for k in range(len(got)) if got[k] < matched[k]), key=lambda k: got[k])
            assert miss([d + (j == k) for j, d in enumerate(got)]) > 0.001
    assert set(jaccard_join.shortened(7, [8] * 20, **FOREST)) == {7, 8}  # partners of 6/7 or more need little


def planted(n, share, seed):
    """Texts of 270 shingles in fours: a text, a close copy, one that is about ``share`` similar to it, and a close copy of that."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for k in range(n):
        base = [word() for _ in range(274)]

        def edited(words, edits):
            out = list(words)
            for at in rng.sample(range(4, 270, 5), edits):
                out[at] = word()
            return out

        far = edited(base, int(270 * (1 - share) / (1 + share) / 5))
        rows += [(4 * k + j, " ".join(t)) for j, t in enumerate((base, edited(base, 1), far, edited(far, 1)))]
    return rows


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_forest_recall(documents, similarity):
    """All links are found, against all pairs; documents end at different depths."""
    rows = planted(60, similarity + 0.01, int(100 * similarity))
    sets = {i: set(jaccard_join.shingles(t).tolist()) for i, t in rows}
    linked = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r for r in jaccard_join.join(documents(rows).repartition(3), similarity=similarity).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in linked) for i in sets}
    assert {i: r["class_id"] for i, r in got.items()} == classes(sets, linked) and len(linked) > 150


def test_documents_end_at_different_depths(spark):
    """In one corpus, of sets of one size: those with close copies keep long prefixes in some trees, others come down to the floor; all reach the recall."""
    by = jaccard_join.multipliers(20, 8)
    rng = np.random.default_rng(6)
    sets = []
    for k in range(120):
        base = rng.integers(0, 1 << 63, 270, dtype=np.uint64)
        sets.append(base)
        other = base.copy()
        edits = 3 if k % 2 else 29
        other[rng.choice(270, edits, replace=False)] = rng.integers(0, 1 << 63, edits, dtype=np.uint64)
        sets.append(other)
    items = spark.createDataFrame([(k, 270, jaccard_join.signature(np.sort(x), by)) for k, x in enumerate(sets)], "item long, size long, sign binary")
    placed = jaccard_join.forest(items.repartition(3), **FOREST)
    ends = {}
    for r in placed.collect():
        ends.setdefault(r["item"], {})[r["tree"]] = r["depth"]
        assert bytes(r["label"]) == jaccard_join.signature(np.sort(sets[r["item"]]), by)[16 * r["tree"] : 16 * r["tree"] + 16]
    assert {d for e in ends.values() for d in e.values()} == {5, 6, 7, 8}
    mean = lambda odd: np.mean([np.mean(list(e.values())) for k, e in ends.items() if k // 2 % 2 == odd])
    assert mean(1) > mean(0)
    assert all(np.prod([1 - 0.8 ** e.get(t, 5) for t in range(20)]) <= 0.001 for e in ends.values())
    keys = {}
    for r in jaccard_join.meetings(placed).collect():
        keys.setdefault(r["key"], set()).add(r["item"])
    met = {p for v in keys.values() for p in combinations(sorted(v), 2)}
    assert sum((2 * k, 2 * k + 1) in met for k in range(120)) >= 119
    least = jaccard_join.least_agreement(160, 0.8)
    signs = [np.frombuffer(jaccard_join.signature(np.sort(x), by), "<u2") for x in sets]
    assert all((signs[2 * k] == signs[2 * k + 1]).sum() >= least for k in range(120))


def test_blocks_give_the_same(documents, monkeypatch):
    from folioflow.llm import linking

    rows = list(enumerate(texts(20, 60)))
    whole = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(documents(rows)).collect()}
    plain = linking.blocked
    monkeypatch.setattr(linking, "blocked", lambda members, items, size: plain(members, 7, 200))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(documents(rows)).collect()} == whole


def test_embeddings_match_all_pairs(spark, extra):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 20))
    rows = [(k, (base[k % 40] + rng.normal(size=20) * (0.05 if k % 2 else 0.25)).tolist(), k % 40 % 3) for k in range(300)]
    rows += [(300 + k, (base[0] * 1e200).tolist(), 0) for k in range(3)]
    rows += [(400, None, 0), (401, [0.0] * 20, 0), (402, [float("nan")] * 20, 0), (403, [None] + [1.0] * 19, 0), (404, base[0].tolist(), None), (405, [], 1), (406, base[0][:5].tolist(), 0), (407, [float("inf")] * 20, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    sound = {i: (np.array(v, float), label) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: (v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), label) for i, (v, label) in sound.items()}
    linked = [(a, b) for a, b in combinations(unit, 2) if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.93]
    want = classes([r[0] for r in rows], linked)
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(extra(df)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_links"] == sum(i in p for p in linked) for i, r in got.items())
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())
    assert embedding_dedup.dedup(df.limit(0)).collect() == []


def test_rotation_keeps_lengths():
    for width in (5, 48, 200):
        x = np.random.default_rng(0).normal(size=(5, width))
        assert np.allclose(np.linalg.norm(embedding_dedup.rotated(x, [1, 2]), axis=2), np.linalg.norm(x, axis=1)[:, None], rtol=1e-4)


def test_recall_holds_as_labels_grow():
    made = embedding_dedup.plan(9_000_000_000, 64, 0.93, 1, 6, 0.9999, 1.0)
    rows, hashes, tables = zip(*made, strict=True)
    assert hashes[0] == 2 and rows[-1] >= 9_000_000_000 > rows[-2] and sorted(tables) == list(tables)
    for _, hashes, tables in made[1:6]:
        x, y = (embedding_dedup.buckets(v, tables, hashes, 6) for v in embedding_dedup.at_cosine(0.93, 64, 3000))
        assert embedding_dedup.meet(x, y).any(axis=1).mean() >= 0.999


def test_random_vectors_meet_few(spark, monkeypatch):
    """Unrelated vectors of one label: few candidates each, and none joins a group."""
    from folioflow.llm import linking

    real, seen = linking.groups, {}

    def watched(buckets, loads, *rest):
        most = buckets.groupBy("key").count().where("count > 1")
        seen["meetings"], seen["largest"] = most.agg(F.coalesce(F.sum(F.expr("count * (count - 1)")), F.lit(0)), F.coalesce(F.max("count"), F.lit(1))).first()
        out = real(buckets, loads, *rest)
        seen["grouped"] = out.count()
        return out

    monkeypatch.setattr(linking, "groups", watched)
    for n in (2000, 20_000):
        x = np.random.default_rng(n).normal(size=(n, 64)).round(4)
        df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
        assert embedding_dedup.dedup(df).where("n_links > 0").count() == 0
        assert seen["meetings"] <= 2 * n and seen["largest"] <= 16 and seen["grouped"] == 0


def own(k):
    return [f"own{k} line{j} " + " ".join(f"v{k}x{j}y{w}" for w in range(12)).translate(str.maketrans("0123456789", "abcdefghij")) for j in range(4)]


def cleaned(documents, rows, **options):
    return {r["doc_id"]: r for r in line_dedup.line_dedup(documents(rows), **options).collect()}


def test_lines(documents, extra):
    passage = "this passage of more words than eight stands in several documents of the corpus"
    rows = [(k, "\n".join([own(k)[0], passage, *own(k)[1:]])) for k in range(3)]
    rows += [(10 + k, "\n".join([f"Page {k} of 99 was printed on day {k} for reader number {k} here", *own(10 + k)])) for k in range(12)]
    rows += [(30 + k, "\n".join(["shared by alice in the group of friends on the site" if k else "shared by bob in the group of friends on the site", *own(30 + k)])) for k in range(2)]
    rows += [(40 + k, "\n".join(own(40))) for k in range(5)] + [(50, "ok\n" + "\n".join(own(50))), (51, "ok\n" + "\n".join(own(51)))]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "a\na\na"), (None, "\n".join([passage, *own(64)]))]
    got = cleaned(lambda r: extra(documents(r)), rows)
    text = {i: r["text"] for i, r in got.items()}
    assert passage in text[0] and all(passage not in text[i] for i in (1, 2, None))
    assert all("Page" not in text[10 + k] and got[10 + k]["n_dropped"] == 1 for k in range(12))
    assert "shared by bob" in text[30] and "shared by alice" in text[31]  # of different meaning, and in two documents
    assert all(text[40 + k] == "\n".join(own(40)) for k in range(5))
    assert text[50].startswith("ok\n") and text[51].startswith("ok\n")
    assert (text[60], text[61], text[62], text[63]) == (None, "", "\n\n", "a\na\na")
    assert all(r["lang"] == "en" for r in got.values()) and len(got) == len(rows)
    assert cleaned(documents, []) == {}


def test_repeated_rows_stay(documents):
    rows = [(1, "\n".join(own(1)))] * 3 + [(2, "x" * 200_000)]
    got = line_dedup.line_dedup(documents(rows)).collect()
    assert len(got) == 4 and all(r["n_dropped"] == 0 for r in got)


def words(name, n):
    return " ".join(f"{name}x{w}" for w in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def test_shared_passage_makes_no_copies(documents):
    passage, second = words("passage", 60), words("second", 60)
    rows = [(k, words(f"o{k}", 50) + "\n" + passage) for k in range(2)]
    rows += [(10 + k, words(f"o{10 + k}", 50) + "\n" + second) for k in range(12)]
    copied = [words("copied", 20), words("lines", 30), words("more", 40)]
    rows += [(30, "\n".join(copied)), (31, "\n".join(copied)), (32, "\n".join([copied[0] + " end", *copied[1:]]))]
    text = {i: r["text"] for i, r in cleaned(documents, rows).items()}
    assert passage in text[0] and passage not in text[1]
    assert all(second not in text[10 + k] for k in range(12))
    assert all(text[i] == dict(rows)[i] for i in (30, 31, 32))


def brute_lines(rows):
    """The texts that line dedup leaves, by its rules, on tokens instead of hashes."""
    order = {}
    for i, t in rows:
        key = (i is None, i or 0)
        order[t or ""] = min(key, order.get(t or "", key))
    where, holds = {}, {}
    for t in order:
        for at, line in enumerate(t.split("\n")):
            if line.split():
                where[t, at] = tuple(line.split())
    for place, verbatim in where.items():
        tokens = tuple("<*>" if any(c.isdigit() for c in x) else x for x in verbatim)
        n, constant = len(tokens), sum(x != "<*>" for x in tokens)
        cuts = [tokens[n * k // 8 : n * (k + 1) // 8] for k in range(8)]
        holds.setdefault((False, verbatim), set()).add(place)
        if constant < n and constant >= max(4, 2 * n / 3):
            holds.setdefault((True, tokens), set()).add(place)
        wild, most = (2, 2 * -(-n // 8)) if n >= 8 else (1, 1)
        for out in combinations(range(8), wild) if constant - most >= max(4, n / 2) else ():
            holds.setdefault((True, n, tokens[:2], out, tuple(c for k, c in enumerate(cuts) if k not in out)), set()).add(place)
    times = {t: sum((u or "") == t for _, u in rows) for t in order}
    holds = {k: v for k, v in holds.items() if not k[0] or sum(times[t] for t, _ in v) >= 10}
    size = {t: sum(len(x) for (u, _), x in where.items() if u == t) for t in order}
    kept = {k: v for k, v in holds.items() if len({t for t, _ in v}) > 1}
    up = {}
    for t in order:
        seen = {}
        for v in kept.values():
            first = min({u for u, _ in v}, key=lambda u: (order[u], hashlib.md5(u.encode()).digest()))
            for place in v:
                if place[0] == t != first:
                    seen.setdefault(first, set()).add(place)
        if seen:
            n, _, best = max((sum(len(where[p]) for p in v), hashlib.md5(u.encode()).digest(), u) for u, v in seen.items())
            a, b = (set(jaccard_join.shingles(x).tolist()) for x in (t, best))
            if n >= 0.2 * size[t] and len(a & b) >= 0.8 * len(a | b):
                up[t] = best

    def top(t):
        while t in up:
            t = up[t]
        return t

    gone = set()
    for k, v in kept.items():
        found = {top(t) for t, _ in v}
        n = max(len(where[p]) for p in v)
        first = top(min({u for u, _ in v}, key=lambda u: (order[u], hashlib.md5(top(u).encode()).digest())))
        if len(found) >= (2 if n >= 4 and not k[0] else 10):
            gone |= {p for p in v if len(found) >= 10 or top(p[0]) != first}
    return [t if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (t, at) not in gone) for _, t in rows]


def lined(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(2))
    base = [[word() for _ in range(n)] for n in (3, 4, 6, 7, 9, 12, 16, 16, 24, 40)]

    def line():
        out = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            out[rng.randrange(len(out))] = rng.choice((word(), "n7"))
        return " ".join(out)

    rows = [(k, "\n".join([*(line() for _ in range(rng.randint(0, 5))), *(" ".join(word() for _ in range(12)) for _ in range(rng.randint(0, 4)))])) for k in range(70)]
    for k in range(40):
        words_of = rng.choice(rows[:70])[1].split(" ")
        if k % 2 and len(words_of) > 30:
            words_of.insert(rng.randrange(len(words_of)), "inserted")
        rows.append((100 + k, " ".join(words_of)))
    return [*rows, (None, rows[3][1]), (None, "x"), (7, None), (8, "")]


def test_lines_of_figures_stay(documents):
    """Rows of decimals, dates or scores say nothing that recurs, whatever their number."""
    rng = random.Random(4)
    rows = [(k, "\n".join(" ".join(f"{rng.uniform(0, 99):.2f}" for _ in range(5)) for _ in range(6))) for k in range(12)]
    rows += [(20, "1994 23 45 12\n" + own(20)[0]), (21, "2001 5 7 9\n8.125 6.5 4.5 1.25\n" + own(21)[0])]
    rows += [(30 + k, f"mean {k}.5 sd {k}.1 n {k}0 p 0.0{k}\n" + own(30 + k)[0]) for k in range(15)]
    got = cleaned(documents, rows)
    assert all(got[i]["text"] == t and got[i]["n_dropped"] == 0 for i, t in rows)
    same = [(k, "1.5 2.5 3.5 4.5\n" + own(k)[0]) for k in range(3)]
    assert [cleaned(documents, same)[k]["n_dropped"] for k in range(3)] == [0, 1, 1]  # verbatim they recur


def test_sentences_of_other_meaning_stay(documents):
    said = "we found that {} treated with {} had fewer attacks during the winter than all the others did"
    rows = [(k, "\n".join([said.format(*x), *own(k)])) for k, x in enumerate([("children", "placebo"), ("patients", "aspirin"), ("adults", "ibuprofen")])]
    got = cleaned(documents, rows)
    assert all(got[i]["text"] == t for i, t in rows)


def test_precision_on_planted_lines(documents):
    """Boilerplate that varies in a name or a number goes; lines that share most words with a few others stay."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    alike = [[word() for _ in range(14)] for _ in range(40)]
    planted, clean, rows = 0, 0, []
    for k in range(160):
        lines = [f"article posted by {word()} on day {k} and read {k * 7} times by members of this site", f"printed for {word()} in the reading room of the old town library"]
        planted += 2
        for j in (k % 40, (k + 13) % 40):
            some = list(alike[j])  # in eight documents, with two other words in each
            some[rng.randrange(2, 14)] = word()
            some[rng.randrange(2, 14)] = word()
            lines.append(" ".join(some))
            clean += 1
        rows.append((k, "\n".join([*lines, *own(k)])))
    got = cleaned(documents, rows)
    dropped = [x for i, t in rows for x in t.split("\n") if x not in got[i]["text"].split("\n")]
    assert len(dropped) == planted and all("posted by" in x or "printed for" in x for x in dropped)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_brute_force(spark, documents, seed):
    rows = lined(seed)
    want = sorted(zip((i for i, _ in rows), brute_lines(rows), strict=True), key=str)
    assert sum(a != b for (_, a), b in zip(rows, brute_lines(rows), strict=True)) > 30
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = line_dedup.line_dedup(documents(rows).repartition(n)).collect()
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_boilerplate_makes_no_copies(documents):
    """One own line and three footer lines that all share; a short line of which one word varies; clashing names."""
    footer = [words(f"foot{k}", 15) for k in range(3)]
    rows = [(k, "\n".join([words(f"own{k}", 12), *footer])) for k in range(40)]
    rows += [(100 + k, words(f"more{k}", 20) + f"\nread by {words(f'n{k}', 1)} on the bus") for k in range(26)]
    df = documents(rows).withColumns({c: F.lit("x") for c in ("doc", "row", "dropped", "n_lines", "__key", "template")})
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert all(got[k]["text"] == words(f"own{k}", 12) for k in range(40))
    assert all(got[100 + k]["text"] == words(f"more{k}", 20) and got[100 + k]["doc"] == "x" and got[100 + k]["n_lines"] == 2 for k in range(26))


def test_lines_meet_what_their_templates_say_once(documents, monkeypatch):
    """A line of many documents and templates is decided as one row for each document, not one for each of its templates."""
    kept, put = {}, line_dedup.Scratch.put
    monkeypatch.setattr(line_dedup.Scratch, "put", lambda self, df, name: kept.update({name: put(self, df, name)}) or kept[name])
    rows = [(k, f"alpha beta gamma delta epsilon zeta eta theta iota\nalpha beta gamma delta epsilon zeta eta theta kappa{chr(97 + k)}\nown {chr(97 + k) * 9} text") for k in range(14)]
    gone = line_dedup.decide(documents(rows)).collect()
    assert len(gone) == 14 and all(r["dropped"] == [0, 1] for r in gone)
    assert kept["held"].count() > 28 and kept["known"].count() == 28


def test_lines_are_told_apart_by_compiled_code(documents, monkeypatch):
    """No function of an array's elements, which Spark runs without compiling it, sees the lines, and a document moves with its text once."""
    plans, put = {}, line_dedup.Scratch.put
    monkeypatch.setattr(line_dedup.Scratch, "put", lambda self, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or put(self, df, name))
    whole = line_dedup.line_dedup(documents([(1, "one line of some words\nand another"), (2, "third")]))
    assert "Generate posexplode" in plans["lines"] and "lambda" not in plans["lines"]
    moved = next(x for x in whole._jdf.queryExecution().optimizedPlan().toString().split("\n") if "struct(doc_id" in x)
    assert len(re.findall(r"AS (?!row)\w+#", moved)) == 1  # the digest, by which it moves


def test_blanks_and_marks_of_a_line(documents):
    """Lines are the same whatever blanks part their tokens; a mark of a field in the text is a token."""
    blanks = ["\t", "\x0b", "\x0c", "\r", "\xa0", "\u2000", "\u2005", "\u200a", "\u202f", "\u3000", "  "]
    said = "these words stand here in the same order \xe9t\xe9 \u65e5\u672c".split()
    rows = [(k, f"{b}{b.join(said)} {b}\n{words(f'o{k}', 12)}") for k, b in enumerate(blanks)]
    other = ["\u200b", "\u1680", "\x85", "\u2028"]  # these part no tokens
    rows += [(20 + k, f"{b.join(said)}\n{words(f'p{k}', 12)}") for k, b in enumerate(other)]
    got = cleaned(documents, rows)
    assert all(got[k]["text"] == words(f"o{k}", 12) for k in range(len(blanks)))
    assert all(got[20 + k]["n_dropped"] == 0 for k in range(len(other)))
    marks = [(k, f"said <*> of <*> as a<*> {k} times in {k} rows <*>\n{words(f'q{k}', 12)}") for k in range(12)]  # with the text's own marks five of twelve tokens are fields: no template
    assert all(r["n_dropped"] == 0 for r in cleaned(documents, marks).values())
