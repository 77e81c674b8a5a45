"""Operators against plain models of their rules."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import checks, chunking, naming, providers, records, voting

PAGE = "doc_stem string, page_number int, transcription string, exam_date string"


def elect(spark, pages, exclude=None, name=None):
    rows = [("d", k + 1, t, e) for k, (t, e) in enumerate(pages)]
    random.Random(3).shuffle(rows)
    births = spark.createDataFrame([("d", exclude)], "doc_stem string, birth_date string") if exclude else None
    names = spark.createDataFrame([("d", name)], "doc_stem string, filename_date string") if name else None
    return voting.elect_date(spark.createDataFrame(rows, PAGE).repartition(3), births, names).first()["document_date"]


def test_date_vote(spark):
    a, b, c = "2020-01-01", "2021-01-01", "2022-01-01"
    t = lambda *d: (" ".join(d), None)
    assert elect(spark, [t(b), t(a)]) == b
    assert elect(spark, [t(a), t(b), t(b)]) == b
    assert elect(spark, [t(a), t(b), t(b)], name=a) == a
    assert elect(spark, [t(a), t(b), t(b)], name=c) == b
    assert elect(spark, [t(b, a)]) == a
    assert elect(spark, [t(b, a)], exclude=a) == b
    assert elect(spark, [("none", c), (None, c)]) == c
    assert elect(spark, [(a, a)], exclude=a) == a
    assert elect(spark, [("none", "")]) is None


def model_chunks(costs, budget):
    out, chunk, used, open_ = [], 0, 0, False
    for cost in costs:
        if not open_ and cost > budget:
            out.append(chunk)
            chunk += 1
            continue
        if open_ and used + cost > budget:
            chunk, used = chunk + 1, 0
        out.append(chunk)
        used, open_ = used + cost, True
    return out


def test_chunks_match_model(spark):
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.integers(0, 30), min_size=1, max_size=12))
    def collect(costs):
        cases.append(costs)

    cases = []
    collect()
    rows = [(str(k), i + 1, c) for k, costs in enumerate(cases) for i, c in enumerate(costs)]
    got = chunking.assign_chunks(spark.createDataFrame(rows, "doc_stem string, page_number int, cost long"), 20, F.col("cost")).orderBy(F.col("doc_stem").cast("int"), "page_number").collect()
    by = {}
    for r in got:
        by.setdefault(int(r["doc_stem"]), []).append(r["chunk_idx"])
    assert all(by[k] == model_chunks(costs, 20) for k, costs in enumerate(cases))


def test_chunks_of_a_long_document(spark):
    """A document of 300,000 pages streams through; no array, no group."""
    pages = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "short").otherwise("long").alias("doc_stem"), (F.col("id") * 7919 % 300_007).cast("int").alias("page_number"), (F.col("id") * 31 % 29).alias("cost"))
    found = chunking.assign_chunks(pages, 20, F.col("cost"))
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    rows = pages.toPandas().sort_values(["doc_stem", "page_number"])
    for stem, part in rows.groupby("doc_stem"):
        got = found.where(F.col("doc_stem") == stem).orderBy("page_number").toPandas()["chunk_idx"].tolist()
        assert got == model_chunks(part["cost"].tolist(), 20)


def test_sample_vote(spark):
    rows = [("d", 1, 0, "x"), ("d", 1, 1, "y"), ("d", 1, 2, "y"), ("d", 2, 0, "b"), ("d", 2, 1, "a")]
    got = {r["page_number"]: (r["text"], r["agreed"]) for r in providers.native_vote(spark.createDataFrame(rows, "doc_stem string, page_number int, sample_idx int, text string")).collect()}
    assert got == {1: ("y", False), 2: ("b", False)}


def test_naming(spark):
    cache = spark.createDataFrame([("a", "imaging", "Std A")], "cache_key string, exam_type string, standardized_name string")
    names = spark.createDataFrame([("A ",), ("b",), (None,), ("A ",)], "exam_name_raw string")
    assert [r[0] for r in naming.uncached(names, cache).collect()] == ["b"]
    assert {tuple(r) for r in naming.look_up(names, cache).collect()} == {("A ", "imaging", "Std A"), ("b", "other", "b")}
    answers = spark.createDataFrame([("B", None, "One"), ("b ", "other", "Two")], "exam_name_raw string, exam_type string, standardized_name string")
    assert {tuple(r) for r in naming.merge(cache, answers).collect()} == {("a", "imaging", "Std A"), ("b", "other", "Two")}


class Flaky(providers.StubProvider):
    def __init__(self, texts):
        self.texts = list(texts)

    def transcribe(self, image, variant, temperature, context=""):
        found = self.texts.pop(0)
        if isinstance(found, Exception):
            raise found
        return found


def test_retry():
    good = "a text that is long enough"
    assert providers.transcribe_with_retry(Flaky(["", RuntimeError(), good]), b"") == (good, "transcription_system_alt2", 3)
    assert providers.transcribe_with_retry(Flaky(["", "", "", "short"]), b"") == ("short", "transcription_system_alt3", 4)
    assert providers.transcribe_with_retry(Flaky([RuntimeError()] * 4), b"") == ("", "transcription_system", 4)


def test_confidence_and_classify():
    stub = providers.StubProvider()
    assert providers.confidence_of(stub, "a", ["a", "a"]) == 1.0
    assert providers.confidence_of(stub, "a", ["a", "b"]) == pytest.approx(0.2)  # half of all there is differs

    class Broken:
        def __getattr__(self, _):
            raise RuntimeError

    assert providers.confidence_of(Broken(), "a", ["a", "b"]) == 0.5
    assert providers.classify_document(Broken(), [b"x"])["is_exam"] is True
    assert providers.valid(Broken(), "x" * 30) == (True, "")


def test_summary_fold(spark):
    rows = [("d", 1, "x" * 4000), ("d", 2, "y" * 4000), ("e", 1, "  ")]
    pages = spark.createDataFrame(rows, "doc_stem string, page_number int, transcription string").selectExpr("*", "'N' as exam_name_raw", "cast(null as string) as exam_name_standardized", "cast(null as string) as exam_type", "cast(null as string) as exam_date")

    class Empty(providers.StubProvider):
        def summarize(self, system, prompt):
            return "" if "so far" in prompt else "s"

    class Failing(providers.StubProvider):
        def summarize(self, system, prompt):
            if "so far" in prompt:
                raise RuntimeError
            return "s"

    keep = lambda df, _: spark.createDataFrame(df.collect(), df.schema)
    assert [tuple(r) for r in providers.summarize(pages, Empty, keep, 3300).collect()] == [("d", "")]
    assert [tuple(r) for r in providers.summarize(pages, Failing, keep, 3300).collect()] == [("d", "s")]
    assert providers.summarize(pages.limit(0), Failing, keep, 3300).collect() == []


def test_fold_taken_up_again(spark, tmp_path):
    """A run that is lost in a round calls nothing twice of the rounds before; documents of all lengths come to their own end."""
    rows = [(f"d{d}", p, f"{d} {p} " + "x" * 3000) for d in range(6) for p in range(1, d + 2)]
    pages = spark.createDataFrame(rows, "doc_stem string, page_number int, transcription string").selectExpr("*", "'N' as exam_name_raw", "cast(null as string) as exam_name_standardized", "cast(null as string) as exam_type", "cast(null as string) as exam_date")
    log = tmp_path / "calls"
    log.mkdir()

    class Counting(providers.StubProvider):
        def summarize(self, system, prompt):
            import re
            import uuid

            found = "-".join(re.findall(r"\n(\d \d) x", prompt)).replace(" ", "_")
            (log / f"{found}-{uuid.uuid4().hex}").touch()
            return f"{re.findall('sum:([^.]*)[.]', prompt)[0] if 'so far' in prompt else ''}".join(["sum:", f"{found}."])

    def stage(lost):
        def put(df, name):
            where = tmp_path / "work" / name
            if not (where / "_SUCCESS").exists():
                if name == lost:
                    raise RuntimeError("lost")
                df.write.mode("overwrite").parquet(str(where))
            return spark.read.schema(df.schema).parquet(str(where))

        return put

    with pytest.raises(RuntimeError, match="lost"):
        providers.summarize(pages, Counting, stage("summary-3"), 3300)
    assert len(list(log.iterdir())) == 6 + 5 + 4
    got = {r[0]: r[1] for r in providers.summarize(pages, Counting, stage(None), 3300, workers=3).collect()}
    assert len(list(log.iterdir())) == sum(range(1, 7))
    assert got == {f"d{d}": "sum:" + "".join(f"{d}_{p}" for p in range(1, d + 2)) + "." for d in range(6)}


def test_long_documents_are_classified_in_parts(spark):
    """A document of 10,000 pages; no call and no group has more than some of them, and the result is that of one call."""
    rows = spark.range(10_000, numPartitions=8).select(F.lit("long").alias("doc_stem"), (F.col("id") + 1).cast("int").alias("page_number"), F.concat(F.lit("Exam page "), F.col("id"), F.when(F.col("id") == 700, F.lit(" 2024-02-03")).otherwise("")).cast("binary").alias("image"))

    class Bounded(providers.StubProvider):
        def classify(self, pages, context=""):
            assert len(pages) <= 64
            return super().classify(pages, context)

    more = spark.createDataFrame([("bill", 1, b"fatura 1"), ("two", 2, b"b 2020-01-01"), ("two", 1, b"\n A \n")], "doc_stem string, page_number int, image binary")
    got = {r["doc_stem"]: (r["is_exam"], r["exam_name_raw"], r["exam_date"]) for r in providers.classify(rows.unionByName(more), Bounded).collect()}
    assert got == {"long": (True, "Exam page 0", "2024-02-03"), "bill": (False, "fatura 1", None), "two": (True, "A", "2020-01-01")}


def test_selection(spark):
    docs = spark.createDataFrame([("A.pdf", "A"), ("b.PDF", "b"), ("c.pdf", "c"), ("C.pdf", "C")], "file_name string, doc_stem string")
    assert records.select_one(docs, "a.PDF").first()["doc_stem"] == "A"
    for query in ("none", "c"):
        with pytest.raises(LookupError):
            records.select_one(docs, query)


def test_roll_up(spark):
    status = spark.createDataFrame([("a", "processed", 2), ("b", "processed", 0), ("c", "failed", 0)], "doc_stem string, status string, pages int")
    assert {tuple(r) for r in checks.roll_up(status).collect()} == {("processed", 2, 2), ("failed", 1, 0)}


def test_vote_model(spark):
    rng = random.Random(1)
    docs = [[rng.choice(["2020-01-01", "2020-01-02", "none"]) for _ in range(rng.randint(1, 6))] for _ in range(40)]
    rows = [(str(k), i + 1, t, None) for k, d in enumerate(docs) for i, t in enumerate(d)]
    got = {int(r[0]): r[1] for r in voting.elect_date(spark.createDataFrame(rows, PAGE)).collect()}
    for k, d in enumerate(docs):
        seen = Counter(t for t in d if t != "none")
        assert got[k] == (seen.most_common(1)[0][0] if seen else None)


def test_fences_in_both_places(spark):
    """The Python side and the column agree."""
    cases = ["```json\n{}\n```", "```\na", "```x```", "a", "", "```", "```\n", "```\n```", "```\n\n```\n```", "``` \n b \n  ``` ", "```\na\n```\n", "x\n```", "```\na\n``` end", "````\nq\n````"]
    got = [r[0] for r in spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").orderBy("k").select(text.strip_fences(F.col("c"))).collect()]
    assert [providers.strip_fences_text(c) for c in cases] == got


def test_calls_in_flight_keep_their_order():
    """A slow call holds up no others; no more run at a time than asked for, and no more are taken than can wait."""
    import threading
    import time

    assert list(providers.sliding(4, lambda x: x * x, range(30))) == list(providers.sliding(1, lambda x: x * x, range(30))) == [x * x for x in range(30)]
    lock, running, most, done, taken = threading.Lock(), 0, 0, [], 0

    def call(x):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.3 if x == 0 else 0.01)
        with lock:
            running -= 1
            done.append(x)
        return x

    def items():
        nonlocal taken
        for x in range(40):
            taken += 1
            yield x

    answers = providers.sliding(4, call, items())
    assert next(answers) == 0 and taken <= 8 and set(done) >= {1, 2, 3, 4, 5, 6}
    assert list(answers) == list(range(1, 40)) and most == 4
    assert [len(f) for f in providers.framed(((k,) for k in range(150)), ["a"])] == [64, 64, 22] and list(providers.framed([], ["a"])) == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_nearest_names_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    known = sorted({f"{word(rng.randint(1, 9))} {word(rng.randint(0, 6))}".strip() for _ in range(120)})
    asked = set()
    for _ in range(250):
        name = list(rng.choice(known))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d", "c"])
        asked.add("".join(name))
    frame = spark.createDataFrame([(k, "other", k.upper()) for k in known], "cache_key string, exam_type string, standardized_name string")
    rows = [(n,) for n in asked] * 2 + [(None,), (" ",), ("",)]
    for share in (0.1, 0.2, 0.34):
        want = {}
        for n in asked:
            text = " ".join(n.split())
            near = [(edits(text, k), k) for k in known if text and edits(text, k) <= int(max(len(text), len(k)) * share)]
            if near:
                want[n] = min(near)
        got = {r["exam_name_raw"]: (r["distance"], r["cache_key"]) for r in naming.nearest(spark.createDataFrame(rows, "exam_name_raw string").repartition(3), frame, share).collect()}
        assert got == want and len(want) > 50


def test_names_of_the_guide(spark):
    """All worked examples, as they stand and misspelled; what is near none stays uncached."""
    import json

    from folioflow.prompts import EXAMPLES

    answers = json.loads(providers.StubProvider().standardize([name for name, _, _ in EXAMPLES]))
    assert [(n, a["exam_type"], a["standardized_name"]) for n, a in answers.items()] == list(EXAMPLES)
    wrong = ["radiografia do torax", "Ecografia  Abdominál", "EDA.", "Eletrocardiogrma", "RM Cerebrall", "Receita Medica", "Prescriçao", "Marcacao de Consulta", "Convocatoria"]
    names = spark.createDataFrame([(n,) for n in [*wrong, "Ecografia Renal", "Biopsia", "XY"]], "exam_name_raw string")
    got = {r["exam_name_raw"]: (r["exam_type"], r["standardized_name"]) for r in naming.nearest(names, naming.guide(spark)).collect()}
    assert got == {w: (kind, standard) for w, (_, kind, standard) in zip(wrong, EXAMPLES, strict=True)}
    merged = naming.merge(naming.guide(spark), naming.nearest(names, naming.guide(spark)))
    assert {r[0] for r in naming.uncached(names, merged).collect()} == {"Ecografia Renal", "Biopsia", "XY"}


def test_hot_grams_meet_nothing(spark):
    """Names that share all but their rarest grams are compared with few others."""
    known = spark.range(3000).select(F.concat(F.lit("exame de rotina numero "), F.col("id")).alias("cache_key"), F.lit("other").alias("exam_type"), F.lit("x").alias("standardized_name"))
    names = spark.createDataFrame([("exame de rotnia numero 17",)], "exam_name_raw string")
    assert naming.nearest(names, known, 0.1).first()["cache_key"] == "exame de rotina numero 17"


def test_names_in_batches(spark):
    import json

    names = [f"name {k:03d} é\"" for k in range(137)]
    frame = spark.createDataFrame([(n,) for n in names * 2] + [(None,), ("",)], "exam_name_raw string").repartition(5)
    got = {r["batch"]: json.loads(r["names"]) for r in chunking.names_json(frame, 20).collect()}
    assert [n for k in sorted(got) for n in got[k]] == sorted(["", *names]) and [len(got[k]) for k in sorted(got)] == [20] * 6 + [18]
    assert chunking.names_json(frame.limit(0)).collect() == []

    class Watching(providers.StubProvider):
        def standardize(self, part):
            assert len(part) <= 30 and part == sorted(part)
            return super().standardize(part) if "name 000 é\"" not in part else "no answer"

    found = {r["exam_name_raw"] for r in providers.standardize(frame, Watching, 30).collect()}
    assert found == set(sorted(["", *names])[30:])
