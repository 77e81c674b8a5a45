"""Model-backed operators: a provider interface, a deterministic stub, and their place in a plan.

A provider is built once per Python worker. Each stage is written before it is used
again, keyed by document, page, sample and variant, so that a repeated task repeats no
answered call of a finished stage.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions.text import too_short
from folioflow.operators import alignment
from folioflow.operators.chunking import assign_chunks, chunk_budget, exam_lists, names_json, transcriptions, with_content
from folioflow.operators.voting import vote_samples
from folioflow.prompts import EXAMPLES, PROMPTS, VARIANTS, fill


class ModelProvider(Protocol):
    """What a model service has to answer. Every method may raise; the operators say what follows."""

    def classify(self, pages: list[bytes], context: str = "") -> dict: ...
    def transcribe(self, image: bytes, variant: str, temperature: float, context: str = "") -> str: ...
    def is_refusal(self, text: str) -> bool: ...
    def vote(self, samples: list[str]) -> str: ...
    def score(self, merged: str, samples: list[str]) -> str: ...
    def standardize(self, names: list[str]) -> str: ...
    def summarize(self, system: str, prompt: str) -> str: ...


#: Keywords of the stub's categories, in the order in which they are tried.
KEYWORDS = (
    ("ultrasound", ("ultrasound", "ecografia", "doppler", "eco")),
    ("endoscopy", ("endoscopy", "endoscopia", "colonoscopia", "colonoscopy")),
    ("imaging", ("x-ray", "raio", "radiografia", "ct", "tac", "mri", "ressonancia", "scan")),
    ("prescription", ("prescription", "receita")),
    ("appointment", ("appointment", "consulta", "marcacao")),
)


class StubProvider:
    """Answers as pure functions of the input, for tests and dry runs. An image is its text in UTF-8."""

    def classify(self, pages: list[bytes], context: str = "") -> dict:
        text = b"\n".join(pages).decode(errors="replace")
        found = re.search(r"(\d{4}-\d{2}-\d{2})", text)
        return {
            "is_exam": not re.search(r"\b(invoice|fatura)\b", text.lower()),
            "exam_name_raw": next((line.strip()[:60] for line in text.split("\n") if line.strip()), None),
            "exam_date": found[1] if found else None,
            "facility_name": None, "physician_name": None, "department": None,
        }

    def transcribe(self, image: bytes, variant: str, temperature: float, context: str = "") -> str:
        text = image.decode(errors="replace")
        if variant == VARIANTS[0] and text.startswith("REFUSE"):
            return "I cannot help with this document, sorry."
        return text.removeprefix("REFUSE").strip()

    def is_refusal(self, text: str) -> bool:
        return text.lower().startswith("i cannot")

    def vote(self, samples: list[str]) -> str:
        return alignment.merge(samples)[0]

    def score(self, merged: str, samples: list[str]) -> str:
        return json.dumps({"confidence": alignment.score(merged, samples)})

    def standardize(self, names: list[str]) -> str:
        def kind(name: str) -> str:
            words = set(re.findall(r"[a-z-]+", name.lower()))
            return next((k for k, some in KEYWORDS if words.intersection(some)), "other")

        guide = {" ".join(name.lower().split()): {"exam_type": k, "standardized_name": standard} for name, k, standard in EXAMPLES}
        return json.dumps({n: guide.get(" ".join(n.lower().split())) or {"exam_type": kind(n), "standardized_name": " ".join(n.split()).title()} for n in names})

    def summarize(self, system: str, prompt: str) -> str:
        return f"Summary {hashlib.sha256(prompt.encode()).hexdigest()[:16]}"


Factory = Callable[[], ModelProvider]


def classify_document(provider: ModelProvider, pages: list[bytes], context: str = "") -> dict:
    """The six fields; a call that fails, or an answer that is none, counts as an exam."""
    names = ("exam_name_raw", "exam_date", "facility_name", "physician_name", "department")
    try:
        found = provider.classify(pages, context)
        return {"is_exam": bool(found["is_exam"])} | {n: found.get(n) for n in names}
    except Exception:  # noqa: BLE001  by contract: in doubt it is an exam
        return {"is_exam": True} | dict.fromkeys(names)


def valid(provider: ModelProvider, text: str) -> tuple[bool, str]:
    """Whether a text is a transcription: long enough, and no refusal. A check that fails passes."""
    if len(text.strip()) < 20:
        return False, "empty"
    try:
        return (False, "refusal") if provider.is_refusal(text) else (True, "")
    except Exception:  # noqa: BLE001  by contract
        return True, ""


def transcribe_with_retry(provider: ModelProvider, image: bytes, temperature: float = 0.1, retries: int = 3, context: str = "") -> tuple[str, str, int]:
    """Text, variant and attempts: variants in turn until one is valid, else the last text and its variant; "" if all raise."""
    text, used, attempts = "", VARIANTS[0], 0
    for variant in VARIANTS[: retries + 1]:
        attempts += 1
        try:
            text, used = provider.transcribe(image, variant, temperature, context) or "", variant
        except Exception:  # noqa: BLE001  the next variant is tried
            continue
        if valid(provider, text)[0]:
            break
    return text, used, attempts


def confidence_of(provider: ModelProvider, merged: str, samples: list[str]) -> float:
    """1 for equal samples, else the model's number in 0..1, and 0.5 for no number."""
    if len(set(samples)) == 1:
        return 1.0
    try:
        value = float(json.loads(strip_fences_text(provider.score(merged, samples)))["confidence"])
        return 1.0 if math.isnan(value) else max(0.0, min(1.0, value))
    except Exception:  # noqa: BLE001  by contract
        return 0.5


FENCED = re.compile(r"```[^\n]*(?:\n(?P<body>.*?))??(?:\n[^\S\n]*```[^\S\n]*)?\Z", re.S)


def strip_fences_text(text: str) -> str:
    """``functions.text.strip_fences`` on the Python side; the tests hold one against the other."""
    found = FENCED.match(text)
    return (found["body"] or "").strip() if found else text


def once(factory: Factory) -> Factory:
    """The factory, asked once for each copy that a task unpacks."""
    held: list[ModelProvider] = []

    def get() -> ModelProvider:
        if not held:
            held.append(factory())
        return held[0]

    return get


def sliding(workers: int, call: Callable, items: Iterable) -> Iterator:
    """The calls' answers in order, so many at a time; twice as many are taken ahead, so that one slow call holds up no others."""
    if workers <= 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(workers) as pool:
        ahead: deque = deque()
        for item in items:
            ahead.append(pool.submit(call, item))
            if len(ahead) >= 2 * workers:
                yield ahead.popleft().result()
        while ahead:
            yield ahead.popleft().result()


def framed(rows: Iterable[tuple], columns: list[str], size: int = 64) -> Iterator[pd.DataFrame]:
    """Rows as frames, so many at a time."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=columns)


def classify(pages: DataFrame, factory: Factory, context: str = "", most: int = 64) -> DataFrame:
    """One row per document of (doc_stem, page_number, image), from all its pages in order.

    A call sees up to ``most`` consecutive pages, and so does a task: the images of a long document never meet. Such a document
    is an exam if any of its parts is, and has every field from the first part that tells it.
    """

    provider = once(factory)
    fields = schemas.struct(schemas.CLASSIFICATION).fieldNames()[2:]

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        images = [bytes(x) for x in group.sort_values("page_number")["image"]]
        return pd.DataFrame([{"doc_stem": key[0], "part": key[1]} | classify_document(provider(), images, context)])

    part = F.floor(F.col("page_number") / most).cast("int")
    parts = pages.select("doc_stem", "page_number", "image", part.alias("part")).groupBy("doc_stem", "part").applyInPandas(one, f"{schemas.CLASSIFICATION}, part int")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("part", c)))[c].alias(c)
    return parts.groupBy("doc_stem").agg(F.max("is_exam").alias("is_exam"), *map(first, fields))


def transcribe(pages: DataFrame, factory: Factory, retries: int = 3, context: str = "", workers: int = 1) -> DataFrame:
    """Single mode: text, variant and attempts of each page, with retries over prompt variants; ``workers`` pages at a time in a task."""

    names = schemas.struct(schemas.TRANSCRIPT).fieldNames()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()

        def one(row: tuple) -> tuple:
            text, variant, attempts = transcribe_with_retry(provider, bytes(row[2]), retries=retries, context=context)
            return row[0], row[1], text, None, variant, attempts

        rows = (row for b in batches for row in zip(b["doc_stem"], b["page_number"], b["image"], strict=True))
        for out in framed(sliding(workers, one, rows), names):
            yield out.astype({"transcription_confidence": "float64"})

    return pages.select("doc_stem", "page_number", "image").mapInPandas(work, schemas.TRANSCRIPT)


def sample(pages: DataFrame, factory: Factory, n: int, temperature: float = 0.5, context: str = "", workers: int = 1) -> DataFrame:
    """n samples of each page as rows (doc_stem, page_number, sample_idx, text), ``workers`` at a time in a task; a failing call fails its task."""

    names = schemas.struct(schemas.SAMPLE).fieldNames()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        rows = (row for b in batches for page in zip(b["doc_stem"], b["page_number"], b["image"], strict=True) for row in ((*page, k) for k in range(n)))
        yield from framed(sliding(workers, lambda r: (r[0], r[1], r[3], provider.transcribe(bytes(r[2]), VARIANTS[0], temperature, context) or ""), rows), names)

    return pages.select("doc_stem", "page_number", "image").mapInPandas(work, schemas.SAMPLE)


def self_consistent(samples: DataFrame, factory: Factory) -> DataFrame:
    """Transcripts from samples: equal ones at confidence 1 without a call; the rest voted on and scored by the provider.

    A vote that fails takes the sample with the lowest number. No refusal check and no retries.
    """
    keys = ["doc_stem", "page_number"]
    grouped = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "text"))).alias("s"))
    grouped = grouped.select(*keys, F.transform("s", lambda x: x["text"]).alias("texts"))
    same = F.size(F.array_distinct("texts")) == 1
    sure = grouped.where(same).select(*keys, F.get("texts", F.lit(0)).alias("transcription"), F.lit(1.0).alias("transcription_confidence"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for b in batches:
            rows = []
            for texts in b["texts"]:
                texts = list(texts)
                try:
                    merged = provider.vote(texts)
                except Exception:  # noqa: BLE001  by contract
                    merged = texts[0]
                rows.append((merged, confidence_of(provider, merged, texts)))
            out = b[keys].copy()
            out["transcription"], out["transcription_confidence"] = zip(*rows, strict=True) if rows else ((), ())
            yield out

    voted = grouped.where(~same).mapInPandas(work, "doc_stem string, page_number int, transcription string, transcription_confidence double")
    return sure.unionByName(voted).select("*", F.lit(VARIANTS[0]).alias("prompt_variant"), F.lit(1).alias("retry_attempts"))


def native_vote(samples: DataFrame) -> DataFrame:
    """The stub's vote without Python: the commonest sample and the share that agrees."""
    return vote_samples(samples, ["doc_stem", "page_number"])


def rejected(transcripts: DataFrame) -> DataFrame:
    """Transcripts that are too short to be checked by a model."""
    return transcripts.where(too_short(F.col("transcription")))


def standardize(names: DataFrame, factory: Factory, batch: int = 50) -> DataFrame:
    """(exam_name_raw, exam_type, standardized_name) for distinct names, asked in batches in order, a row of ``names_json`` each.

    A name that the answer lacks, or a whole answer that does not parse, gives no row: it stays uncached.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for b in batches:
            for part in map(json.loads, b["names"]):
                try:
                    found = json.loads(strip_fences_text(provider.standardize(part).strip()))
                except Exception:  # noqa: BLE001  nothing is cached
                    found = {}
                found = found if isinstance(found, dict) else {}
                rows = [(n, found[n].get("exam_type", "other"), found[n].get("standardized_name", n)) for n in part if isinstance(found.get(n), dict)]
                yield pd.DataFrame(rows, columns=["exam_name_raw", "exam_type", "standardized_name"])

    return names_json(names, batch).select("names").mapInPandas(work, "exam_name_raw string, exam_type string, standardized_name string")


Stage = Callable[[DataFrame, str], DataFrame]


def summarize(pages: DataFrame, factory: Factory, stage: Stage, max_input_tokens: int = 100_000, workers: int = 1) -> DataFrame:
    """(doc_stem, summary) of documents with content: chunks in order, each refining the summary so far.

    An empty answer ends with an empty summary; a call that fails ends with the summary so far. Round k calls for chunk k of
    every document that goes on, ``workers`` calls at a time in a task, and is written by ``stage``, which returns what is
    written under a name already: a lost task repeats its own calls, and a run that is taken up again those of its last round.
    """
    budget = chunk_budget(max_input_tokens, PROMPTS["summary_system"])
    full = with_content(pages)
    chunked = full.join(assign_chunks(full, budget).select("doc_stem", F.col("page_number").cast("int").alias("page_number"), "chunk_idx"), ["doc_stem", "page_number"])
    keys = ["doc_stem", "chunk_idx"]
    prompts = exam_lists(chunked, keys).join(transcriptions(chunked, keys), keys).join(chunked.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n")), keys)
    prompts = stage(prompts, "summary-chunks")
    tasks = pages.sparkSession.sparkContext.defaultParallelism

    def answer(provider: ModelProvider, chunk: int, row) -> tuple[str, str, bool]:
        prompt = fill("summary_next" if chunk else "summary_first", n=row.n, exam_list=row.exam_list, transcriptions=row.transcriptions, summary=row.summary)
        try:
            found = (provider.summarize(PROMPTS["summary_system"], prompt) or "").strip()
        except Exception:  # noqa: BLE001  by contract
            return row.doc_stem, row.summary, True
        return row.doc_stem, found, not found

    def called(chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        make = once(factory)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (row for b in batches for row in b.itertuples())
            yield from framed(sliding(workers, lambda row: answer(make(), chunk, row), rows), ["doc_stem", "summary", "over"])

        return work

    rounds: list[DataFrame] = []
    for chunk in range((prompts.agg(F.max("chunk_idx")).first()[0] or 0) + 1):
        due = prompts.where(F.col("chunk_idx") == chunk)
        due = due.join(rounds[-1].where("not over").select("doc_stem", "summary"), "doc_stem") if rounds else due.withColumn("summary", F.lit(""))
        due = due.select("doc_stem", "n", "exam_list", "transcriptions", "summary").repartition(tasks)
        rounds.append(stage(due.mapInPandas(called(chunk), "doc_stem string, summary string, over boolean"), f"summary-{chunk}"))
    every = rounds[0].withColumn("chunk", F.lit(0))
    for k, more in enumerate(rounds[1:], 1):
        every = every.unionByName(more.withColumn("chunk", F.lit(k)))
    return every.groupBy("doc_stem").agg(F.max_by("summary", "chunk").alias("summary"))
