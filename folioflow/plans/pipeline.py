"""The document pipeline: new documents, summaries again, one document or page again.

Every stage that calls a model or renders is written to a work folder before it is
used, so that its calls happen once, and what follows reads tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions.dates import filename_date
from folioflow.operators import checks, naming, providers, records, voting
from folioflow.sinks import files as sinks
from folioflow.sources import cache, files


@dataclass
class Job:
    """Where a run reads and writes, and how it calls its model."""

    input_path: str
    output_path: str
    provider: providers.Factory = providers.StubProvider
    renderer: Callable[[bytes], list[bytes]] = files.document_pages
    pattern: str = r".*\.pdf"
    n_extractions: int = 1
    max_input_tokens: int = 100_000
    birth_date: str | None = None
    context: str = ""
    workers: int = 1  # calls in flight in a task
    cache_path: str | None = None
    work_path: str | None = None
    near_names: bool = False  # take a misspelled name for the known one that it is nearest to, without asking the model
    run: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    @property
    def cache(self) -> str:
        return self.cache_path or f"{self.output_path}/logs/name_cache"


@dataclass
class Report:
    """(status, documents, pages) and the issues of the outputs."""

    status: DataFrame
    issues: DataFrame
    documents: DataFrame


def uri(path: str) -> str:
    """A path without a scheme is one of Hadoop's default store."""
    context = SparkSession.active().sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", p.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(p).toString())


class Pipeline:
    def __init__(self, spark: SparkSession, job: Job):
        self.spark, self.job = spark, job

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.job.work_path or self.job.output_path + '/logs/work'}/{self.job.run}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def stage_once(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stage``, but what this run has written to its end under the name is taken instead."""
        where = f"{self.job.work_path or self.job.output_path + '/logs/work'}/{self.job.run}/{name}"
        if files.listing(self.spark, where).where("file_name = '_SUCCESS'").isEmpty():
            return self.stage(df, name)
        return self.spark.read.schema(df.schema).parquet(where)

    def outputs(self) -> DataFrame:
        return files.output_files(self.spark, self.job.output_path)

    def plan(self, reprocess_all: bool = False, document: str | None = None, outputs: DataFrame | None = None) -> DataFrame:
        """The documents to process."""
        found = files.manifest(self.spark, self.job.input_path, self.job.pattern)
        if document:
            return records.select_one(found, document)
        return found if reprocess_all else records.unprocessed(found, self.done(self.outputs() if outputs is None else outputs))

    def done(self, out: DataFrame) -> DataFrame:
        """Documents that need no run: with a page for each image, or found to be no exam before. Partial and failed ones are taken again."""
        images, pages = out.where("kind = 'image'"), out.where("kind = 'page'")
        whole = checks.whole(images, pages).select("doc_stem").distinct()
        if files.listing(self.spark, self.status_path).where("file_name like '%.parquet'").isEmpty():
            return whole
        return whole.unionByName(self.spark.read.schema(schemas.STATUS).parquet(self.status_path).where("status = 'skipped'").select("doc_stem"))

    @property
    def status_path(self) -> str:
        return f"{self.job.output_path}/logs/document_status"

    def dry_run(self, **which) -> DataFrame:
        """(doc_stem, pages): what a run would render; nothing is written and no model called."""
        docs = files.contents(self.plan(**which))
        pages = files.render(docs, self.job.renderer).groupBy("doc_stem").agg(F.count(F.lit(1)).cast("int").alias("pages"))
        return docs.select("doc_stem").join(pages, "doc_stem", "left").select("doc_stem", F.coalesce("pages", F.lit(0)).alias("pages"))

    def images(self, docs: DataFrame, again: bool, outputs: DataFrame) -> DataFrame:
        """Page images: those stored before, else rendered; all rendered with ``again``."""
        if again:
            return files.preprocessed(files.render(docs, self.job.renderer))
        stored = files.stored_images(outputs.where("kind = 'image'").join(docs.select("doc_stem"), "doc_stem", "left_semi"))
        new = docs.join(stored.select("doc_stem").distinct(), "doc_stem", "left_anti")
        return stored.unionByName(files.preprocessed(files.render(new, self.job.renderer)))

    def transcripts(self, pages: DataFrame) -> DataFrame:
        job = self.job
        if job.n_extractions > 1:
            samples = self.stage(providers.sample(pages, job.provider, job.n_extractions, context=job.context, workers=job.workers), "samples")
            return providers.self_consistent(samples, job.provider)
        return providers.transcribe(pages, job.provider, context=job.context, workers=job.workers)

    def standardized(self, pages: DataFrame) -> DataFrame:
        """Pages with standard names; only names that the cache lacks are asked for, and only answers are cached."""
        known = cache.read(self.spark, self.job.cache)
        asked = naming.uncached(pages, known)
        if self.job.near_names:
            near = self.stage(naming.nearest(asked, known.unionByName(naming.guide(self.spark))), "near-names")
            known = self.stage(naming.merge(known, near), "known-names")
            asked = naming.uncached(pages, known)
        if not asked.isEmpty():
            answers = self.stage(providers.standardize(asked, self.job.provider), "names")
            cache.write(naming.merge(known, answers), self.job.cache)
            known = cache.read(self.spark, self.job.cache)
        return naming.attach(pages, naming.look_up(pages, known))

    def process(self, reprocess_all: bool = False, document: str | None = None, page: int | None = None) -> Report:
        """Process new documents, all of them, one, or one page of one. A page takes its place among the stored ones before the summary."""
        if page is not None and not document:
            raise ValueError("a page needs a document")
        spark, job = self.spark, self.job
        sinks.recover(spark, job.output_path)
        before = self.stage(self.outputs(), "outputs")  # listed once; what the run itself writes it knows
        docs = self.stage(files.contents(self.plan(reprocess_all, document, before)), "documents")
        images = self.stage(self.images(docs, document is not None, before), "images")
        rendered = images.select("doc_stem").distinct()
        if page is None:
            classified = self.stage(providers.classify(images, job.provider, job.context), "classified")
        else:
            fields = schemas.struct(schemas.CLASSIFICATION).fields[2:]
            classified = rendered.select("doc_stem", F.lit(True).alias("is_exam"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        exams, skipped = records.gate(classified)
        exams = records.with_fallbacks(exams)
        kept = images.join(exams.select("doc_stem"), "doc_stem", "left_semi")
        sinks.write_files(sinks.image_files(kept), uri(job.output_path))
        sinks.write_files(sinks.source_files(docs.join(exams.select("doc_stem"), "doc_stem", "left_semi"), before), uri(job.output_path))
        if document is not None:
            sinks.remove_stale_images(before, kept)
        wanted = kept if page is None else kept.where(F.col("page_number") == page)
        texts = self.stage(self.transcripts(wanted), "transcripts")
        rows = records.attach_metadata(texts, exams).join(docs.select("doc_stem", F.col("file_name").alias("source_file")), "doc_stem")
        births = exams.select("doc_stem", F.lit(job.birth_date).alias("birth_date")) if job.birth_date else None
        names = exams.select("doc_stem", filename_date(F.col("doc_stem")).alias("filename_date"))
        rows = voting.write_back(rows, voting.elect_date(rows, births, names))
        rows = self.stage(self.standardized(rows).select(*schemas.struct(schemas.RECORD).fieldNames()), "records")
        sinks.write_files(sinks.page_files(rows), uri(job.output_path))
        full = rows
        if page is not None:
            stored = files.stored_records(before.join(exams.select("doc_stem"), "doc_stem", "left_semi"))
            full = self.stage(records.replaced(stored, rows), "merged")
        self.write_summaries(full)
        done = rows.groupBy("doc_stem").agg(F.count(F.lit(1)).cast("int").alias("pages"))
        status = docs.select("doc_stem").join(done, "doc_stem", "left").join(skipped.select("doc_stem", F.lit(True).alias("skipped")), "doc_stem", "left").join(rendered.select("doc_stem", F.lit(True).alias("rendered")), "doc_stem", "left")
        expected = wanted.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("expected"))
        status = status.join(expected, "doc_stem", "left")
        kind = F.when(F.col("skipped"), "skipped").when(F.col("rendered").isNull(), "failed").when(F.coalesce("pages", F.lit(0)) < F.col("expected"), "partial").otherwise("processed")
        status = self.stage(status.select("doc_stem", kind.alias("status"), F.coalesce("pages", F.lit(0)).alias("pages")), "status")
        status.write.mode("append").parquet(self.status_path)
        return Report(checks.roll_up(status), self.issues(docs.join(exams.select("doc_stem"), "doc_stem", "left_semi")), status)

    def write_summaries(self, rows: DataFrame) -> DataFrame:
        """Summaries of these records. An old one stays until a new one that is not empty takes its place."""
        found = self.stage(providers.summarize(rows, self.job.provider, self.stage_once, self.job.max_input_tokens, self.job.workers), "summaries")
        sinks.write_files(sinks.summary_files(found, rows), uri(self.job.output_path))
        return found

    def regenerate(self, document: str | None = None) -> DataFrame:
        """Summaries again from the page files, of all documents or of one: (doc_stem, pages). Incomplete documents are left as they are."""
        found = self.outputs()
        if document:
            query = document.lower().removesuffix(".pdf")
            found = found.where(F.lower("doc_stem").isin(query, document.lower()))
        images, pages = found.where("kind = 'image'"), found.where("kind = 'page'")
        whole = checks.whole(images, pages)
        sources = files.listing(self.spark, self.job.input_path).where(F.col("file_name").endswith(".pdf")).withColumn("doc_stem", F.regexp_replace("file_name", r"\.pdf$", ""))
        rows = self.stage(files.stored_records(whole, sources), "stored")
        self.write_summaries(rows)
        return rows.groupBy("doc_stem").agg(F.count(F.lit(1)).cast("int").alias("pages"))

    def issues(self, docs: DataFrame) -> DataFrame:
        found = self.outputs()
        return checks.reconcile(docs, found.where("kind = 'image'"), found.where("kind = 'page'"), found.where("kind = 'summary'"))

    def odd_categories(self) -> DataFrame:
        return checks.odd_categories(files.read_markdown(self.outputs().where("kind in ('page', 'summary')")))

    def frontmatter_issues(self) -> DataFrame:
        return checks.frontmatter_issues(files.read_markdown(self.outputs().where("kind in ('page', 'summary')")))
