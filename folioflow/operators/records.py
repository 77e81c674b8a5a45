"""Page records from pages, transcripts and document metadata; selections of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.dates import filename_date
from folioflow.functions.text import file_stem, present, without_pdf


def with_fallbacks(docs: DataFrame) -> DataFrame:
    """Classified documents with their name (else the stem) and date (else the file name's) filled in."""
    return docs.withColumns(
        {"exam_name_raw": F.coalesce(present(F.col("exam_name_raw")), "doc_stem"), "exam_date": F.coalesce(present(F.col("exam_date")), filename_date(F.col("doc_stem")))}
    )


def attach_metadata(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages with the fields of their document."""
    fields = ["exam_name_raw", "exam_date", "facility_name", "physician_name", "department"]
    return pages.join(docs.select("doc_stem", *fields), "doc_stem")


def gate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to transcribe, and those that are skipped."""
    return docs.where("is_exam"), docs.where("not is_exam")


def first_pages(pages: DataFrame) -> DataFrame:
    """The first record of each document."""
    return pages.groupBy("doc_stem").agg(F.min_by(F.struct(*[c for c in pages.columns if c != "doc_stem"]), "page_number").alias("r")).select("doc_stem", "r.*")


def unprocessed(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without any output."""
    return manifest.join(done.select("doc_stem").distinct(), "doc_stem", "left_anti")


def matching(docs: DataFrame, query: str, name_col: str = "file_name") -> DataFrame:
    """Documents whose file name or stem equals the query, whatever its case, with or without ``.pdf``."""
    name = F.lower(F.col(name_col))
    return docs.where((name == query.lower()) | (F.lower(file_stem(F.col(name_col))) == without_pdf(F.lit(query))))


def select_one(docs: DataFrame, query: str, name_col: str = "file_name") -> DataFrame:
    """``matching``, where it is exactly one; else an error."""
    found = matching(docs, query, name_col)
    n = len(found.limit(2).collect())
    if n != 1:
        raise LookupError(f"{'no document' if n == 0 else 'more than one document'} matches {query!r}")
    return found


def replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pages with new ones in the places that have some."""
    return stored.join(new.select("doc_stem", "page_number"), ["doc_stem", "page_number"], "left_anti").unionByName(new)
