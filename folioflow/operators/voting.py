"""Elections: one date per document, one text per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.dates import dates_in_text
from folioflow.functions.text import present


def page_date(text: Column, exclude: Column | None = None) -> Column:
    """The earliest date of a page, but for those in the array ``exclude``."""
    found = dates_in_text(text)
    return F.array_min(found if exclude is None else F.array_except(found, exclude))


def date_histogram(pages: DataFrame, date_col: str = "page_date") -> DataFrame:
    """doc_stem, date, n, first_page."""
    return pages.where(F.col(date_col).isNotNull()).groupBy("doc_stem", F.col(date_col).alias("date")).agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first_page"))


def elect_date(pages: DataFrame, birth_dates: DataFrame | None = None, filename_dates: DataFrame | None = None) -> DataFrame:
    """doc_stem, document_date for every document of ``pages`` (doc_stem, page_number, transcription, exam_date).

    The commonest page date wins, of equals that of the first page; documents without any page date vote with exam_date,
    which no exclusion touches. A date in the file name wins over it if some page voted for it.
    Pages move once, reduced to a date each, and the vote itself is a sum in every task before they move.
    """
    exclude = None
    if birth_dates is not None:
        pages = pages.join(birth_dates.select("doc_stem", F.array("birth_date").alias("__exclude")), "doc_stem", "left")
        exclude = F.coalesce("__exclude", F.array().cast("array<string>"))
    votes = pages.select("doc_stem", "page_number", page_date(F.coalesce("transcription", F.lit("")), exclude).alias("seen"), present(F.col("exam_date")).alias("stated"))
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("seen"), F.col("seen").alias("date")), F.struct(F.lit(False).alias("seen"), F.col("stated").alias("date"))))
    votes = votes.select("doc_stem", "page_number", kinds.alias("v")).groupBy("doc_stem", "v.seen", "v.date").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first_page"))
    best = F.struct((-F.col("n")).alias("less"), F.col("first_page"), F.col("date"))
    of = lambda seen: F.col("date").isNotNull() & (F.col("seen") == seen)
    found = votes
    override = F.lit(None).cast("string")
    if filename_dates is not None:
        found = found.join(filename_dates.select("doc_stem", "filename_date"), "doc_stem", "left")
        override = F.col("filename_date")
    per_doc = found.groupBy("doc_stem").agg(
        F.min(F.when(of(True), best)).alias("seen"),
        F.min(F.when(of(False), best)).alias("stated"),
        F.max(F.when(of(True) & (F.col("date") == override), F.col("date"))).alias("seen_name"),
        F.max(F.when(of(False) & (F.col("date") == override), F.col("date"))).alias("stated_name"),
    )
    chosen = F.when(F.col("seen").isNotNull(), F.coalesce("seen_name", F.col("seen.date"))).otherwise(F.coalesce("stated_name", F.col("stated.date")))
    return per_doc.select("doc_stem", chosen.alias("document_date"))


def write_back(pages: DataFrame, elected: DataFrame) -> DataFrame:
    """The elected date on all pages of its document; pages of documents without one keep theirs."""
    return pages.join(elected, "doc_stem", "left").withColumn("exam_date", F.coalesce("document_date", "exam_date")).drop("document_date")


def unanimous(samples: Column) -> Column:
    return F.size(F.array_distinct(samples)) == 1


def vote_samples(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, n_samples, agreed: the commonest sample, of equals the one that came first."""
    counted = samples.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"), F.min("sample_idx").alias("first"))
    return counted.groupBy(*keys).agg(
        F.min(F.struct((-F.col("n")).alias("less"), "first", "text")).getField("text").alias("text"), F.sum("n").alias("n_samples"), (F.count(F.lit(1)) == 1).alias("agreed")
    )


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Rows numbered from 1 within keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
