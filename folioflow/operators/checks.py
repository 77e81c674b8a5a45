"""Reconciliation: what was written against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.schemas import CATEGORIES, REQUIRED_KEYS


def reconcile(manifest: DataFrame, images: DataFrame, pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc_stem, issue, detail) for documents of the manifest: missing folder, missing images, count mismatch, missing summary.

    ``images`` and ``pages`` have a row per file, ``summaries`` per document; each is counted where it is before it moves.
    """
    n = lambda df, name: df.groupBy("doc_stem").agg(F.count(F.lit(1)).alias(name))
    both = manifest.select("doc_stem").join(n(images, "images"), "doc_stem", "left").join(n(pages, "pages"), "doc_stem", "left").join(n(summaries, "summaries"), "doc_stem", "left")
    none = F.col("images").isNull() & F.col("pages").isNull() & F.col("summaries").isNull()
    i, p = F.coalesce("images", F.lit(0)), F.coalesce("pages", F.lit(0))
    issue = lambda when, name, detail="": F.when(when, F.struct(F.lit(name).alias("issue"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))
    counts = F.concat(i.cast("string"), F.lit(" images, "), p.cast("string"), F.lit(" transcriptions"))
    found = F.array_compact(
        F.array(
            issue(none, "missing_folder"),
            issue(~none & (i == 0), "missing_images"),
            issue((i > 0) & (i != p), "count_mismatch", counts),
            issue(~none & F.col("summaries").isNull(), "missing_summary"),
        )
    )
    return both.select("doc_stem", F.explode(found).alias("f")).select("doc_stem", "f.issue", "f.detail")


def incomplete(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_stem, images, pages) of documents whose images are not all transcribed: these are not summarised again."""
    counted = images.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("images")).join(pages.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("pages")), "doc_stem", "left")
    return counted.withColumn("pages", F.coalesce("pages", F.lit(0))).where("images <> pages")


def whole(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of documents that have one for each image."""
    return pages.join(incomplete(images, pages).select("doc_stem"), "doc_stem", "left_anti")


def missing_keys(present: Column) -> Column:
    """Required keys that an array of keys lacks."""
    return F.array_sort(F.array_except(F.array(*(F.lit(k) for k in REQUIRED_KEYS)), present))


def frontmatter_issues(files: DataFrame) -> DataFrame:
    """(file_name, issue, missing) for files with a parsed ``header``: no frontmatter, or required fields that it lacks."""
    header = F.col("header")
    have = F.array_compact(F.array(*(F.when(header[k].isNotNull(), F.lit(k)) for k in REQUIRED_KEYS)))
    none = F.coalesce(F.col("header_text"), F.lit("")) == ""
    lacking = missing_keys(have)
    rows = files.select("file_name", F.when(none, "missing_frontmatter").otherwise("missing_fields").alias("issue"), F.when(none, F.array().cast("array<string>")).otherwise(lacking).alias("missing"))
    return rows.where((F.col("issue") == "missing_frontmatter") | (F.size("missing") > 0))


def odd_categories(files: DataFrame) -> DataFrame:
    """(file_name, category) outside the known ones; a warning, values stay."""
    return files.where(F.col("header.category").isNotNull() & ~F.col("header.category").isin(*CATEGORIES)).select("file_name", F.col("header.category").alias("category"))


def roll_up(status: DataFrame) -> DataFrame:
    """(status, documents, pages) over (doc_stem, status, pages)."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
