"""What is written: page files, summaries, images, source copies; and what is deleted."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import page_file
from folioflow.operators.frontmatter import markdown, to_frontmatter
from folioflow.operators.records import first_pages
from folioflow.sinks.committed import recover, write as write_files  # noqa: F401
from folioflow.sources.listing import store_of


def page_files(records: DataFrame) -> DataFrame:
    """(doc_stem, file_name, content) of page records: the header of a page's first record, the texts of all."""
    texts = F.array(F.coalesce("transcription", F.lit("")))
    return records.select("doc_stem", page_file(F.col("doc_stem"), F.col("page_number")).alias("file_name"), markdown(to_frontmatter(), texts).alias("content"))


def summary_files(summaries: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_stem, file_name, content) of non-empty summaries, headed by the first page without extras."""
    headed = summaries.where("summary <> ''").join(first_pages(records), "doc_stem")
    return headed.select("doc_stem", F.concat("doc_stem", F.lit(".summary.md")).alias("file_name"), markdown(to_frontmatter(extras=False), F.array("summary")).alias("content"))


def image_files(pages: DataFrame) -> DataFrame:
    return pages.select("doc_stem", page_file(F.col("doc_stem"), F.col("page_number"), "jpg").alias("file_name"), F.col("image").alias("content"))


def source_files(docs: DataFrame, present: DataFrame) -> DataFrame:
    """Copies of the source documents that are not there yet."""
    return docs.join(present.where("kind = 'source'").select("doc_stem").distinct(), "doc_stem", "left_anti").where("content is not null").select("doc_stem", "file_name", "content")


def remove(files: DataFrame) -> int:
    """Delete listed files, in tasks; the number of files. One that is gone already counts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            for listed in b["path"]:
                store, path = store_of(listed)
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(path)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("path").mapInPandas(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def remove_stale_images(files: DataFrame, pages: DataFrame) -> int:
    """Images of rendered documents beyond their pages, once the new ones are written."""
    images = files.where("kind = 'image'").join(pages.select("doc_stem").distinct(), "doc_stem", "left_semi")
    return remove(images.join(pages.select("doc_stem", "page_number"), ["doc_stem", "page_number"], "left_anti"))
