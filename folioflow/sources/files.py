"""Files as tables: listed and read by tasks, of the listed paths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow import schemas
from folioflow.functions.text import file_stem, page_number
from folioflow.operators.frontmatter import from_frontmatter, parsed
from folioflow.sources.listing import listing, store_of
from folioflow.sources.pdf import page_images

#: Bytes of files that a task reads, on average.
TASK_BYTES = 64 << 20


def manifest(spark: SparkSession, folder: str, pattern: str = r".*\.pdf") -> DataFrame:
    """(path, file_name, doc_stem, size) of source documents in path order; the pattern is matched from the start of the file name.

    Two documents with one stem are an error: their pages would mix.
    """
    found = listing(spark, folder).where(F.col("file_name").endswith(".pdf") & F.col("file_name").rlike(f"^(?:{pattern})"))
    found = found.select("path", "file_name", file_stem(F.col("file_name")).alias("doc_stem"), "size")
    twice = found.groupBy("doc_stem").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several source documents are named {', '.join(r['doc_stem'] for r in twice)}")
    return found.orderBy("path")


def with_bytes(listed: DataFrame, column: str) -> DataFrame:
    """Rows with a path and the bytes of that file, null for an empty one. A task holds one file at a time; where sizes are known, tasks have about as many bytes each."""
    if "size" in listed.columns:
        listed = listed.repartition(max(1, -(-(listed.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES)))
    at = listed.columns.index("path")
    schema = T.StructType([*listed.schema.fields, T.StructField(column, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                store, path = store_of(b.column(at)[k].as_py())
                with store.open_input_stream(path, compression=None) as file:
                    content = file.read() or None
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([content], pa.binary())], names=schema.names)

    return listed.mapInArrow(work, schema)


def contents(docs: DataFrame) -> DataFrame:
    """Documents with their bytes, null for an empty file."""
    return with_bytes(docs, "content").drop("size")


def text_pages(content: bytes) -> list[bytes]:
    """Pages of a text document, parted by form feeds. Bytes that are no text cannot be rendered."""
    return [p.encode() for p in content.decode("utf-8").split("\f")]


def document_pages(content: bytes) -> list[bytes]:
    """Page images of a document: the JPEGs of a PDF, else the pages of a text."""
    return page_images(content) if b"%PDF-" in content[:1024] else text_pages(content)


def render(docs: DataFrame, renderer: Callable[[bytes], list[bytes]] = document_pages) -> DataFrame:
    """(doc_stem, page_number, image) from documents with content. One that cannot be rendered gives no row and counts as failed."""

    class Pages:
        def eval(self, content: bytes) -> Iterator[tuple[int, bytes]]:
            try:
                pages = renderer(bytes(content)) if content is not None else []
            except Exception:  # noqa: BLE001  the document is reported as failed
                pages = []
            yield from enumerate(pages, 1)

    pages = F.udtf(Pages, returnType="page_number int, image binary")
    return docs.select("doc_stem", "content").lateralJoin(pages(F.col("content").outer())).select("doc_stem", "page_number", "image")


def preprocess(image: bytes) -> bytes:
    """Grey, at most 1000 pixels long, contrast doubled, JPEG at quality 80; bytes that are no image stay, as they do without an imaging library."""
    try:
        import io

        from PIL import Image, ImageEnhance

        grey = Image.open(io.BytesIO(image)).convert("L")
        ratio = min(1.0, 1000 / max(grey.size))
        grey = grey.resize((int(grey.width * ratio), int(grey.height * ratio)), Image.Resampling.LANCZOS) if ratio < 1 else grey
        out = io.BytesIO()
        ImageEnhance.Contrast(grey).enhance(2.0).save(out, "JPEG", quality=80)
        return out.getvalue()
    except (ImportError, OSError):
        return image


def preprocessed(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def work(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: preprocess(bytes(x)))

    return pages.withColumn("image", work("image"))


def output_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, doc_stem, kind, page_number) of what was written: image, page, summary or source, without logs."""
    found = listing(spark, folder).withColumnRenamed("folder", "doc_stem").where("doc_stem <> 'logs'")
    name, own = F.col("file_name"), F.col("file_name").startswith(F.concat("doc_stem", F.lit(".")))
    kind = F.when(own & name.endswith(".summary.md"), "summary").when(own & name.endswith(".md"), "page").when(own & name.endswith(".jpg"), "image").when(name.endswith(".pdf"), "source")
    return found.select("path", "file_name", "doc_stem", "size", kind.alias("kind"), F.when(kind.isin("page", "image"), page_number(name)).alias("page_number")).where("kind is not null")


def read_markdown(files: DataFrame) -> DataFrame:
    """Listed page or summary files with header, header_text and body."""
    return parsed(with_bytes(files, "content").withColumn("content", F.coalesce(F.decode("content", "utf-8"), F.lit(""))))


def stored_images(files: DataFrame) -> DataFrame:
    """(doc_stem, page_number, image) of listed images that were written before, numbered as their names say."""
    return with_bytes(files, "image").select("doc_stem", "page_number", "image")


def stored_records(files: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Page records read back from page files, without files whose number does not parse; a source that the header lacks comes from ``sources`` by stem, first path first."""
    pages = read_markdown(files.where("kind = 'page' and page_number is not null"))
    if sources is not None:
        first = sources.groupBy("doc_stem").agg(F.min_by("file_name", "path").alias("__source"))
        pages = pages.join(first, "doc_stem", "left")
    else:
        pages = pages.withColumn("__source", F.lit(None).cast("string"))
    columns = from_frontmatter(F.col("header"), F.col("body"), F.col("page_number"), F.col("__source"))
    read = pages.select("doc_stem", *columns)
    return read.withColumns({"prompt_variant": F.lit(None).cast("string"), "retry_attempts": F.lit(None).cast("int")}).select(*schemas.struct(schemas.RECORD).fieldNames())
