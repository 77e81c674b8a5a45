"""Arriving documents: a file stream, read until nothing is left, and the anti-join on what has output.

The stream remembers paths; the anti-join runs in every batch, so that a document whose
output was deleted is taken again when it is asked for. A batch whose end was not noted
runs again with its number: ``run_once_each`` keeps its rows by that number and replaces
them, so that none is lost and none stands twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import file_stem
from folioflow.sources.listing import listing


def arrivals(spark: SparkSession, folder: str, pattern: str = r".*\.pdf") -> DataFrame:
    """(path, file_name, doc_stem, content) as a stream."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("file_name"), file_stem(name).alias("doc_stem"), "content").where(name.rlike(f"^(?:{pattern})"))


def run_stream(stream: DataFrame, key: str, checkpoint: str, done: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None]) -> int:
    """Handle all rows of a stream that have arrived and whose ``key`` has no output; the number of batches that held any."""
    batches = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal batches
        new = batch.join(done().select(key).distinct(), key, "left_anti")
        if not new.isEmpty():
            batches += 1
            handle(new, number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches


def run_once_each(stream: DataFrame, key: str, checkpoint: str, folder: str, done: Callable[[], DataFrame] | None = None, make: Callable[[DataFrame], DataFrame] = lambda new: new) -> int:
    """Write ``make`` of all rows that have arrived, whose ``key`` is new, to ``folder``/batch=N; the number of batches that held any.

    New is what neither an earlier batch nor ``done`` has; a batch that runs again does not count as earlier than itself.
    """
    spark, batches = stream.sparkSession, 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal batches
        new = batch if done is None else batch.join(done().select(key).distinct(), key, "left_anti")
        if not listing(spark, folder).where("file_name = '_SUCCESS'").isEmpty():
            earlier = spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") < number)
            new = new.join(earlier.select(key).distinct(), key, "left_anti")
        made = make(new)
        made.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batches += not spark.read.schema(made.schema).parquet(f"{folder}/batch={number}").isEmpty()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches


def run_available(spark: SparkSession, folder: str, checkpoint: str, done: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], pattern: str = r".*\.pdf") -> int:
    """Handle all documents that have arrived and have no output; the number of batches that held any."""
    return run_stream(arrivals(spark, folder, pattern), "doc_stem", checkpoint, done, handle)
