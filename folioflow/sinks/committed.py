"""Files as a data sink with a commit: the files of a write appear when all of them are written, or not at all.

Tasks write below a staging folder, each attempt in a folder of its own. When all have
ended, the commit names the attempts that count in a manifest; from then on the write
is decided, and publishing moves the files to their places. Publishing is a job over the
manifest, may be repeated at any time, and is taken up again by ``recover`` if its driver
is lost. A write that fails leaves nothing.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioflow.sources.listing import STAGING, qualified, store_of

MANIFEST = "manifest.json"


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task's attempt, and how many files it holds."""

    folder: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        context = TaskContext.get()
        own = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        store, base = store_of(f"{self.staging}/{own}")
        n, made = 0, set()
        for b in iterator:
            for stem, name, content in zip(b.column("doc_stem").to_pylist(), b.column("file_name").to_pylist(), b.column("content"), strict=True):
                if stem not in made:
                    store.create_dir(f"{base}/{stem}", recursive=True)
                    made.add(stem)
                with store.open_output_stream(f"{base}/{stem}/{name}", compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                n += 1
        return Attempt(own, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = store_of(self.staging)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/.{MANIFEST}", compression=None) as out:
            out.write(json.dumps([[m.folder, m.files] for m in messages if m and m.files]).encode())
        store.move(f"{base}/.{MANIFEST}", f"{base}/{MANIFEST}")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = store_of(self.staging)
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(base)


class Files(DataSource):
    """``df.write.format("folioflow_files").option("path", staging)`` of (doc_stem, file_name, content)."""

    @classmethod
    def name(cls) -> str:
        return "folioflow_files"

    def schema(self) -> str:
        return "doc_stem string, file_name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def decided(staging: str) -> list[tuple[str, int]] | None:
    """(attempt, files) of a committed write, None of one that is not."""
    store, base = store_of(staging)
    with contextlib.suppress(FileNotFoundError), store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as file:
        return [tuple(x) for x in json.loads(file.read())]
    return None


def publish(spark: SparkSession, folder: str, staging: str) -> int:
    """Move the files of a committed write to ``folder``/doc_stem, in tasks; the number that the write has. What is moved already stays."""
    attempts = decided(staging)
    if attempts is None:
        raise LookupError(f"no committed write in {staging}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = store_of(staging)
        _, top = store_of(folder)
        for b in batches:
            for attempt in b.column(0).to_pylist():
                made = set()
                for x in store.get_file_info(fs.FileSelector(f"{base}/{attempt}", recursive=True, allow_not_found=True)):
                    if x.type != fs.FileType.File:
                        continue
                    stem, name = x.path.rsplit("/", 2)[1:]
                    if stem not in made:
                        store.create_dir(f"{top}/{stem}", recursive=True)
                        made.add(stem)
                    place = f"{top}/{stem}/{name}"
                    try:
                        store.move(x.path, place)
                    except OSError:  # a store that moves onto nothing
                        if store.get_file_info(x.path).type == fs.FileType.NotFound:
                            continue  # another attempt of this task has moved it
                        store.delete_file(place)
                        store.move(x.path, place)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["attempt"])

    if attempts:
        rows = spark.createDataFrame([(a,) for a, _ in attempts], "attempt string").repartition(len(attempts))
        rows.mapInArrow(work, "attempt string").write.format("noop").mode("overwrite").save()
    store, base = store_of(staging)
    store.delete_dir(base)
    return sum(n for _, n in attempts)


def write(files: DataFrame, folder: str) -> int:
    """Write (doc_stem, file_name, content) below ``folder``/doc_stem; the number of files. Content is text or bytes."""
    spark = files.sparkSession
    spark.dataSource.register(Files)
    folder = qualified(spark, folder).rstrip("/")
    staging = f"{folder}/{STAGING}/{uuid.uuid4().hex}"
    files.select("doc_stem", "file_name", F.col("content").cast("binary").alias("content")).write.format("folioflow_files").option("path", staging).mode("append").save()
    return publish(spark, folder, staging)


def recover(spark: SparkSession, folder: str, hours: float = 24) -> int:
    """Publish writes that were committed and not moved to the end; the number of writes. Uncommitted ones go after so many hours."""
    from pyarrow import fs

    folder = qualified(spark, folder).rstrip("/")
    store, base = store_of(f"{folder}/{STAGING}")
    found = 0
    for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        staging = f"{folder}/{STAGING}/{x.base_name}"
        if decided(staging) is not None:
            publish(spark, folder, staging)
            found += 1
        elif x.mtime is not None and time.time() - x.mtime.timestamp() > hours * 3600:
            store.delete_dir(x.path)
    return found
