"""A store's files as a data source: folders below the top are dealt to tasks, which list them.

The driver lists the top folder alone, and of that it keeps the folders. Conditions on the
file's name and folder are pushed down to the listing tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

#: Rows of a batch, and tasks of a listing, at most.
ROWS, TASKS = 10_000, 256
SCHEMA = "path string, file_name string, folder string, size long"
NAMES = ("file_name", "folder")
#: Folder of what is being written, below the top; it is never listed.
STAGING = ".folioflow-staging"


def store_of(path: str):
    """The file system of a listed path, and the path there."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":  # any other character may stand in a path
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    authority, _, below = rest.removeprefix("//").partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{below}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme is one of Hadoop's default store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


class Folders(InputPartition):
    """Folders to list with all below them; ``flat``: the files of the top folder alone."""

    def __init__(self, folders: list[str], flat: bool = False):
        self.folders, self.flat = folders, flat


def _condition(found: Filter) -> Callable[[str], bool] | None:
    """What a pushed filter asks of a text, if it can be asked here."""
    value = found.value
    if isinstance(found, EqualTo):
        return lambda x: x == value
    if isinstance(found, In):
        return lambda x: x in value
    if isinstance(found, StringStartsWith):
        return lambda x: x.startswith(value)
    if isinstance(found, StringEndsWith):
        return lambda x: x.endswith(value)
    if isinstance(found, StringContains):
        return lambda x: value in x
    return None


class ListingReader(DataSourceReader):
    def __init__(self, top: str, tasks: int):
        self.top, self.tasks = top.rstrip("/"), tasks
        self.conditions: list[tuple[str, Callable[[str], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kept = isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute in ((NAMES[0],), (NAMES[1],))
            if kept:
                self.conditions.append((f.attribute[0], _condition(f)))
            else:
                yield f

    def _here(self) -> tuple:
        store, base = store_of(self.top)
        # What stands before a path of the store in a qualified one.
        return store, base.rstrip("/") or "/", self.top[: len(self.top) - len(base.rstrip("/"))] if self.top.endswith(base.rstrip("/")) else ""

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base, _ = self._here()
        found = store.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True))
        folders = sorted(x.path for x in found if x.type == fs.FileType.Directory and x.base_name != STAGING)
        n = min(len(folders), self.tasks)
        return [Folders([base], flat=True), *(Folders(folders[k::n]) for k in range(n))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _, before = self._here()
        rows: list[tuple] = []
        todo = list(partition.folders)
        while todo:
            folder = todo.pop()
            for x in store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True)):
                if x.type == fs.FileType.Directory:
                    if not partition.flat:
                        todo.append(x.path)
                    continue
                row = {"file_name": x.base_name, "folder": folder.rstrip("/").rsplit("/", 1)[-1]}
                if not x.base_name.endswith(".crc") and all(asked(row[c]) for c, asked in self.conditions):
                    rows.append((f"{before}{x.path}", *row.values(), x.size))
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "file_name": pa.string(), "folder": pa.string(), "size": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class Listing(DataSource):
    """``spark.read.format("folioflow_listing").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "folioflow_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("tasks", TASKS)))


def listing(spark: SparkSession, folder: str, tasks: int = TASKS) -> DataFrame:
    """(path, file_name, folder, size) of all files below a folder, empty files and names that begin with _ or . included; none if it is missing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return spark.read.format("folioflow_listing").option("tasks", str(tasks)).load(qualified(spark, folder))
