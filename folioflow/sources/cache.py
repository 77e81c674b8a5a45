"""The table of standard names: versions of a Parquet table in a folder, and its JSON form for editing by hand."""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions.text import cache_entries
from folioflow.sources.listing import listing, store_of


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, exam_type, standardized_name) of a JSON cache; a missing or broken one is empty."""
    store, at = store_of(path)
    text = "{}"
    with contextlib.suppress(FileNotFoundError), store.open_input_stream(at, compression=None) as file:
        text = file.read().decode(errors="replace")
    one = spark.createDataFrame([(text,)], "value string").select(F.explode(cache_entries(F.col("value"))).alias("cache_key", "v"))
    return one.select("cache_key", "v.exam_type", "v.standardized_name")


def write_json(cache: DataFrame, path: str) -> None:
    """The cache as JSON with sorted keys; written beside and then moved."""
    rows = cache.orderBy("cache_key").collect()  # a table that people edit by hand
    text = json.dumps({r["cache_key"]: {"exam_type": r["exam_type"], "standardized_name": r["standardized_name"]} for r in rows}, indent=2, ensure_ascii=False, sort_keys=True)
    store, at = store_of(path)
    folder, slash, name = at.rpartition("/")
    if folder:
        store.create_dir(folder, recursive=True)
    beside = f"{folder}{slash}.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside, compression=None) as out:
        out.write(text.encode())
    store.move(beside, at)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions of the table, the oldest first."""
    whole = listing(spark, folder).where("file_name = '_SUCCESS' and folder like 'v%'").select("folder").collect()  # a few at the most
    return sorted(r["folder"] for r in whole)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version; an empty table if there is none."""
    found = versions(spark, folder)
    return spark.read.schema(schemas.NAME_CACHE).parquet(f"{folder}/{found[-1]}") if found else spark.createDataFrame([], schemas.NAME_CACHE)


def write(cache: DataFrame, folder: str) -> None:
    """A new version beside the others. The one before stays, for readers and for a run that is lost meanwhile; older ones go."""
    spark = cache.sparkSession
    cache.write.mode("errorifexists").parquet(f"{folder}/v{time.time_ns():020d}")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in versions(spark, folder)[:-2]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
