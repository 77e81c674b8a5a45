"""Shared plumbing of the training-data operators.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``,
which the driver and all executors see. A staged table cuts lineage: a lost
executor costs only the tasks of the stage it was running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to Python.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20
#: Staged tables that ``staging`` ends, the innermost last.
_OPEN: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, as a URI. A temporary one is used in local mode only, where it is unset.

    A path without a scheme is one of Hadoop's default store.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(base)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size in rows and bytes, so that a batch of whole texts fits a Python worker.

    A single longer text is a batch of its own. The setting is read when a plan runs, so that it stays for the session.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def staging() -> Iterator[None]:
    """Drops the tables that operators stage inside it: for callers that have written the result."""
    _OPEN.append([])
    try:
        yield
    finally:
        for scratch in _OPEN.pop():
            scratch.close()
            atexit.unregister(scratch.close)


class Scratch:
    """Staged tables of one operator call.

    ``put`` writes a frame as Parquet below the shared folder and returns the frame
    that reads it; ``drop`` removes one early. What is left goes with ``staging``, else when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folioflow/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)
        if _OPEN:
            _OPEN[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def close(self) -> None:
        """Best effort at the end of the driver; by then the JVM may be gone."""
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001
            pass


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neighbours(scratch: Scratch, rows: DataFrame, order: list[str], carry: str, within: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``carry`` of the rows before and after in the order of the columns ``order``, where ``within`` is equal.

    Of the columns ``order`` the result has those of ``keep`` only.

    Rows are sorted by range over all tasks, so that a hot value of ``within`` is no group. What meets at the edges of
    tasks is a row per task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    rows = scratch.put(rows.drop(*(c for c in order if c not in keep)), "sorted")
    w = Window.partitionBy("task").orderBy("place")
    mine = F.struct(within, carry)
    both = rows.withColumns({"prev": F.lag(mine).over(w), "next": F.lead(mine).over(w)})
    # The first and last row of a task look into the tasks before and after it that have rows: two rows a task meet in a join.
    tasks = sorted(r["task"] for r in rows.select("task").distinct().collect())
    if len(tasks) > 1:
        spark = rows.sparkSession
        steps = spark.createDataFrame(list(zip(tasks, tasks[1:], strict=False)), "task int, following int")
        last = both.where("next is null").select("task", mine.alias("other")).join(steps, "task").select(F.col("following").alias("task"), F.col("other").alias("before"))
        first = both.where("prev is null").select(F.col("task").alias("following"), mine.alias("other")).join(steps, "following").select("task", F.col("other").alias("behind"))
        ends = both.where("prev is null or next is null").join(last, "task", "left").join(first, "task", "left")
        ends = ends.withColumns({"prev": F.coalesce("prev", "before"), "next": F.coalesce("next", "behind")}).select(*both.columns)
        both = both.where("prev is not null and next is not null").unionByName(ends)
    near = {side: F.when(F.col(f"{side}.{within}") == F.col(within), F.col(f"{side}.{carry}")) for side in ("prev", "next")}
    return both.withColumns(near).drop("task")
