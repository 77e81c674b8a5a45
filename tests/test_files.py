"""Listing and committed writes: what is listed where, what a failure leaves, what a repeat adds."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from folioflow.sinks import committed
from folioflow.sinks import files as sinks
from folioflow.sources import cache, files, listing
from folioflow.streaming import incremental


@pytest.fixture
def store(tmp_path):
    for k in range(12):
        folder = tmp_path / f"doc {k}" / "deep:er"
        folder.mkdir(parents=True)
        (folder.parent / f"doc {k}.001.md").write_text("x" * k)
        (folder.parent / ".hidden").write_bytes(b"")
        (folder / f"é{k}.pdf").write_text("yy")
    (tmp_path / "top.pdf").write_text("zzz")
    (tmp_path / listing.STAGING / "job" / "doc 1").mkdir(parents=True)
    (tmp_path / listing.STAGING / "job" / "doc 1" / "doc 1.002.md").write_text("not yet")
    return tmp_path


def plain(top):
    found = []
    for folder, _, names in os.walk(top):
        found += [(f"file:{folder}/{n}", n, os.path.basename(folder), os.path.getsize(f"{folder}/{n}")) for n in names if listing.STAGING not in folder]
    return sorted(found)


def test_listing_finds_all(spark, store):
    want = plain(store)
    for tasks in (1, 5, 256):
        got = listing.listing(spark, str(store), tasks)
        assert sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() == 1 + min(tasks, 12)
    assert listing.listing(spark, f"{store}/none").collect() == []
    assert listing.listing(spark, f"file://{store}/doc 3/").count() == 3


def test_conditions_reach_the_listing_tasks(spark, store):
    got = listing.listing(spark, str(store)).where(F.col("file_name").endswith(".pdf") & F.col("folder").startswith("deep") & F.col("file_name").isin("é3.pdf", "é4.pdf", "top.pdf"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan folioflow_listing" in plan and "EndsWith" not in plan and "StartsWith" not in plan and " IN " not in plan
    assert {r["file_name"] for r in got.collect()} == {"é3.pdf", "é4.pdf"}
    reader = listing.ListingReader(f"file:{store}", 4)
    left = list(reader.pushFilters([listing.StringEndsWith(("file_name",), ".pdf"), listing.EqualTo(("size",), 2), listing.StringContains(("folder",), "deep")]))
    assert [f.attribute for f in left] == [("size",)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 12


def test_many_files_pass_by_the_driver(spark, tmp_path, monkeypatch):
    """100,000 files; the driver lists one folder and asks the JVM once."""
    for k in range(100):
        os.mkdir(tmp_path / f"d{k}")
        for j in range(1000):
            os.close(os.open(tmp_path / f"d{k}" / f"{j}.jpg", os.O_CREAT))
    calls, send = [], spark._jvm._gateway_client.send_command
    found = listing.listing(spark, str(tmp_path))
    monkeypatch.setattr(spark._jvm._gateway_client, "send_command", lambda *a, **b: calls.append(1) or send(*a, **b))
    assert found.groupBy("folder").count().where("count = 1000").count() == 100
    assert len(calls) < 200


def written(top):
    return {n: open(f, "rb").read() for f, n, *_ in ((x[0].removeprefix("file:"), *x[1:]) for x in plain(top))}


def rows(spark, n, per=4):
    return spark.range(n, numPartitions=3).select((F.col("id") / per).cast("int").cast("string").alias("doc_stem"), F.format_string("f%03d.md", "id").alias("file_name"), F.concat(F.lit("text é "), F.col("id")).alias("content"))


def test_write_appears_whole(spark, tmp_path):
    assert committed.write(rows(spark, 40), str(tmp_path)) == 40
    assert written(tmp_path) == {f"f{k:03d}.md": f"text é {k}".encode() for k in range(40)}
    again = rows(spark, 6).withColumn("content", F.when(F.col("file_name") < "f004", F.lit("new").cast("binary")))
    assert committed.write(again, f"file://{tmp_path}") == 6
    assert written(tmp_path)["f001.md"] == b"new" and written(tmp_path)["f004.md"] == b"" and written(tmp_path)["f007.md"] == "text é 7".encode()
    assert os.listdir(tmp_path / listing.STAGING) == []
    assert committed.write(rows(spark, 0), str(tmp_path)) == 0


def test_failing_task_leaves_nothing(spark, tmp_path):
    """The last task dies after half its files; the others have written theirs."""
    bad = rows(spark, 40).withColumn("content", F.when(F.col("file_name") == "f037.md", F.raise_error(F.lit("dies")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="dies"):
        committed.write(bad, str(tmp_path))
    assert written(tmp_path) == {} and not any(f for _, _, f in os.walk(tmp_path))


def test_repeated_attempts_count_once(spark, tmp_path):
    """Attempts that the commit does not name stay where no one looks, whatever they have written."""
    import pyarrow as pa

    staging = f"file:{tmp_path}/{listing.STAGING}/job"
    store, base = listing.store_of(staging)
    batch = pa.RecordBatch.from_pydict({"doc_stem": ["a", "a"], "file_name": ["1", "2"], "content": [b"x", b"y"]})

    class Context:
        @staticmethod
        def get():
            return Context()

        partitionId = taskAttemptId = staticmethod(lambda: 0)

    import pyspark

    pyspark.TaskContext, real = Context, pyspark.TaskContext
    try:
        writer = committed.FilesWriter(staging)
        writer.write(iter([batch.slice(0, 1)]))  # lost half-way
        whole = writer.write(iter([batch]))
    finally:
        pyspark.TaskContext = real
    assert committed.decided(staging) is None
    with pytest.raises(LookupError):
        committed.publish(spark, f"file:{tmp_path}", staging)
    writer.commit([None, whole])
    assert written(tmp_path) == {}
    assert committed.publish(spark, f"file:{tmp_path}", staging) == 2 and written(tmp_path) == {"1": b"x", "2": b"y"}


def test_lost_driver_is_made_good(spark, tmp_path, monkeypatch):
    """The driver ends between the commit and the last move: the next run moves the rest."""
    monkeypatch.setattr(committed, "publish", lambda *_: 0)
    committed.write(rows(spark, 8), str(tmp_path))
    monkeypatch.undo()
    job = os.listdir(tmp_path / listing.STAGING)[0]
    attempt, _ = committed.decided(f"file:{tmp_path}/{listing.STAGING}/{job}")[0]
    stem = os.listdir(tmp_path / listing.STAGING / job / attempt)[0]
    os.makedirs(tmp_path / stem)
    one = os.listdir(tmp_path / listing.STAGING / job / attempt / stem)[0]
    os.rename(tmp_path / listing.STAGING / job / attempt / stem / one, tmp_path / stem / one)  # moved already
    os.makedirs(tmp_path / listing.STAGING / uuid.uuid4().hex / "0" / "x")  # of a write that still runs
    assert committed.recover(spark, str(tmp_path)) == 1 and len(written(tmp_path)) == 8
    assert committed.recover(spark, str(tmp_path)) == 0 and len(os.listdir(tmp_path / listing.STAGING)) == 1
    assert committed.recover(spark, str(tmp_path), hours=-1) == 0 and os.listdir(tmp_path / listing.STAGING) == []


def test_contents_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.pdf").write_bytes(b"x" * 100 * k)
    monkeypatch.setattr(files, "TASK_BYTES", 500)
    found = files.contents(files.manifest(spark, str(tmp_path)))
    assert found.rdd.getNumPartitions() == 3 and found.columns == ["path", "file_name", "doc_stem", "content"]
    assert {r["doc_stem"]: len(r["content"] or b"") for r in found.collect()} == {str(k): 100 * k for k in range(6)}


def test_stale_images_by_listing(spark, tmp_path):
    pages = spark.createDataFrame([("d", k, b"img") for k in range(1, 6)], "doc_stem string, page_number int, image binary")
    sinks.write_files(sinks.image_files(pages), str(tmp_path))
    assert sinks.remove_stale_images(files.output_files(spark, str(tmp_path)), pages.where("page_number < 3")) == 3
    assert sorted(written(tmp_path)) == ["d.001.jpg", "d.002.jpg"]


def test_cache_versions(spark, tmp_path):
    make = lambda *names: spark.createDataFrame([(n, "other", n.upper()) for n in names], "cache_key string, exam_type string, standardized_name string")
    folder = f"{tmp_path}/names"
    assert cache.read(spark, folder).count() == 0
    for k in range(4):
        cache.write(cache.read(spark, folder).unionByName(make(f"n{k}")), folder)
    assert {r["cache_key"] for r in cache.read(spark, folder).collect()} == {"n0", "n1", "n2", "n3"} and len(os.listdir(folder)) == 2
    half = f"{folder}/v{10**19:020d}"  # a run that was lost while it wrote
    make("lost").write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert cache.read(spark, folder).count() == 4


def test_batch_that_runs_again_leaves_no_double(spark, tmp_path):
    """The end of a batch is not noted after its rows are written; the stream takes it again."""
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    frame = lambda a, b: spark.range(a, b).withColumnRenamed("id", "key")
    frame(0, 10).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("key long").parquet(str(source))
    assert incremental.run_once_each(stream(), "key", checkpoint, out) == 1
    frame(5, 20).write.mode("append").parquet(str(source))
    wrote = []

    def dies(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        wrote.append(number)
        raise RuntimeError("lost")

    query = stream().writeStream.foreachBatch(dies).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert spark.read.parquet(out).count() == 25 and len(wrote) == 1
    assert incremental.run_once_each(stream(), "key", checkpoint, out, lambda: frame(18, 19)) == 1
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == [*range(18), 19]
    assert incremental.run_once_each(stream(), "key", checkpoint, out) == 0
