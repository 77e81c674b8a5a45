"""Exact dedup by a tree merge of sorted digest runs; DataFrame functions only.

Each input partition becomes a run: its documents reduced to digest rows and sorted by
digest. Runs are cut into segments by the first bytes of the digest, alike in all runs,
and the segments of all runs come together, in the order of digest and place in the
tree: one exchange and one sort. Then runs merge in rounds within each segment,
``fan_in`` neighbours into one (a binomial round of fan-in two, or several at once),
until a single run is left. Every round reads sorted rows and keeps their order, so
that none sorts or exchanges again.

A merge keeps one row per digest: the best document so far, the number of documents
behind it, and the extremes of a second fingerprint (an unrelated hash and the length
of the normalised text) that must agree: equal digests are verified at every level. A
digest that a third of all rows share has one row in each run, so that it grows with
the partitions and not with the documents, and the decision reaches the documents run
by run, never as one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table, text_or_empty

#: The characters that normalisation deletes: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a digest that make its segment.
SEGMENT = 3


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_points.

    * A null text counts as empty; empty texts form one group.
    * Of equal texts the one with the most code points stays, then the smallest id;
      a null id loses every tie.
    * Rows repeated with the same id belong to one group, each counts, and each
      carries ``kept`` true when its id is the one that stays.
    * Very long texts are hashed whole. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = text_or_empty(docs[text_col])
    bare = F.translate(text, BLANKS, "")
    runs = scratch.put(
        docs.select(
            docs[id_col].alias("id"),
            F.length(text).cast("long").alias("n_points"),
            F.unhex(F.sha2(bare, 256)).alias("digest"),
            F.struct(F.xxhash64(bare).alias("hash"), F.length(bare).alias("length")).alias("proof"),
        )
        .withColumn("run", F.spark_partition_id())
        .sortWithinPartitions("digest"),
        "runs",
    )
    best = F.struct((-F.col("n_points")).alias("minus_points"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    width = (runs.agg(F.max("run")).first()[0] or 0) + 1
    # Where a run stands in each round: its number without the last digits, to the base of the fan-in.
    rounds, left = ["run"], width
    while left > 1:
        left = -(-left // fan_in)
        rounds.append(f"run_{len(rounds)}")
    proofs = [F.min("low").alias("low"), F.max("high").alias("high")]
    same = F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    level = runs.groupBy("run", "digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"), F.min("proof").alias("low"), F.max("proof").alias("high"))
    level = level.withColumns({"n": same, "segment": F.substring("digest", 1, SEGMENT)} | {c: F.floor(F.col("run") / F.lit(fan_in**k)).cast("int") for k, c in enumerate(rounds) if k})
    order = ["segment", "digest", *reversed(rounds)]
    first = scratch.put(level, "first")
    level = first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment").sortWithinPartitions(*order)
    for k in range(1, len(rounds)):
        keys = order[: len(order) - k]  # the place of a run in this round and those after it
        level = level.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"), *proofs).withColumn("n", same)
    whole = level.select("segment", "digest", F.col("best.id").alias("keep_id"), "n")
    decided = scratch.put(first.select("segment", "digest", "run").join(whole.hint("merge"), ["segment", "digest"]).drop("segment"), "decided")
    return runs.join(decided.hint("merge"), ["run", "digest"]).select(
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("n_points"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_points")


ORACLE_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by n_points desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over (partition by text_sha256 order by n_points desc, doc_id) as kept,
       text_sha256
from d
"""
