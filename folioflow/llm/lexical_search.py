"""Ranked lexical search by Fagin's threshold algorithm.

The texts are read once into a forward index: of each document its length and the counts
of the terms that the queries of a block hold. Weights need the whole corpus, so they
follow from counts over that index. Each task then takes its documents in shards of
bounded size, builds the impact-sorted list of every term of the shard, and answers every
query by the threshold algorithm: all lists of a query are read in turn, some entries a
round; a document that is met for the first time is scored in full by look-ups in the
forward index; and the query ends when the impacts where its lists stand, summed, fall
strictly below the score of the k-th best document. That score is carried from shard to
shard of a task, so that later shards end early. A document whose score equals the k-th
may still win by its id, which is why the threshold has to be strictly below.

Every task gives at most k documents a query; these are merged in rounds of ``FAN`` tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import Scratch, bounded_batches, table, text_or_empty

#: Documents and postings of a shard at most (a document with more postings is a shard alone).
SHARD, POSTINGS = 8192, 2_000_000
#: Entries that the first round reads of each list; every round reads twice as many as the one before.
ROUND = 16
#: Tasks whose results meet in one group of a merge.
FAN = 64
#: Queries, and summed terms of theirs, that are answered in one pass over the texts (a query with more terms has its own).
QUERIES, TERMS = 2000, 200_000

#: Every ASCII byte that is no letter or digit parts terms; A-Z become a-z; other bytes stand for themselves.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Forward index and impact-sorted lists of some documents: postings (document, term, impact), sorted by document and term."""

    def __init__(self, ids: list, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, width: int):
        self.ids, self.width = ids, width
        self.keys, self.impacts = owner * width + terms, impacts
        order = np.lexsort((owner, -impacts, terms))
        self.listed, self.heights = owner[order], impacts[order]
        found, first = np.unique(terms[order], return_index=True)
        self.lists = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))

    def score(self, documents: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores by look-ups in the forward index."""
        wanted = documents[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impacts[at], 0).sum(axis=1)

    def search(self, terms: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        """``best`` (minus score, no id, id) with this shard's documents, at most k of them in order."""
        lists = [self.lists[t] for t in terms.tolist() if t in self.lists]
        seen, at, step = np.zeros(len(self.ids), bool), 0, ROUND
        while lists:
            met = np.unique(np.concatenate([self.listed[a + at : min(a + at + step, b)] for a, b in lists]))
            new = met[~seen[met]]
            seen[new] = True
            if len(new):
                scores = self.score(new, terms)
                kth = -best[-1][0] if len(best) == k else 1
                fine = np.flatnonzero(scores >= kth)
                if len(fine):
                    some = [(-int(scores[i]), self.ids[new[i]] is None, self.ids[new[i]]) for i in fine.tolist()]
                    best = heapq.nsmallest(k, [*best, *some])
            at += step
            step *= 2
            # What no list has shown yet scores the sum of the last impacts at most.
            threshold = sum(int(self.heights[a + at - 1]) for a, b in lists if a + at <= b)
            if threshold < (-best[-1][0] if len(best) == k else 1):
                break
            lists = [(a, b) for a, b in lists if a + at < b]
        return best


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of documents with a term: n counts all of them, the arrays hold those of the vocabulary."""
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, lengths, terms, counts = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                own = sorted(found.items())
                keep.append(k)
                lengths.append(len(words))
                terms.append([t for t, _ in own])
                counts.append([n for _, n in own])
            ids = b.column(0).take(pa.array(keep, pa.int32()))
            columns = [ids, pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("n long, terms array<int>, counts array<long>").fields])
    return docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text")).mapInArrow(work, schema)


def best_of_tasks(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(query, doc, score): of every task its k best documents for each query, a list of term numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []

        def answer() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            terms = whole.column("terms").combine_chunks()
            sizes = np.diff(np.asarray(terms.offsets))
            owner = np.repeat(np.arange(whole.num_rows), sizes)
            term = np.asarray(terms.flatten()).astype(np.int64)
            tf = np.asarray(whole.column("counts").combine_chunks().flatten())
            m = 50 + 50 * np.asarray(whole.column("n")) * documents // total
            impacts = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
            shard = Shard(whole.column("id").to_pylist(), owner, term, impacts, len(weights))
            for q, own in enumerate(asked):
                best[q] = shard.search(own, k, best[q])

        schema = None
        rows = postings = 0
        for b in batches:
            schema = b.column(0).type
            n = len(b.column(2).flatten())
            if held and (rows + b.num_rows > SHARD or postings + n > POSTINGS):
                answer()
                rows = postings = 0
            if n:
                held.append(b)
                rows, postings = rows + b.num_rows, postings + n
        if held:
            answer()
        if schema is not None:
            flat = [(q, i, -s) for q, own in enumerate(best) for s, _, i in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], t) for c, t in enumerate((pa.int32(), schema, pa.int64()))], names=["query", "doc", "score"])

    kind = index.schema["id"].dataType
    return index.mapInArrow(work, T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())]))


def blocks_of(queries: DataFrame, most_queries: int, most_terms: int) -> Iterator[list]:
    """Rows (id, terms) in blocks of bounded size, from (id, terms, n)."""
    after = F.lit(True)
    while page := queries.where(after).select("id", "n").orderBy("id").limit(most_queries).collect():
        size, end = 0, 0
        while end < len(page) and (end == 0 or size + page[end]["n"] <= most_terms):
            size += page[end]["n"]
            end += 1
        last = page[end - 1]["id"]
        upto = F.col("id").isNull() if last is None else F.col("id").isNull() | (F.col("id") <= F.lit(last))
        yield queries.where(after & upto).select("id", "terms").collect()
        after = F.col("id").isNotNull() if last is None else F.col("id") > F.lit(last)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", most_queries: int = QUERIES, most_terms: int = TERMS
) -> DataFrame:
    """The ``k`` best documents of every query: query id, rank from 1, id, score; equal scores by ascending id.

    * Terms are runs of ASCII letters, digits and any characters beyond ASCII, A-Z lower-cased. A null text has none.
    * Rows of ``queries`` with one id are one query with the terms of all its texts, each once; an empty one has no result.
    * Repeated documents count and rank one by one; a null id comes last among equal scores. Whole texts are read.
    * Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lexical-search")
    query_kind, kind = queries.schema[query_id].dataType, docs.schema[id_col].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted({t.decode() for t in terms_of(x)}) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], names=["id", "terms"])

    texts = queries.select(queries[query_id].alias("id"), text_or_empty(queries[query_text]).alias("text"))
    asked = texts.mapInArrow(split, T.StructType([T.StructField("id", query_kind), T.StructField("terms", T.ArrayType(T.StringType()))]))
    asked = asked.select("id", F.explode("terms").alias("term")).distinct().groupBy("id").agg(F.collect_list("term").alias("terms"))
    asked = scratch.put(asked.withColumn("n", F.size("terms")), "queries")
    found = []
    for number, block in enumerate(blocks_of(asked, most_queries, most_terms)):
        vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in block for t in r["terms"]}))}
        index = scratch.put(forward_index(docs, vocabulary, id_col, text_col), f"index-{number}")
        documents, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the block has terms
            weights[r["term"]] = weight(documents, r["count"])
        terms = [np.array(sorted(i for i in (vocabulary[t.encode()] for t in r["terms"]) if weights[i] > 0), np.int64) for r in block]
        tops = best_of_tasks(index, terms, weights, documents, total, k).withColumn("part", F.spark_partition_id())
        tops = scratch.put(tops, f"tops-{number}")
        scratch.drop(f"index-{number}")
        width = (tops.agg(F.max("part")).first()[0] or 0) + 1
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        while width > 1:
            tops = tops.withColumn("part", F.floor(F.col("part") / FAN))
            width = -(-width // FAN)
            tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order)))
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField(query_id, query_kind)]))
        found.append(scratch.put(ranked.join(names, "query").select(query_id, "rank", F.col("doc").alias(id_col), "score"), f"found-{number}"))
    if not found:
        fields = [T.StructField(query_id, query_kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kind), T.StructField("score", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with d as (select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
size as (select count(*) as documents, cast(sum(len(terms)) as bigint) as total from d where len(terms) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, len(terms) as n, unnest(terms) as term from d) x where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * documents + 2)::double / (2 * df + 1)::double)) as bigint) as weight from (select term, count(*) as df from t group by all) f, size),
p as (select row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * documents) // total)))) as impact from t join w using (term), size),
s as (select item_id, row, doc_id, cast(sum(impact) as bigint) as score from q join p using (term) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id nulls last) <= 50
"""
