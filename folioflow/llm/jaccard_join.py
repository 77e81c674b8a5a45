"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

Every document becomes the set of its five-word shingles. In each tree of the forest it
has a signature of ``longest`` min-hashes; the tree is the trie of these, and sorting
puts every subtree in one run. In each tree a document's prefix starts at full length
and is shortened to where it matches a neighbour in the order. The least similar partner
that a set of its size can have shares a prefix of length d with probability s^d, so that
these prefixes give the document a recall; while that is below the target, the longest
prefix that it has in any tree is shortened by one. So copies of a document keep long
prefixes in some trees, and one that matches little goes down to where the target holds
in any case, its floor. A document meets all that stand below the node of its prefix,
whatever their own prefixes are.

What meets in a node is checked on the whole signatures before it is tied. The groups
of checked ties are verified exactly, block by block, on the shingle sets themselves,
and only verified links make classes.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import linking
from folioflow.llm.common import Scratch, bounded_batches, neighbours, table, text_or_empty

WORD = re.compile(r"\w+")
N = 5
#: Odd multipliers of the words of a shingle, and of the last mixing step.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)
MEMORY = 500_000


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words, lower-cased; of all words, if there are one to four; none of no words."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(N, len(words))
    s = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        s += (h[k : len(h) - width + 1 + k] ^ (h[k : len(h) - width + 1 + k] >> np.uint64(31))) * PLACES[k]
    s ^= s >> np.uint64(33)
    s *= MIX
    s ^= s >> np.uint64(29)
    return np.unique(s)


@functools.lru_cache(8192)
def least_similarity(size: int, similarity: float) -> float | None:
    """The least Jaccard similarity, at the threshold or above, of a set of this size and a different set; None if there is none."""
    both = np.arange(math.ceil(similarity * size - 1e-9), size + 1)
    union = np.floor(both / similarity + 1e-9).astype(np.int64)
    fine = (both > 0) & (union >= size) & (union > both)
    return float((both[fine] / union[fine]).min()) if fine.any() else None


@functools.lru_cache(8192)
def depth(size: int, trees: int, longest: int, similarity: float, recall: float) -> int | None:
    """Where a set of this size stops: the longest prefix with the target recall, 1 if there is none; None without a possible partner."""
    least = least_similarity(size, similarity)
    if least is None:
        return None
    return next((k for k in range(longest, 1, -1) if 1 - (1 - least**k) ** trees >= recall), 1)


def shortened(size: int, matched: list[int], trees: int, longest: int, similarity: float, recall: float) -> list[int]:
    """Prefix lengths of a set of this size in the trees where it has neighbours, from the lengths that it shares with them.

    In the other trees it has none down to its floor, which is the length that gives the recall in all trees; there is
    nothing to meet in them, and they count with it. Of equally long prefixes the first is shortened first.
    """
    floor, least = depth(size, trees, longest, similarity, recall), least_similarity(size, similarity)
    out = [max(floor, m) for m in matched]
    miss = (1 - least**floor) ** (trees - len(out)) * math.prod(1 - least**d for d in out)
    while miss > 1 - recall and out and max(out) > floor:
        k = out.index(max(out))
        miss *= (1 - least ** (out[k] - 1)) / (1 - least ** out[k])
        out[k] -= 1
    return out


@functools.lru_cache(64)
def least_agreement(n: int, similarity: float, miss: float = 1e-6) -> int:
    """How many of n min-hashes a pair of this similarity has in common, but for the chance ``miss``."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if total > miss:
            return k
    return n


def multipliers(trees: int, longest: int) -> np.ndarray:
    return np.random.default_rng(20_260_801).integers(0, 1 << 63, (trees, longest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, by: np.ndarray) -> bytes:
    """Two bytes of the min-hash of a shingle set under each multiplier, tree by tree."""
    flat = by.reshape(-1, 1)
    low = np.full(len(flat), ~np.uint64(0))
    for at in range(0, len(found), 1024):
        low = np.minimum(low, (flat * found[None, at : at + 1024]).min(axis=1))
    low = (low ^ (low >> np.uint64(32))) * MIX
    return (low >> np.uint64(48)).astype("<u2").tobytes()


def agreeing(left: list[np.ndarray], right: list[np.ndarray], least: int) -> np.ndarray:
    """Which rows have so many min-hashes in common."""
    if not left:
        return np.zeros(0, bool)
    return (np.stack(left) == np.stack(right)).sum(1) >= least


def all_agreeing(left: list[np.ndarray], right: list[np.ndarray] | None, least: int) -> np.ndarray:
    """Which pairs have so many min-hashes in common."""
    a = np.stack(left)
    b = a if right is None else np.stack(right)
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out >= least


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which pairs of shingle sets have at least this Jaccard similarity, by counting the shingles they share."""
    other = left if right is None else right
    sizes = np.array([len(x) for x in other], np.int64)
    values = np.concatenate(other)
    owner = np.repeat(np.arange(len(other)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = np.zeros((len(left), len(other)), bool)
    for k, x in enumerate(left):
        first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = last - first
        first, n = first[n > 0], n[n > 0]
        if not len(n):
            continue
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(other))
        out[k] = both >= similarity * (len(x) + sizes - both) - 1e-9
    return out


def common(label: str, other: str, floor: int, longest: int) -> Column:
    """How many min-hashes two labels begin with alike, from ``floor`` on; null without another one."""
    out = F.when(F.col(other).isNotNull(), F.lit(floor))
    for k in range(floor + 1, longest + 1):
        out = F.when(F.substring(F.col(label), 1, 2 * k) == F.substring(F.col(other), 1, 2 * k), F.lit(k)).otherwise(out)
    return out


def forest(items: DataFrame, trees: int, longest: int, similarity: float, recall: float) -> DataFrame:
    """(item, tree, node, label, depth): the prefix lengths of (item, size, sign) in the trees where they have company.

    ``node`` names the subtree of the shortest prefix that any set can have. A subtree is a run of the sorted labels, cut over
    tasks where it is large; a label looks at the ones before and behind it only.
    """
    scratch = Scratch(items.sparkSession, "forest")
    floor = min([longest, *(d for d in (depth(n, trees, longest, similarity, recall) for n in range(1, 200)) if d)])
    each = items.select("item", "size", "sign", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    label = F.expr(f"substring(sign, tree * {2 * longest} + 1, {2 * longest})")
    rows = each.select("item", "size", F.col("tree").cast("tinyint").alias("tree"), label.alias("label")).withColumn("node", F.xxhash64("tree", F.substring("label", 1, 2 * floor)))
    rows = scratch.put(rows, "labels")
    crowded = scratch.put(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "crowded")
    rows = rows.join(crowded.hint("merge"), "node", "left_semi").select("item", "size", "tree", "label", "node")
    near = neighbours(scratch, rows, ["tree", "label", "item"], "label", "node", ("tree", "label", "item"))
    matched = F.greatest(common("label", "prev", floor, longest), common("label", "next", floor, longest), F.lit(floor))
    own = near.withColumn("matched", matched).groupBy("item").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("tree", "node", "label", "matched"))).alias("places"))

    @F.pandas_udf("array<int>")
    def lengths(sizes: pd.Series, matched: pd.Series) -> pd.Series:
        return pd.Series([shortened(int(n), [int(x) for x in m], trees, longest, similarity, recall) for n, m in zip(sizes, matched, strict=True)])

    found = own.select("item", "places", lengths("size", F.transform("places", lambda x: x["matched"])).alias("depths"))
    found = found.select("item", F.inline(F.arrays_zip("places", "depths"))).select("item", "places.tree", "places.node", "places.label", F.col("depths").alias("depth"))
    return scratch.put(found, "prefixes")


def meetings(placed: DataFrame) -> DataFrame:
    """(key, item): below each prefix that some item has in a subtree, all items of the subtree that begin with it."""
    asked = placed.groupBy("node").agg(F.collect_set("depth").alias("lengths"))
    every = placed.select("item", "tree", "node", "label").join(asked, "node").select("item", "tree", "label", F.explode("lengths").alias("depth"))
    return every.select(F.xxhash64("tree", "depth", F.expr("substring(label, 1, 2 * depth)")).alias("key"), "item")


def join(docs: DataFrame, similarity: float = 0.8, trees: int = 20, longest: int = 8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links, group_size, kept, n_shingles, and ``text_key``, the MD5 of its text.

    Documents of similarity ``similarity`` or more are linked; class_id is the smallest id reachable by links, n_links counts the
    other documents linked directly, and kept marks one row of each class, that with the smallest id.

    * Documents with the same shingles are linked and count one by one. A null or wordless text links with nothing.
    * The whole of a long text counts; texts travel in batches of bounded bytes, a longer one alone.
    * Repeated rows are separate documents, of which one is kept; null ids come last and never name a class that has others.
    * An empty table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    by = multipliers(trees, longest)
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(docs[text_col])
    source = docs.select(docs[id_col].alias("id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, print_of, signs = [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t)
                sets.append(len(found))
                print_of.append(xxhash.xxh128_digest(found.tobytes()))
                signs.append(signature(found, by) if least_similarity(len(found), similarity) else None)  # else it has no partner but its equals
            columns = [pa.array(sets, pa.int64()), pa.array(print_of, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "text_key", "n_shingles", "print", "sign"])

    signed = source.mapInArrow(sign, f"id {kind}, text_key string, n_shingles long, print binary, sign binary")
    signed = scratch.put(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    worded = signed.where("n_shingles > 0")
    # Documents with equal shingles are one item, named by its first row.
    items = worded.groupBy("print").agg(F.min("row").alias("item"), F.count(F.lit(1)).alias("weight"))
    items = scratch.put(items, "items")
    firsts = scratch.put(items.join(worded.drop("print"), items["item"] == worded["row"]).select("item", "weight", "id", "text_key", F.col("n_shingles").alias("size"), "sign"), "firsts")
    least = least_agreement(trees * longest, similarity)
    loads = firsts.select("item", F.lit(0).alias("kind"), F.col("sign").alias("load"))
    groups = linking.groups(
        meetings(forest(firsts.where("sign is not null"), trees, longest, similarity, recall)),
        loads,
        lambda _, signs: [np.frombuffer(s, "<u2") for s in signs.to_pylist()],
        functools.partial(agreeing, least=least),
        functools.partial(all_agreeing, least=least),
        linking.tasks_of(docs),
    )
    members = firsts.drop("sign").join(groups.select(F.col("node").alias("item"), "root"), "item")
    # Whole texts travel for members of groups only, once, and again for each pair of blocks of a large group.
    members = scratch.put(members, "members")
    wanted = members.select(F.col("id").alias("its_id"), F.col("text_key").alias("its_key"), "item", "root", "weight", "size")
    # Their number grows with the documents, so that no size of the input has them broadcast.
    texts = source.join(wanted.hint("merge"), source["id"].eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))).select("item", "root", "weight", "size", "text").dropDuplicates(["item"])
    rows = linking.blocked(texts, 512, 250_000)
    found = linking.verify(
        rows.select("root", "part", "side", "item", "weight", "text"),
        lambda b: [shingles(t) for t in b.column(5).to_pylist()],
        lambda a, b: overlaps(a, b, similarity),
        linking.tasks_of(docs),
    )
    counts, roots = linking.linked(found, "jaccard")
    named = items.join(counts, "item", "left").join(roots.withColumnRenamed("node", "item"), "item", "left")
    named = scratch.put(named.select("print", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "item").alias("root")), "named")
    rows = scratch.put(
        signed.drop("sign").join(named, (signed["print"] == named["print"]) & (signed["n_shingles"] > 0), "left").select(
            "row", "id", "text_key", "n_shingles", F.coalesce("root", "row").alias("root"), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).alias("n_links")
        ),
        "rows",
    )
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row")))
    classes = scratch.put(rows.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "classes")
    return rows.join(classes, "root").select(
        F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "n_links", "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "n_shingles", "text_key"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that ``join`` does not keep; all columns stay, of a repeated row one."""
    kept = join(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col(id_col).alias("its_id"), F.col("text_key").alias("its_key"))
    key = F.md5(text_or_empty(docs[text_col]).cast("binary"))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), key.alias("key"))
    found = whole.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")), "left_semi")
    return found.dropDuplicates(["id", "key"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("text_key")


#: Shared shingles of all pairs and the closure of their links; for small tables.
ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n_shingles from s group by all),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 10 * n >= 8 * (x.n_shingles + y.n_shingles - n)),
reach as (select doc_id, doc_id as other from documents union select reach.doc_id, links.b from reach join links on reach.other = links.a),
classes as (select doc_id, min(other) as class_id from reach group by all),
degree as (select a as doc_id, count(*) as n_links from links group by all)
select c.doc_id, class_id, coalesce(n_links, 0) as n_links, count(*) over (partition by class_id) as group_size, c.doc_id = class_id as kept, coalesce(n_shingles, 0) as n_shingles
from classes c left join degree using (doc_id) left join n using (doc_id)
"""
