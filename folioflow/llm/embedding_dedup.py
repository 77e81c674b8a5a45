"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash rotates the unit vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest vertex of the cross-polytope, plus or minus an axis. A
table joins several such hashes into a bucket. A vector stands in its own bucket of
every table and in the next likely ones (multiprobe). What meets in a bucket is a
candidate and is checked by cosine in double precision before it joins anything; the
components of checked pairs are then verified pair by pair, block by block.

Hashes a table are so many that a vector meets few others by chance, whatever the rows
of its label, and tables so many that the recall stays.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import linking
from folioflow.llm.common import Scratch, bounded_batches, table

#: Points that a step of the transform combines.
RADIX = 64
#: Vertices of each hash that probes choose from.
RANKS = 3
#: Vectors hashed at a time.
STEP = 1024


def polytope(width: int) -> int:
    """Vertices of the cross-polytope for vectors of this width, which is padded to a power of two."""
    return 2 << max(1, (width - 1).bit_length())


@functools.cache
def butterfly(radix: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, scaled to keep lengths."""
    at = np.arange(radix)
    signs = 1.0 - 2.0 * (np.bitwise_count(at[:, None] & at[None, :]) & 1)
    return (signs / math.sqrt(radix)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, ``RADIX`` points a step; its width is a power of two."""
    shape, done = x.shape, 1
    while done < shape[-1]:
        radix = min(RADIX, shape[-1] // done)
        if done == 1:
            x = x.reshape(-1, radix) @ butterfly(radix)
        else:
            x = butterfly(radix) @ x.reshape(-1, radix, done)
        done *= radix
    return x.reshape(shape)


@functools.lru_cache(4096)
def signs(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array((-1, 1), np.float32), (3, width))


def rotated(x: np.ndarray, seeds: list[int]) -> np.ndarray:
    """(row, seed, point): rows padded to a power of two, rotated by three rounds of seeded signs and a Hadamard transform."""
    width = polytope(x.shape[1]) // 2
    x = np.pad(x.astype(np.float32), ((0, 0), (0, width - x.shape[1])))[:, None, :]
    flips = np.stack([signs(s, width) for s in seeds])
    for k in range(3):
        x = hadamard(x * flips[None, :, k])
    return x


def vertices(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest vertices of rotated vectors (.., rank), nearest first, and how much farther each is than the first."""
    far = np.abs(y).reshape(-1, y.shape[-1])
    flat, rows = y.reshape(far.shape), np.arange(len(far))
    near, value = [], []
    for _ in range(min(RANKS, far.shape[1])):
        k = far.argmax(axis=1)
        near.append(2 * k + (flat[rows, k] < 0))
        value.append(far[rows, k])
        far[rows, k] = -1
    shape = (*y.shape[:-1], len(near))
    value = np.stack(value, 1)
    return np.stack(near, 1).astype(np.uint64).reshape(shape), (value[:, :1] - value).reshape(shape)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket numbers (row, table, 1 + probes): its own first, then those with the smallest loss of distance.

    A probe changes one hash of a table to one of its next vertices, or two to their second.
    """
    out = np.empty((len(x), tables, 1 + probes), np.uint64)
    scale = [np.uint64(pow(polytope(x.shape[1]) + 1, h, 1 << 64)) for h in range(hashes)]
    for at in range(0, len(x), STEP):
        some = x[at : at + STEP]
        for t in range(tables):
            near, loss = vertices(rotated(some, [1000 * t + h for h in range(hashes)]))
            own = sum(near[:, h, 0] * scale[h] for h in range(hashes))
            step = [[(near[:, h, r] - near[:, h, 0]) * scale[h] for h in range(hashes)] for r in range(near.shape[2])]
            codes = [own + step[r][h] for h in range(hashes) for r in range(1, near.shape[2])]
            costs = [loss[:, h, r] for h in range(hashes) for r in range(1, near.shape[2])]
            for a in range(hashes):
                for b in range(a):
                    codes.append(own + step[1][a] + step[1][b])
                    costs.append(loss[:, a, 1] + loss[:, b, 1])
            best = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, :probes]
            out[at : at + STEP, t] = own[:, None]  # where there are fewer probes than asked for
            out[at : at + STEP, t, 1 : 1 + best.shape[1]] = np.take_along_axis(np.stack(codes, 1), best, 1)
    return out


def meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(row, table): whether the buckets of x and y have one in common."""
    return (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3))


def at_cosine(cosine: float, width: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at this cosine."""
    rng = np.random.default_rng(20_261_126)
    a, r = rng.normal(size=(2, pairs, max(2, width)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * r


@functools.cache
def tables_for(hashes: int, width: int, cosine: float, probes: int, recall: float, least: int) -> int:
    """Tables, ``least`` or more, at which a pair at this cosine meets in one of them with the target recall.

    The chance of one table is that of 6,400 meetings of simulated pairs, less three standard errors.
    """
    tables, pairs = 16, 400
    met = meet(*(buckets(v, tables, hashes, probes) for v in at_cosine(cosine, width, pairs))).mean()
    chance = met - 3 * math.sqrt(met * (1 - met) / (tables * pairs))
    if chance <= 0:
        raise ValueError(f"no number of tables of {hashes} hashes finds pairs at cosine {cosine}")
    return least if chance >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


@functools.cache
def chance_of(hashes: int, width: int, probes: int) -> float:
    """How likely two unrelated vectors meet in one table.

    Counted on all pairs of 4,000 random vectors in 16 tables for up to four hashes; each further one divides it as the fourth does.
    """
    if hashes > 4:
        return chance_of(4, width, probes) * (chance_of(4, width, probes) / chance_of(3, width, probes)) ** (hashes - 4)
    tables, n = 16, 4000
    x = np.random.default_rng(20_261_126).normal(size=(n, max(2, width)))
    codes = np.sort(buckets(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes, probes), axis=2)
    met = 0
    for t in range(tables):
        first = np.concatenate((np.ones((n, 1), bool), codes[:, t, 1:] != codes[:, t, :-1]), axis=1)
        times = np.unique(codes[:, t][first], return_counts=True)[1]
        met += int((times * (times - 1)).sum())
    return max(met, 1) / (tables * n * (n - 1))


def plan(n: int, width: int, cosine: float, tables: int, probes: int, recall: float, chance: float) -> list[tuple[int, int, int]]:
    """(rows, hashes, tables): up to so many rows of a label, a vector meets ``chance`` others by chance; the last has room for n."""
    out = []
    hashes = 2
    while not out or out[-1][0] < n:
        needed = tables_for(hashes, width, cosine, probes, recall, tables)
        out.append((int(chance / (needed * chance_of(hashes, width, probes))), hashes, needed))
        hashes += 1
    return out


def matrix(vectors: pa.Array, rows: list[int]) -> np.ndarray:
    """Some rows, all of one width, scaled to length one."""
    first = vectors.offsets.to_numpy()[rows]
    size = len(vectors[rows[0]])
    x = vectors.values.to_numpy(zero_copy_only=False)[first[:, None] + np.arange(size)]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_kind(kinds: list) -> list[tuple[object, list[int]]]:
    found: dict = {}
    for k, kind in enumerate(kinds):
        found.setdefault(kind, []).append(k)
    return list(found.items())


def read(kinds: pa.Array, vectors: pa.Array) -> list:
    """(kind, unit vector) of each row; a kind has one width."""
    out: list = [None] * len(kinds)
    for kind, rows in by_kind(kinds.to_pylist()):
        for k, x in zip(rows, matrix(vectors, rows), strict=True):
            out[k] = (kind, x)
    return out


def alike(left: list, right: list, cosine: float) -> np.ndarray:
    """Which rows of equal kinds have at least this cosine."""
    out = np.zeros(len(left), bool)
    for _, rows in by_kind([x[0] for x in left]):
        a, b = (np.stack([s[k][1] for k in rows]) for s in (left, right))
        out[rows] = (a * b).sum(1) >= cosine
    return out


def linked(left: list, right: list | None, cosine: float) -> np.ndarray:
    """All pairs of equal kinds with at least this cosine."""
    right = left if right is None else right
    sides = [dict(by_kind([x[0] for x in s])) for s in (left, right)]
    out = np.zeros((len(left), len(right)), bool)
    for kind, a in sides[0].items():
        b = sides[1].get(kind)
        if b:
            y = np.stack([right[k][1] for k in b]).T
            for at in range(0, len(a), 512):
                some = a[at : at + 512]
                out[np.ix_(some, b)] = np.stack([left[k][1] for k in some]) @ y >= cosine
    return out


def dedup(
    vectors: DataFrame, cosine: float = 0.93, tables: int = 1, probes: int = 6, hashes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    recall: float = 0.9999, chance: float = 1.0,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal label and width are linked at ``cosine`` or more; component_id is the smallest id reachable by links.
    ``hashes`` of a table follow from the rows of each label, if not given, so that a vector meets at most ``chance`` others
    by chance in all tables, each of which costs one product and joins nothing; tables are as many as a pair at ``cosine`` needs to meet with the chance ``recall``, at least ``tables``.

    * A vector that is null, empty or zero, or holds a null or non-finite component, or has a null label, links with nothing.
    * Equal vectors are one item with the weight of all; each counts the others as links. Rows repeated with one id count too.
    * kept is true where component_id equals the id, and for a null id that is alone. An empty table gives no rows.
    * Only the named columns are read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 2048)
    scratch = Scratch(spark, "embeddings")
    label = vectors[label_col] if label_col else F.lit(0)
    v = F.col("vector")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), label.alias("label"))
    fine = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(fine, F.lit(False)), v)).withColumn("row", F.monotonically_increasing_id())
    # Equal vectors have equal pairs of hashes, so that whole vectors need not be sorted.
    rows = scratch.put(rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")}), "rows")
    same = ["label", "size", "h1", "h2"]
    rows = rows.withColumn("size", F.size("vector"))
    sound = rows.where("vector is not null")
    sizes = sound.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = scratch.put(sizes.withColumn("kind", F.monotonically_increasing_id()), "sizes")
    most = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.max("n").alias("n")).collect()}  # a row for each width
    # Widths that are padded alike have one plan, made for the largest label of them.
    padded: dict[int, int] = {}
    for size, n in most.items():
        padded[polytope(size) // 2] = max(n, padded.get(polytope(size) // 2, 0))
    if hashes:
        plans = {w: [(n, hashes, tables_for(hashes, w, cosine, probes, recall, tables))] for w, n in padded.items()}
    else:
        plans = {w: plan(n, w, cosine, tables, probes, recall, chance) for w, n in padded.items()}

    equal = scratch.put(sound.groupBy(*same).agg(F.min("row").alias("item"), F.count(F.lit(1)).alias("weight")), "equal")
    items = equal.join(sound.select(F.col("row").alias("item"), "vector"), "item").join(sizes, ["label", "size"])
    items = scratch.put(items, "items")

    def fitting(size: int, n: int) -> tuple[int, int]:
        return next((h, t) for rows, h, t in plans[polytope(size) // 2] if n <= rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list = [None] * b.num_rows
            kinds = b.column(1).to_numpy()
            sizes = b.column(2).to_pylist()
            plan_of = [(size, *fitting(size, n)) for size, n in zip(sizes, b.column(3).to_pylist(), strict=True)]
            for (_, hashes, tables), mine in by_kind(plan_of):
                codes = buckets(matrix(b.column(4), mine), tables, hashes, probes)
                codes = (codes ^ (codes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)[None, :, None]
                codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (kinds[mine].astype(np.uint64) * np.uint64(0x94D049BB133111EB))[:, None, None]
                for k, row in zip(mine, codes.reshape(len(mine), -1).view(np.int64), strict=True):
                    found[k] = np.unique(row)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["item", "codes"])

    codes = items.select("item", "kind", "size", "n", "vector").mapInArrow(hashed, "item long, codes array<long>")
    tasks = linking.tasks_of(vectors)
    alike_, linked_ = functools.partial(alike, cosine=cosine), functools.partial(linked, cosine=cosine)
    loads = items.select("item", "kind", F.col("vector").alias("load"))
    groups = linking.groups(codes.select(F.explode("codes").alias("key"), "item"), loads, read, alike_, linked_, tasks)
    roots = scratch.put(groups, "roots")
    members = items.join(roots.withColumnRenamed("node", "item"), "item").select("item", "root", "weight", "size", "kind", "vector")
    blocks = linking.blocked(members, 1024, 1 << 20).select("root", "part", "side", "item", "weight", "kind", "vector")
    found = linking.verify(blocks, lambda b: read(b.column(5), b.column(6)), linked_, tasks)
    counts = scratch.put(found.where("partner is null").groupBy("item").agg(F.sum("links").alias("links")), "counts")
    named = items.join(counts, "item", "left").join(roots.withColumnRenamed("node", "item"), "item", "left")
    named = scratch.put(named.select(*same, "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "item").alias("root")), "named")
    per_row = rows.drop("vector").join(named, same, "left").select(
        "row", "id", F.coalesce("root", "row").alias("root"), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).alias("n_links")
    )
    per_row = scratch.put(per_row, "per-row")
    classes = scratch.put(per_row.groupBy("root").agg(F.min("id").alias("component_id")), "classes")
    return per_row.join(classes, "root").select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


#: All pairs and their closure; for small tables.
ORACLE_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.93),
reach as (select vec_id, vec_id as other from embeddings union select reach.vec_id, links.b from reach join links on reach.other = links.a),
least_of as (select vec_id, min(other) as component_id from reach group by all),
n as (select a as vec_id, count(*) as n_links from links group by all)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from least_of left join n using (vec_id)
"""
