"""Links between similar items: candidates in buckets, checks, components of checked ties, blockwise verification.

Items that share a bucket are candidates. Each is first checked against the bucket's
smallest item, so a bucket of n items gives n - 1 ties and never its pairs. Ties that
pass the check make cores, their connected components. Pairs that this leaves open,
of different cores in one bucket, are checked block by block, and what passes joins
cores to groups: no unchecked meeting ever joins anything. A group is then cut into
blocks of bounded size and every pair of its blocks is verified in one step of a task,
which returns per item the weight of what it links with, and a spanning forest of the
links: rows in proportion to items, never pairs. Ids are long and unique; all tables
stay distributed, and each round of an iteration is staged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch


def groups(
    buckets: DataFrame, loads: DataFrame, read: Callable[[pa.Array, pa.Array], list], alike: Callable[[list, list], np.ndarray], link: Callable[[list, list | None], np.ndarray], tasks: int, items: int = 1024
) -> DataFrame:
    """(node, root) for items with a checked tie, from (key, item) and (item, kind, load).

    ``read`` turns arrays of kinds and loads into payloads; ``alike`` checks two lists of them row by row, ``link`` all pairs
    of two lists, or of one list and None, as a matrix. Every pair that shares a bucket is checked, unless checked ties connect it.
    """
    scratch = Scratch(buckets.sparkSession, "groups")
    buckets = scratch.put(buckets, "buckets")
    first = buckets.groupBy("key").agg(F.min("item").alias("first"), F.max("item").alias("last"), F.count(F.lit(1)).alias("n"))
    first = scratch.put(first.where("first < last").select("key", "first", "n"), "first")
    shared = scratch.put(buckets.join(first, "key"), "shared")
    scratch.drop("buckets")
    pairs = shared.where("item <> first").select(F.col("item").alias("a"), F.col("first").alias("b")).distinct()
    side = lambda name: loads.select(F.col("item").alias(name), F.col("kind").alias(f"kind_{name}"), F.col("load").alias(f"load_{name}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("kind_a = kind_b").select("a", "b", "kind_a", "load_a", "kind_b", "load_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = alike(read(b.column(2), b.column(3)), read(b.column(4), b.column(5))) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    sure = scratch.put(pairs.mapInArrow(check, "a long, b long"), "sure")
    cores = components(sure, "cores")
    # A bucket of two items has its only pair checked.
    left = shared.where("n > 2").join(cores.select(F.col("node").alias("item"), F.col("root").alias("core")), "item", "left")
    left = scratch.put(left.select("key", "item", F.coalesce("core", "item").alias("core")), "left")
    alone, other = F.xxhash64("item"), F.xxhash64(F.lit(1), "item")
    several = left.groupBy("key").agg(F.min("core").alias("low"), F.max("core").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(alone).alias("x"), F.bit_xor(other).alias("y"))
    # Buckets of the same items are one.
    several = several.where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    several = scratch.put(several.select("key").withColumn("root", F.monotonically_increasing_id()), "several")
    if several.isEmpty():
        return cores
    rest = left.join(several, "key").join(loads, "item").select("item", "root", F.lit(1).alias("size"), F.lit(1).cast("long").alias("weight"), "core", "kind", "load")
    rest = blocked(rest, items, items).select("root", "part", "side", "item", "weight", "core", "kind", "load")

    def apart(left: list, right: list | None) -> np.ndarray:
        cores = [np.array([x[0] for x in s], np.int64) for s in (left, left if right is None else right)]
        made = link([x[1] for x in left], None if right is None else [x[1] for x in right])
        return made & (cores[0][:, None] != cores[1][None, :])

    more = verify(rest, lambda b: list(zip(b.column(5).to_pylist(), read(b.column(6), b.column(7)), strict=True)), apart, tasks)
    more = more.where("partner is not null").select(F.col("item").alias("a"), F.col("partner").alias("b"))
    return components(scratch.put(sure.unionByName(more), "ties"), "checked-groups")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of (a, b): root is the smallest node reachable.

    Labels take the smallest of their neighbours' and jump to their label's label, until a round changes none.
    """
    scratch = Scratch(edges.sparkSession, name)
    both = scratch.put(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels-0")
    moved, k = not labels.isEmpty(), 0
    while moved:
        k += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = scratch.put(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("least")), f"least-{k}")
        up = least.select(F.col("node").alias("least"), F.col("least").alias("top"))
        new = scratch.put(least.join(up, "least").select("node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), f"labels-{k}")
        moved = new.agg(F.max("moved")).first()[0]
        for old in (f"labels-{k - 1}", f"least-{k}"):
            scratch.drop(old)
        labels = new.drop("moved")
    return labels


def blocked(members: DataFrame, items: int, size: int) -> DataFrame:
    """``members`` (item, root, size, ...) with the row repeated for every pair of blocks of its group; groups of one item are left out.

    A block has ``items`` items and ``size`` of summed size on average, or a sixteenth of its group if that is more, up to
    sixteen times these. Adds part, the pair of blocks, and side: 0 or 1, or 2 for a block with itself.
    """
    scratch = Scratch(members.sparkSession, "blocks")
    members = scratch.put(members, "members")
    n, total = F.count(F.lit(1)), F.sum("size")
    per_block = lambda all_of_it, least: F.least(F.greatest(F.lit(least), all_of_it / 16), F.lit(16 * least))
    blocks = F.least(n, F.greatest(F.ceil(n / per_block(n, items)), F.ceil(total / per_block(total, size))))
    several = scratch.put(members.groupBy("root").agg(blocks.cast("int").alias("blocks"), n.alias("n")).where("n > 1").drop("n"), "groups")
    rows = members.join(several, "root").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return pairs.withColumns({"part": part, "side": side}).drop("block", "other", "blocks")


def forest(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links as pairs of positions (row, column). ``same``: rows and columns are the same items."""
    out = []
    if same:
        todo = np.ones(len(links), bool)
        for start in range(len(links)):
            if not todo[start]:
                continue
            todo[start] = False
            stack = [start]
            while stack:
                u = stack.pop()
                new = np.flatnonzero(links[u] & todo)
                todo[new] = False
                out += [(u, int(v)) for v in new]
                stack += new.tolist()
        return out
    rows, cols = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    turned = np.ascontiguousarray(links.T)
    for start in range(links.shape[0]):
        if not rows[start]:
            continue
        rows[start] = False
        stack = [(start, True)]
        while stack:
            u, is_row = stack.pop()
            new = np.flatnonzero((links[u] & cols) if is_row else (turned[u] & rows))
            (cols if is_row else rows)[new] = False
            out += [(u, int(v)) if is_row else (int(v), u) for v in new]
            stack += [(int(v), not is_row) for v in new]
    return out


def verify(rows: DataFrame, read: Callable[[pa.RecordBatch], list], link: Callable[[list, list | None], np.ndarray], tasks: int) -> DataFrame:
    """Verified links of blocked rows (root, part, side, item, weight, payload columns): (item, links, partner).

    ``read`` turns a batch into payloads, ``link`` two lists of payloads, or one list and None, into a matrix of booleans.
    A row has the weight that ``item`` links with in one pair of blocks, or an edge of the forest to ``partner``.
    """
    order = ["root", "part", "side"]
    columns = ["root", "part", "side", "item", "weight"]
    rest = [c for c in rows.columns if c not in columns]
    rows = rows.select(*columns, *rest).repartition(tasks, "root", "part").sortWithinPartitions(*order)
    schema = pa.schema([("item", pa.int64()), ("links", pa.int64()), ("partner", pa.int64())])

    def solve(group: list) -> pa.RecordBatch:
        items = np.array([g[0] for g in group], np.int64)
        weights = np.array([g[1] for g in group], np.int64)
        side = np.array([g[2] for g in group])
        load = [g[3] for g in group]
        out: list = [[], [], []]
        same = side == 2
        if same.any():
            made = link(load, None)
            np.fill_diagonal(made, False)
            sums = [(items, made @ weights)]
            edges = [(items[a], items[b]) for a, b in forest(made, True)]
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            made = link([load[k] for k in left], [load[k] for k in right]) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
            sums = [(items[left], made @ weights[right]), (items[right], made.T @ weights[left])]
            edges = [(items[left[a]], items[right[b]]) for a, b in forest(made, False)]
        for who, n in sums:
            some = n > 0
            out[0] += who[some].tolist()
            out[1] += n[some].tolist()
            out[2] += [None] * int(some.sum())
        out[0] += [int(a) for a, _ in edges]
        out[1] += [0] * len(edges)
        out[2] += [int(b) for _, b in edges]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            roots, parts, sides, items, weights = (b.column(k).to_pylist() for k in range(5))
            load = read(b)
            for key, side, item, weight, x in zip(zip(roots, parts, strict=True), sides, items, weights, load, strict=True):
                if key != at:
                    if len(group) > 1:
                        yield solve(group)
                    group, at = [], key
                group.append((item, weight, side, x))
        if len(group) > 1:
            yield solve(group)

    return rows.mapInArrow(work, "item long, links long, partner long")


def linked(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """From verified rows: (item, links) and (node, root), for items with a link."""
    scratch = Scratch(found.sparkSession, name)
    found = scratch.put(found, "links")
    counts = found.where("partner is null").groupBy("item").agg(F.sum("links").alias("links"))
    roots = components(found.where("partner is not null").select(F.col("item").alias("a"), F.col("partner").alias("b")), f"{name}-classes")
    return scratch.put(counts, "counts"), roots


def tasks_of(df: DataFrame) -> int:
    """Tasks of a step that is dealt out by hand: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
