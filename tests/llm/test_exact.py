import hashlib
import random
import re

from folioflow.llm.exact_dedup import exact_dedup


def model(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare])[3]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def test_edges(documents, extra):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "ab\u00a0"), (None, "a   b"), (None, None), (8, "é" * 50_000), (8, "é" * 50_000), (9, "e\x1fx"), (10, "ex")]
    assert rows_of(exact_dedup(extra(documents(rows)).repartition(5), fan_in=2)) == model(rows)


def test_hot_group_over_many_runs(documents):
    rng = random.Random(0)
    rows = [(k, "same text" + " " * rng.randint(0, 3) if k % 3 == 0 else f"t{rng.randint(0, 50)}") for k in range(600)]
    assert rows_of(exact_dedup(documents(rows).repartition(13), fan_in=3)) == model(rows)


def test_empty(documents):
    assert exact_dedup(documents([])).collect() == []


def test_plan_is_native(documents):
    plan = exact_dedup(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rounds_keep_the_order(documents):
    """A merge neither sorts nor exchanges: all rounds stand on one exchange by segment and one sort."""
    from folioflow.llm import common

    plans, put = [], common.Scratch.put

    class Watched(common.Scratch):
        def put(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString() if name == "decided" else "")
            return put(self, df, name)

    from folioflow.llm import exact_dedup as module

    module.Scratch, before = Watched, module.Scratch
    try:
        exact_dedup(documents([(k, f"t{k % 9}") for k in range(60)]).repartition(30), fan_in=2).collect()
    finally:
        module.Scratch = before
    plan = "".join(plans)
    merges = plan[plan.index("SortAggregate") : plan.rindex("SortAggregate")]
    assert plan.count("SortAggregate(") >= 10 and "Exchange" not in merges and "Sort [" not in merges


def test_one_run(documents):
    rows = [(3, "a"), (2, "a "), (1, "b")]
    assert rows_of(exact_dedup(documents(rows).coalesce(1))) == model(rows)
