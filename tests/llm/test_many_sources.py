"""Targets of very many sources against plain Python; the plan's windows."""

import random

from pyspark.sql import functions as F

from tiercraft.llm import mixing


def plain_targets(sizes, share=1.5, max_copies=2.0, weights=mixing.WEIGHTS):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    pool, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (pool - sum(target.values())) / sum(weight[s] for s in open_)
        capped = {s for s in open_ if max_copies * sizes[s] < level * weight[s]}
        if not capped:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: max_copies * sizes[s] for s in capped}
        open_ -= capped
    return target


def _frame(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)


def test_targets_of_very_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"host{rng.randrange(10**9)}.{k}": rng.choice([0, 1, 5, 5, rng.randrange(10**6)]) for k in range(30_000)}
    sizes |= {None: 10**7, "": 4, "é": 9, "𝒳": 2, "one holds a third": 10**9}
    got = {r.source: r.target for r in mixing.allocate(_frame(spark, sizes)).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_small_and_odd_tables(spark):
    for sizes in ({"a": 5}, {"a": 0}, {None: 3, "a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 100, "b": 1, "c": 1000}):
        for share in (0.0, 0.5, 1.5, 2.0, 9.0):
            got = {r.source: r.target for r in mixing.allocate(_frame(spark, sizes), share=share).collect()}
            want = plain_targets(sizes, share)
            assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes), (sizes, share, got, want)
    assert mixing.allocate(_frame(spark, {"a": 1}).where(F.lit(False))).count() == 0


def test_no_window_over_all_sources(spark):
    sizes = {f"s{k}": k for k in range(500)}
    plan = mixing._running(_frame(spark, sizes), [F.col("source").asc()], {"n": F.lit(1)})
    rows = plan.collect()
    assert sorted(r.n for r in rows) == list(range(500))
    assert [r.source for r in sorted(rows, key=lambda r: r.n)] == sorted(sizes)
