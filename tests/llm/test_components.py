"""Connected components against a plain union-find, in one partition and over star rounds with hot hubs."""

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tiercraft.llm import components, near_dedup


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        if a != b and x != y:
            root[max(x, y)] = min(x, y)
    ends = {x for a, b in links if a != b for x in (a, b)}
    return {x: find(x) for x in ends}


def graph(seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)]            # small pieces
    links += [(1000 + k, 1001 + k) for k in range(300)]                              # a long chain
    links += [(5000, 2000 + k) for k in range(700)] + [(2000 + k, 5000) for k in range(0, 700, 3)]  # a hub
    links += [(9000, 9000), (3, 3)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("per_partition", [10 ** 6, 150])
def test_against_plain(spark, per_partition, monkeypatch):
    monkeypatch.setattr(components, "HOT_NODE", 200)
    for seed, cast in ((1, int), (2, lambda x: f"k{x:05d}")):
        links = [(cast(a), cast(b)) for a, b in graph(seed)]
        kind = "a long, b long" if cast is int else "a string, b string"
        got = components.components(spark.createDataFrame(links, kind).repartition(5), per_partition).collect()
        assert {r.node: r.component for r in got} == plain(links)
        assert len(got) == len(plain(links))


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_roots_of_random_forests():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        want = plain(list(zip(a.tolist(), b.tolist(), strict=True)))
        assert components.roots(a, b, n).tolist() == [want.get(k, k) for k in range(n)]


def test_small_frames_are_written_to_few_files(spark):
    """Each file may cost an executor a process of its own for a moment."""
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    kept = components.settled(spark.range(0, 300, 1, 40).withColumnRenamed("id", "node"), 100)
    folder = max(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("rdd-*"),
                 key=lambda d: int(d.name.removeprefix("rdd-")))
    assert len(list(folder.glob("part-*"))) == 3
    assert kept.rdd.getNumPartitions() == 3
    assert sorted(r.node for r in kept.collect()) == list(range(300))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_memory_of_a_batch_of_texts():
    """The arrays of a slice of texts stay far below the limits of a Python worker."""
    texts = pa.array(["some words of a text, and some more of them " * 50] * 4_000)
    near_dedup.shingle_sets(texts.slice(0, 10), 5)
    tracemalloc.start()
    try:
        sets = near_dedup.shingle_sets(texts, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(sets) == 4_000 and all((s == sets[0]).all() for s in sets)
    assert peak < 64e6
