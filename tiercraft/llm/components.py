"""Connected components of a links table: union-find per partition, then large and small stars.

A partition holds a bounded number of links. Within it they are contracted to a
forest of stars first, so that what the star rounds still have to join is what
lies across partitions; links that fit one partition need no round at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.operators.skew import join_hot
from tiercraft.session import ensure_checkpoint_dir

ROWS_A_PARTITION = 50_000
LINKS_A_PARTITION = 400_000     # two ids each: some tens of MB in a task
HOT_NODE = 10_000               # a node of more links, and of a thousandth of them all, is dealt out


def partitions(n: int, rows: int = ROWS_A_PARTITION) -> int:
    return max(1, math.ceil(n / rows))


def settled(df: DataFrame, rows: int = ROWS_A_PARTITION) -> DataFrame:
    """``df`` from a checkpoint of as many files as its rows are worth.

    The rows are counted before they are written: for each file a task creates,
    Hadoop's file systems may start a process of their own (the local one without
    native code starts ``chmod`` for the file and its checksum), and for a moment
    an executor then seems to take its memory twice. Each map task of a later
    shuffle leaves files too, however little it holds.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    kept = held.coalesce(partitions(held.count(), rows)).checkpoint()
    held.unpersist(blocking=True)
    forget_rounds(df)
    return kept


def forget_rounds(df: DataFrame) -> None:
    """Let go of what finished rounds left: Spark drops their shuffle files and broadcasts only
    when a collection on the driver finds them unused, and a driver of small jobs seldom collects."""
    df.sparkSession.sparkContext._jvm.System.gc()


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = list(batches)
    if not links:
        return
    table = pa.Table.from_batches(links)
    ends = pa.chunked_array(table["a"].chunks + table["b"].chunks).to_numpy()
    nodes, code = np.unique(ends, return_inverse=True)
    root = roots(code[:table.num_rows], code[table.num_rows:], len(nodes))
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    kind = table.schema.field("a").type
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner], kind), pa.array(nodes[root[inner]], kind)], ["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """The links of each partition as stars around the smallest node of each of its components."""
    return edges.mapInArrow(_contract, edges.schema)


def _to_smallest(edges: DataFrame, only_larger: bool, parts: int, hot_from: int) -> DataFrame:
    """Link each neighbour of a node (only the larger ones, or all of its smaller
    ones and itself) to the smallest of the node and these neighbours."""
    if only_larger:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = (edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
           .withColumn("m", F.least("a", "m")))
    linked = join_hot(edges, low, ["a"], "links", F.col("b"), hot_from)
    if only_larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct().coalesce(parts)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node that is linked to none itself."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(links: DataFrame, links_a_partition: int = LINKS_A_PARTITION) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of links (a, b).

    Nodes without a link do not appear. Each round is checkpointed, so its
    lineage stays short; the rounds grow with the logarithm of the longest chain.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a > b"), links_a_partition)
    n = edges.count()
    parts = partitions(n, links_a_partition)
    hot_from = max(HOT_NODE, n // 1000)
    edges = contracted(edges).checkpoint()
    forget_rounds(edges)
    while parts > 1 and not _are_stars(edges):
        edges = _to_smallest(edges, True, parts, hot_from)
        edges = contracted(_to_smallest(edges, False, parts, hot_from)).checkpoint()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
