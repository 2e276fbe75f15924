"""Which document is lost to which filter, in every order the filters could run in.

A set of filters already applied is a state of the subset lattice; applying one
more filter is an edge from state S to S with that filter. What an edge removes
does not depend on the order in which S was applied, so n filters need
n * 2**(n-1) edges, not n! runs. A forward pass counts the orders that reach
each state, a backward pass those that leave it; an edge lies on
reach * leave of the n! orders. Weighted so, its removals add up to the Shapley
sums, and the steps of any one order are read off the same edges.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.llm.text import col
from tiercraft.operators.skew import join_hot
from tiercraft.session import ensure_checkpoint_dir

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 100, 80, 10, "#$%&*|"
#: Orders grow as n!: more filters than this are refused rather than sampled.
MAX_FILTERS = 7
HOT_TEXT = 10_000

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")


def lattice(n: int) -> tuple[list[int], list[int]]:
    """Per state of ``n`` filters (a bit mask): the orders that reach it, and the ways to go on from it."""
    reach, leave = [0] * (1 << n), [0] * (1 << n)
    reach[0] = leave[-1] = 1
    for s in range(1 << n):
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in reversed(range((1 << n) - 1)):
        leave[s] = sum(leave[s | 1 << f] for f in range(n) if not s >> f & 1)
    return reach, leave


def text_faults(text: str) -> int:
    """Bit mask of the conditions A to D that a text fails."""
    words = text.encode().split()          # bytes split at [\\x20\\x09-\\x0D]
    upper = len(text.encode().translate(None, _NOT_UPPER))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * upper > MAX_UPPER * len(text)) << 2
            | (_SYMBOL.search(text) is not None) << 3)


def _judge(texts: pa.Array) -> pa.Array:
    masks, keys = [], []
    for value in texts:
        text = value.as_py() or ""
        masks.append(text_faults(text))
        keys.append(hashlib.sha256(text.encode()).digest())
    return pa.StructArray.from_arrays([pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
                                      ["mask", "key"])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: ``part``, ``mask`` (bits of the failed conditions A to E), ``good``, ``toxic``.

    A: fewer than 100 words. B: under 80 % of the words are distinct. C: over
    10 % of the code points are A-Z. D: holds one of ``#$%&*|``. E: a smaller id
    of the whole table has the same text (equal SHA-256). Null texts are empty;
    a null part is the empty string. A null id is neither smaller nor larger
    than any, so it never fails E, and has no label. Rows that repeat an id are
    judged each; of repeated labels any that says 1 counts. Other columns do
    not matter.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    # Texts are read once; from here on a row is some sixty bytes.
    faults = F.arrow_udf(_judge, "struct<mask:int,key:binary>")
    thin = (docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"),
                        faults(col(text_col).cast("string")).alias("j"))
            .select("id", "part", "j.mask", "j.key").checkpoint())
    shared = (thin.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
              .where("rows > 1"))
    # Hot is a text of at least a thousandth of all rows: there are few, however many rows.
    hot_from = max(HOT_TEXT, thin.count() // 1000)
    copies = join_hot(thin, shared, ["key"], "rows", F.col("id"), hot_from, how="left")
    judged = copies.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), 16)
                                          .otherwise(0)).alias("mask"))
    marks = (labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .where("good = 1 OR toxic = 1").withColumn("deal", F.lit(0)))
    # Rows without an id join nothing; dealt out they do not meet in one task.
    dealt = judged.withColumn("deal", F.when(F.col("id").isNull(), 1 + F.monotonically_increasing_id() % 1000)
                              .otherwise(0).cast("int"))
    dealt = dealt.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return (dealt.join(marks.withColumn("id", F.col("id").cast("string")), ["id", "deal"], "left")
            .select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"),
                    F.coalesce("toxic", F.lit(0)).alias("toxic")))


def audit(judged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per ``part``, order of the filters and step: what the step keeps and removes.

    ``judged`` has ``part``, ``mask`` (bit k: fails the k-th of ``filters``),
    ``good`` and ``toxic`` (0 or 1). Columns: ``part``, ``filter_order``,
    ``step`` (from 1), ``kept``, ``removed``, ``redundant`` (fail this filter,
    removed earlier), ``unique_fails`` (fail this filter only), ``good_lost``,
    ``toxic_lost``, ``shapley`` (removals of the step's filter summed over all
    orders). Every order has all its steps, zeros included; a table without
    rows has no part. Each filter is one character; at most ``MAX_FILTERS``.
    """
    n = len(filters)
    if not 1 <= n <= MAX_FILTERS or len(set(filters)) < n:
        raise ValueError(f"1 to {MAX_FILTERS} different filters, one character each")
    reach, leave = lattice(n)
    edges = [(s << 3 | f, s, 1 << f, reach[s] * leave[s | 1 << f])
             for s in range(1 << n) for f in range(n) if not s >> f & 1]
    steps = []
    for order in permutations(range(n)):
        state = 0
        for k, f in enumerate(order):
            steps.append(("".join(filters[i] for i in order), k + 1, state << 3 | f))
            state |= 1 << f
    counts = judged.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # At most 2**n rows a part meet the lattice's edges; every edge sees every row, so none is missing.
    each = counts.withColumn("e", F.explode(F.array(*[F.struct(
        F.lit(i).alias("edge"), F.lit(s).alias("state"), F.lit(bit).alias("bit"), F.lit(w).cast("long").alias("weight"))
        for i, s, bit, w in edges]))).select("*", "e.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = fails & (F.col("mask").bitwiseAND(F.col("state")) == 0)

    def total(value: str, when) -> F.Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    flows = each.groupBy("part", "edge", "bit", "weight").agg(
        F.sum("n").cast("long").alias("total"), total("n", gone).alias("removed"), total("n", fails).alias("failing"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"))
    shares = flows.withColumn("shapley", F.sum(F.col("removed") * F.col("weight"))
                              .over(Window.partitionBy("part", "bit")))
    path = judged.sparkSession.createDataFrame(steps, "filter_order string, step int, edge int")
    # n! * n rows of constants: 600 for five filters.
    on_order = shares.join(F.broadcast(path), "edge")
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return on_order.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
