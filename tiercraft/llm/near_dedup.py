"""Near-duplicate documents by HyperMinHash sketches.

A document's distinct word shingles are hashed once each; the hash's first
bits choose one of 128 buckets, and a bucket keeps only the number of leading
zeros and ten mantissa bits of its smallest remainder: two bytes a register.
Empty buckets borrow from others in a fixed random order. Bands of registers
propose pairs, a collision-corrected estimate of the similarity prunes them,
and the shingle sets of the survivors decide.

No stage lists all pairs of a group. Equal sets are folded into classes first.
In each band bucket the members are compared with one hub only (the smallest
member in even bands, the largest in odd ones), and the links found are closed
to components. Buckets that still hold several components get as hub the
document with most links around them; documents near it are matched by their
rare differences from it (prefix and position filters that lose no link), those
far from it by their rare shingles in the same way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.llm.components import components, settled
from tiercraft.llm.text import col, fresh
from tiercraft.llm.vec import LOWER, lists, mix, range_hashes, text_slices, word_bounds
from tiercraft.operators.skew import join_hot
from tiercraft.session import ensure_checkpoint_dir

BULKY_ROWS = 10_000      # rows a partition for frames with sets or registers
HOT_ROWS = 1_000         # a key of fewer rows is never hot
CELL_ROWS = 2_000        # rows of one shingle that are matched with each other in one place
REGISTERS, BUCKET_BITS, MANTISSA_BITS, VALUE_BITS = 128, 7, 10, 53
MISS = 1e-6      # most often that a pair just at the threshold may share no band
NEAR = 0.25      # documents at least so similar to a hub are matched by their differences from it
SIGMAS = 6       # how far below the threshold an estimate must lie to drop a pair

_SKETCH = "struct<n:bigint,c1:bigint,c2:bigint,regs:binary,bands:array<bigint>>"
_rng = np.random.default_rng(20)
_BORROW = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])
_REST = np.uint64((1 << (64 - BUCKET_BITS)) - 1)


def band_rows(similarity: float) -> int:
    """The longest band by which a pair at the threshold is missed at most ``MISS`` often."""
    return max((r for r in range(1, 9)
                if (1 - similarity ** r) ** (REGISTERS // r) <= MISS), default=1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; fewer words make one shingle, none make none."""
    out = []
    for data, offsets in text_slices(texts):
        data = LOWER[data]
        start, end, first = word_bounds(data, offsets)
        word = range_hashes(data, start, end)
        at = np.arange(max(0, len(word) - words + 1))
        shingle = range_hashes(word, at, at + words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(shingle[a:b - words + 1]))
            else:
                out.append(range_hashes(word, np.array([a]), np.array([b])) if b > a
                           else np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers (leading zeros, mantissa) of a sorted non-empty hash set."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    lead = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: a bucket's first is its least
    value = ((hashes[lead] & _REST) >> np.uint64(64 - BUCKET_BITS - VALUE_BITS)).astype(np.int64)
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    mantissa = ((value << (VALUE_BITS - length)) >> (VALUE_BITS - 1 - MANTISSA_BITS)) & (
        (1 << MANTISSA_BITS) - 1)
    out, full = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[bucket[lead]] = ((VALUE_BITS - length) << MANTISSA_BITS) | mantissa
    full[bucket[lead]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _BORROW[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def sketcher(words: int, rows: int):
    bands = REGISTERS // rows

    def sketch(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, words)
        regs = np.stack([registers(h) if len(h) else np.zeros(REGISTERS, np.uint16) for h in sets]
                        ) if sets else np.zeros((0, REGISTERS), np.uint16)
        key = np.zeros((len(sets), bands), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(rows):
                key = mix(key + regs[:, r:bands * rows:rows].astype(np.uint64) + np.uint64(1))
            c1 = np.array([h.sum() if len(h) else 0 for h in sets], np.uint64)
            c2 = np.array([mix(h).sum() if len(h) else 0 for h in sets], np.uint64)
        return pa.StructArray.from_arrays(
            [pa.array([len(h) for h in sets], pa.int64()),
             pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
             pa.array([r.tobytes() for r in regs], pa.binary()),
             lists(list(key.view(np.int64)), pa.int64())],
            ["n", "c1", "c2", "regs", "bands"])
    return F.arrow_udf(sketch, _SKETCH)


def estimate(regs_a: pa.Array, regs_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    """Similarity from the share of equal registers, less the share equal by chance."""
    a, b = (np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for r in (regs_a, regs_b))
    same = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    edge = 0.5 ** np.arange(VALUE_BITS + 2)

    def zeros(n: pa.Array) -> np.ndarray:  # how often a register has so many leading zeros
        load = np.maximum(1.0, n.to_numpy(zero_copy_only=False) / REGISTERS)[:, None]
        return (1 - edge[1:]) ** load - (1 - edge[:-1]) ** load
    chance = (zeros(n_a) * zeros(n_b)).sum(axis=1) / (1 << MANTISSA_BITS)
    return pa.array((same - chance) / (1 - chance), pa.float64())


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if their shingle sets' intersection is at least
    ``similarity`` times their union; ``component_id`` is the smallest id
    reachable by links, and ``kept`` marks the document of that id. Words are
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Null and empty texts have no
    shingle and no link. A null id takes no part (component null, kept). Rows
    that repeat an id are one document, linked if any of its texts is. Extra
    columns do not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = band_rows(similarity)
    sketch = sketcher(words, rows)
    base = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    sketched = (base.withColumn("s", sketch("text")).select("id", "s.*")
                .checkpoint())  # texts are hashed once; all below reads this
    klass = ["n", "c1", "c2"]
    real = sketched.where("id IS NOT NULL AND n > 0")
    classes = (real.groupBy(*klass).agg(F.min("id").alias("rep"), F.count("*").alias("members")))
    # Only sets of so many shingles can reach the similarity with a different set.
    least = math.ceil(similarity / (1 - similarity) - 1e-9)
    reps = (real.where(F.col("n") >= least).join(
        classes.where(F.col("n") >= least).select("n", "c1", "c2", F.col("rep").alias("id")).hint("merge"),
        [*klass, "id"]).dropDuplicates([*klass, "id"])  # by the join's keys: no shuffle of its own
        .select("id", "n", "regs", "bands"))
    # A key of a thousandth of all rows is hot: so there are few of them, however many rows.
    hot_from = max(HOT_ROWS, docs.count() // 1000)
    found = _links(base, settled(reps, BULKY_ROWS), words, similarity, hot_from)
    groups = (components(found).withColumnRenamed("node", "rep"))
    # Written, as the caller's job would carry its plan several times.
    labelled = settled(classes.join(groups.hint("merge"), "rep", "left").select(
        *klass, "members", F.coalesce("component", "rep").alias("component")))
    linked = join_hot(real.select("id", *klass), labelled, klass, "members", F.col("id"), hot_from)
    alone = sketched.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component"))
    return (linked.select("id", "n", "component").unionByName(alone)
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.col("component").alias("component_id"),
                    F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")))


def _links(texts: DataFrame, reps: DataFrame, words: int, similarity: float, hot_from: int) -> DataFrame:
    """Links (a, b) between class representatives whose components are those of all links."""
    buckets = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = (buckets.groupBy("band", "key")
              .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members"))
              .where("lo < hi"))
    members = settled(join_hot(buckets, shared, ["band", "key"], "members", F.col("id"), hot_from))

    def sets_of(t: pa.Array) -> pa.Array:
        return lists([h.view(np.int64) for h in shingle_sets(t, words)], pa.int64())
    sets = settled(texts.join(members.select("id").distinct().hint("merge"), "id")
                   .select("id", F.arrow_udf(sets_of, "array<bigint>")("text").alias("set")), BULKY_ROWS)

    def compared(pairs: DataFrame, least: float) -> DataFrame:
        """Exact set sizes of the pairs (a, b) that may reach the similarity ``least``."""
        likely = _likely(pairs, reps, least)
        shared_n = F.size(F.array_intersect("set_a", "set_b"))
        return (likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b")
                .withColumn("shared", shared_n)
                .withColumn("n_a", F.size("set_a")).withColumn("n_b", F.size("set_b"))
                .where(_reaches(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared"), least)))

    hub = F.when(F.col("band") % 2 == 0, F.col("lo")).otherwise(F.col("hi"))
    stars = _ordered(members.where(F.col("id") != hub).select(F.col("id"), hub.alias("hub")),
                     "id", "hub").distinct()
    first = settled(compared(stars, similarity).select("a", "b"))
    # Buckets that hold one component by now need no more. The hub of each of the others
    # is the document with most links so far in any of its members' components.
    ends = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id")))
    linked = settled(components(first).withColumnRenamed("node", "id")
                     .join(ends.groupBy("id").agg(F.count("*").alias("degree")).hint("merge"), "id"))
    centers = linked.groupBy("component").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("center"),
                                              F.count("*").alias("members"))
    central = settled(join_hot(linked, centers, ["component"], "members", F.col("id"), hot_from)
                      .select("id", "component", "center"))
    known = (members.select("band", "key", "id", "n").join(central.hint("merge"), "id", "left")
             .withColumn("component", F.coalesce("component", "id"))
             .withColumn("center", F.coalesce("center", F.struct(
                 F.lit(0).cast("long").alias("degree"), (-F.col("id")).alias("neg")))))
    mixed = (known.groupBy("band", "key")
             .agg(F.min("component").alias("least"), F.max("component").alias("most"),
                  F.max("center").alias("best"),
                  F.count("*").alias("members"))
             .where("least < most").select("band", "key", (-F.col("best.neg")).alias("hub"), "members"))
    rows = settled(join_hot(known, mixed, ["band", "key"], "members", F.col("id"), hot_from).drop("center"))
    second = rows.where("id != hub").select("hub", "id").distinct()
    # Jaccard distance is a metric: a document further from the hub than twice the
    # threshold's distance cannot be linked with one that is linked to the hub.
    least = min(NEAR, max(0.0, 2 * similarity - 1))
    near = settled(
        compared(second.select(F.col("hub").alias("a"), F.col("id").alias("b")), least)
        .select(F.col("a").alias("hub"), F.col("b").alias("id"), F.col("n_b").alias("n"), F.col("n_a").alias("n_hub"),
                    _reaches(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared"), similarity).alias("linked"),
                    F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a")).alias("delta")),
        BULKY_ROWS)
    label = rows.select("id", "component").distinct()
    seeking = (near.join(label.hint("merge"), "id").withColumn("seeks", ~F.col("linked"))
               .withColumn("whole", F.lit(False)))
    far = settled(_far(rows, near, hot_from).join(
        sets.select("id", F.col("set").alias("delta")).hint("merge"), "id"), BULKY_ROWS)
    far = (far.withColumn("n_hub", F.lit(0)).withColumn("linked", F.lit(False)).withColumn("whole", F.lit(True)))
    crossing = settled(_by_difference(seeking.unionByName(far), similarity, hot_from).distinct())
    return (first.unionByName(near.where("linked").select(F.col("hub").alias("a"), F.col("id").alias("b")))
            .unionByName(compared(crossing, similarity).select("a", "b")))  # components() reads it once


def _open(marked: DataFrame, keys: list[str], hot_from: int) -> DataFrame:
    """The rows of the groups that hold one that seeks and more than one component."""
    groups = (marked.groupBy(*keys)
              .agg(F.max("seeks").alias("open"), F.min("component").alias("least"),
                   F.max("component").alias("most"), F.count("*").alias("rows"))
              .where("open AND least < most").select(*keys, "rows"))
    return join_hot(marked, groups, keys, "rows", F.col("id"), hot_from)


def _far(rows: DataFrame, near: DataFrame, hot_from: int) -> DataFrame:
    """Per hub its buckets' documents far from it (they seek) and those near it but not linked to it.

    A document linked to the hub cannot be linked to one that is far from it.
    """
    state = near.select("hub", "id", F.lit(False).alias("seeks"), "linked")
    at = settled(rows.where("id != hub").select("hub", "id", "n", "component").distinct()
          .join(state.hint("merge"), ["hub", "id"], "left")
          .withColumn("seeks", F.coalesce("seeks", F.lit(True))).where("seeks OR NOT linked").drop("linked"))
    return _open(at, ["hub"], hot_from)


def _by_difference(marked: DataFrame, similarity: float, hot_from: int) -> DataFrame:
    """Pairs (a, b) around one hub, one of which seeks, that may be linked.

    With the differences dx, dy of x and y from the hub (symmetric), x and y
    differ in |dx| + |dy| - 2 |dx & dy| shingles, at most t (|x| + |y|) if
    linked, t = (1 - s) / (1 + s). One not linked to the hub has a dx beyond
    t (|x| + |hub|), so linked pairs share differences: more than
    (|dy| + t (|hub| - |y|)) / 2 of them, and at least |dx| - t |x| (1 + 1 / s).
    Sets that share c elements also share one among the first size - c + 1 of
    each in any common order (prefix filter); the order here is rare ones first.
    From their first shared element on, both must have c elements left.
    Documents far from the hub (``whole``) have their sets instead, which are
    their differences from the empty set; all of the above holds for it too.
    """
    t = (1 - similarity) / (1 + similarity)
    size = F.size("delta")
    half = F.floor((size + t * (F.col("n_hub") - F.col("n"))) / 2 - 1e-9) + 1
    most = F.ceil(size - t * (1 + 1 / similarity) * F.col("n") - 1e-9)
    reach = size - F.greatest(F.lit(1), half) + 1
    reach = F.when(F.col("linked"), reach).otherwise(
        F.greatest(reach, size - F.greatest(F.lit(1), most) + 1))
    group = ["hub", "whole"]
    # Written, as all below would carry its plan several times.
    opened = settled(_open(marked.withColumn("reach", reach).withColumn("size", size), group, hot_from), BULKY_ROWS)
    each = (opened.select(*group, "id", "n", "component", "seeks", "reach", "size", F.explode("delta").alias("e")))
    # Elements of one component only lead to no pair, however many documents share them.
    rarity = each.groupBy(*group, "e").agg(F.count("*").alias("often"),
                                           (F.min("component") < F.max("component")).alias("mixed"))
    place = F.row_number().over(Window.partitionBy(*group, "id").orderBy("often", "e"))
    prefix = (each.join(rarity.hint("merge"), [*group, "e"]).withColumn("place", place)
              .where("place <= reach AND mixed").drop("reach", "mixed")
              .withColumn("left", F.col("size") - F.col("place") + 1))
    x = _cells(prefix.where("seeks"), "row", "column")
    y = _cells(prefix, "column", "row").select(*group, "e", "row", "column", *[
        F.col(c).alias(f"{c}_") for c in ("id", "n", "component", "seeks", "size", "left")])
    needed = (F.col("size") + F.col("size_") - t * (F.col("n") + F.col("n_"))) / 2 - 1e-9
    met = (x.join(y.hint("merge"), [*group, "e", "row", "column"])
           .where((F.col("component") != F.col("component_")) & (~F.col("seeks_") | (F.col("id") < F.col("id_")))
                  & (F.least("left", "left_") >= needed)
                  & (F.abs(F.col("size") - F.col("size_")) <= t * (F.col("n") + F.col("n_")))
                  & (F.least("n", "n_") >= F.greatest("n", "n_") * similarity)))
    return _ordered(met, "id", "id_")


def _cells(prefix: DataFrame, dealt: str, repeated: str) -> DataFrame:
    """Deal an element's rows along one side of a square of cells and repeat them along the other.

    An element of at most ``CELL_ROWS`` rows has one cell; no cell of a commoner
    one takes many more rows than that from either side.
    """
    side = F.ceil(F.col("often") / CELL_ROWS)
    return (prefix.withColumn(dealt, F.pmod(F.xxhash64("id"), side))
            .withColumn(repeated, F.explode(F.sequence(F.lit(0).cast("long"), side - 1))))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate does not rule out the similarity ``least``."""
    spread = math.sqrt(least * (1 - least))
    near = F.arrow_udf(estimate, "double")
    a = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    b = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
    return (pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
            .where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)
            .where(near("regs_a", "regs_b", "n_a", "n_b") >= least - SIGMAS * spread / F.sqrt(
                F.least(F.lit(REGISTERS), "n_a", "n_b").cast("double")))
            .select("a", "b"))


def _reaches(shared: Column, union: Column, similarity: float) -> Column:
    """In whole numbers, so that a pair exactly at the threshold is linked."""
    return shared.cast("long") * 10_000 >= union.cast("long") * round(similarity * 10_000)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
               similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document (the smallest id) of each component of near copies.

    Rows with a null id stay; of rows that repeat an id one stays."""
    (key,) = fresh(docs, "__kept_id")
    kept = (link_documents(docs, id_col, text_col, words, similarity)
            .where(F.col("kept") & col(id_col).isNotNull()).select(col(id_col).alias(key)).distinct())
    stays = docs.join(kept, col(id_col) == F.col(key)).drop(key)
    return stays.dropDuplicates([id_col]).unionByName(docs.where(col(id_col).isNull()))
