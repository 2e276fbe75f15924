"""Mix sources to target weights by systematic sampling.

Each document is expected ``target / source size`` times. Per source the
expected copies are summed up in a fixed order, one random offset is added, and
a document is emitted once for each integer boundary its stretch crosses, so a
source's copies are exact to one document and, as documents are ordered by
size class first, its words are close to the target.

The prefix sum is distributed: rows are put into blocks (source, size class,
hash slot; about sqrt(rows) slots per 16 classes), blocks are counted map-side,
a window over the few blocks of a source gives each block its start, and a
window inside a block ranks its rows. No task ever sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, whole, without, word_count
from tiercraft.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
HASH_DIGITS = 12


def _hash(seed: int, c: Column) -> Column:
    """48 bits of the MD5 of ``seed|value`` as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), c)), 1, HASH_DIGITS),
                  16, 10).cast("long")


def _size_class(size: Column) -> Column:
    """Sizes within an eighth of a power of two share a class."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(
        bits * 16 + F.floor(size / F.pow(F.lit(2.0), bits - 4))).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, per entry of ``sums``, its sum over the rows before each in ``order``.

    Rows are range-partitioned and checkpointed, so that partitions stay as they
    are; each starts with the totals of those before it (a row per partition).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = (df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
              .withColumn("__pid", F.spark_partition_id()).checkpoint())
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("__pid").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
              .select("__pid", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums]))
    return (ranged.join(F.broadcast(starts), "__pid")       # one row per partition
            .select(*map(col, df.columns), *[(F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n)
                                             for n, c in sums.items()]))


def allocate(per_source: DataFrame, share: float = 1.5, max_copies: float = 2.0,
             weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``target`` per row of (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``max_copies`` times its
    source's size and the excess is reshared by weight until none is above.
    Resharing ends at the level where the sources whose cap per weight lies
    under it are capped, so one pass in the order of cap per weight finds it.
    Both orders are running sums over range partitions: no task holds all sources.
    """
    by_name = [F.col("source").asc_nulls_last()]
    placed = _running(per_source, by_name, {"place": F.lit(1)})
    cap = F.col("source_size") * F.lit(float(max_copies))
    weighed = (placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (
                   F.col("place") % len(weights) + 1).cast("int")))
               .withColumn("cap", cap).withColumn("cap_per_weight", F.col("cap") / F.col("weight")))
    by_cap = _running(weighed, [F.col("cap_per_weight").asc(), *by_name],
                      {"caps": F.col("cap"), "weights": F.col("weight")}).checkpoint()
    whole_mix = by_cap.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    pool = (whole_mix["size"] or 0) * float(share)
    level = (F.lit(pool) - F.col("caps")) / (F.lit(whole_mix["weight"] or 1) - F.col("weights"))
    # The first source whose cap lies above its level sets the level of all after it;
    # of sources equal in cap per weight the first has the highest level.
    first = by_cap.agg(F.min(F.when(F.col("cap_per_weight") >= level, F.struct(
        F.col("cap_per_weight").alias("at"), (-level).alias("down")))).alias("first")).first()["first"]
    if first is None:       # every source is capped
        return by_cap.select("source", "source_size", F.col("cap").alias("target"))
    return by_cap.select("source", "source_size", F.least(
        F.col("cap"), F.lit(-first["down"]) * F.col("weight")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", share: float = 1.5, max_copies: float = 2.0,
           weights: tuple[int, ...] = WEIGHTS, seed: int = 42,
           names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies"),
           ) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` is the text's number of words (null or empty: 0; never emitted
    beyond its expectation, it adds no words). A null source is a source of its
    own. Rows that repeat an id are separate rows of the mix; the order among
    rows of one size is by a hash of the id, then id, then text hash (null id
    last), so reruns agree up to rows that are equal in all of these. A source
    of size 0 has target 0 and emits nothing. Empty tables give an empty
    result; input columns called like the four new ones are replaced.
    """
    docs = without(docs, *names)
    size, cls, slot, key, thash, source2, cls2, slot2, start, all_words, target, rate, offset_col = fresh(
        docs, "__size", "__cls", "__slot", "__key", "__thash", "__source", "__cls2", "__slot2", "__start",
        "__words", "__target", "__rate", "__offset")
    ensure_checkpoint_dir(docs.sparkSession)
    slots = max(1, math.ceil(math.sqrt(docs.count()) / 16))
    ident = F.coalesce(col(id_col).cast("string"), F.lit(""))
    sized = (docs.withColumn(size, word_count(col(text_col)))
             .withColumn(cls, _size_class(F.col(size)))
             .withColumn(key, _hash(seed, ident))
             .withColumn(slot, F.pmod(F.col(key), F.lit(slots)))
             .withColumn(thash, F.md5(whole(col(text_col)))))
    blocks = (sized.groupBy(col(source_col).alias("source"), F.col(cls).alias("cls"),
                            F.col(slot).alias("slot"))
              .agg(F.count("*").alias("rows"), F.sum(size).alias("words"))
              .checkpoint())  # read three times below; cut off from the texts
    targets = allocate(blocks.groupBy("source").agg(F.sum("words").alias("source_size")),
                       share, max_copies, weights)
    ahead = (Window.partitionBy("source").orderBy("cls", "slot")
             .rowsBetween(Window.unboundedPreceding, -1))
    offset = (_hash(seed, F.concat(F.lit("offset|"), F.coalesce(F.col("source"), F.lit(""))))
              / F.lit(float(16 ** HASH_DIGITS)))
    starts = (blocks.withColumn("start", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
              .withColumnRenamed("source", "bsource")
              .join(targets, F.col("bsource").eqNullSafe(F.col("source")))
              .select(F.col("bsource").alias(source2), F.col("cls").alias(cls2),
                      F.col("slot").alias(slot2), F.col("start").alias(start),
                      F.col("source_size").alias(all_words), F.col("target").alias(target),
                      F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                      .otherwise(0.0).alias(rate), offset.alias(offset_col)))
    # The three key columns stay first in the join and the window: one shuffle serves both.
    joined = sized.join(starts, col(source_col).eqNullSafe(F.col(source2))
                        & (F.col(cls) == F.col(cls2)) & (F.col(slot) == F.col(slot2)))
    inside = Window.partitionBy(col(source_col), F.col(cls), F.col(slot)).orderBy(
        F.col(size), F.col(key), col(id_col).asc_nulls_last(), F.col(thash))
    place = F.col(start) + F.row_number().over(inside)
    taken = (F.floor(F.col(offset_col) + place * F.col(rate))
             - F.floor(F.col(offset_col) + (place - 1) * F.col(rate)))
    return joined.select(*map(col, docs.columns), F.col(size).alias(names[0]),
                         F.col(all_words).cast("long").alias(names[1]),
                         F.col(target).cast("double").alias(names[2]),
                         taken.cast("long").alias(names[3]))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    (n,) = fresh(docs, "__copies")
    counted = copies(docs, names=tuple(fresh(docs, "__s", "__ss", "__t")) + (n,), **options)
    return (counted.where(F.col(n) > 0)
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*map(col, docs.columns)))
