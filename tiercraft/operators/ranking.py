"""Ranks over a global order without a single-partition window.

``row_number()`` over an unpartitioned window moves every row to one task.
For unbounded ordered outputs (the host worklist) the rank is built from a
range partitioning instead: rows are range-partitioned on the sort keys and
checkpointed (stable partition ids, lineage cut, survives executor loss);
per-partition counts (one row per partition) give each partition's offset;
the rank is offset + row_number within the partition. The plan is the same for
every input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.session import ensure_checkpoint_dir


def distributed_rank(df: DataFrame, order: list[Column], name: str = "rank",
                     partitions: int | None = None) -> DataFrame:
    """``df`` with its rank in ``order``. Pass only the columns that are needed:
    all of them are range-partitioned and checkpointed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order)
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0))
                            .alias("_off"))
    within = Window.partitionBy("_pid").orderBy(*order)
    # offsets holds one row per partition: a bounded broadcast.
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.row_number().over(within))
            .drop("_pid", "_off"))


def small_rank(order: list[Column]) -> Column:
    """Rank for outputs already bounded in size (top-k, per-segment rows)."""
    return F.row_number().over(Window.orderBy(*order))
