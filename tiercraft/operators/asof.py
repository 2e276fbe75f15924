"""As-of join: for each record the latest prior state of its id at or before its time.

Records and prior states are laid out in one order of (id, time) by range
partitioning, so an id that holds a third of all rows is cut into as many
partitions as its rows are worth. Within a partition the last state seen is
carried forward; what a partition starts with comes from the partitions before
it, by a running last value over one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.functions.columns import col
from tiercraft.session import ensure_checkpoint_dir
from tiercraft.sources.readers import ROW_ORDER


def asof_join(current: DataFrame, prior: DataFrame, key: Column | str, at: Column | str, prior_key: Column | str,
              prior_at: Column | str, values: dict[str, Column | str], partitions: int | None = None) -> DataFrame:
    """Every row of ``current`` with ``values`` (name: column of ``prior``) of the latest prior row
    of its key whose time is at or before its own; NULL where there is none.

    Of prior rows with equal key and time the last by their row order (or, without
    one, by their values) counts. A row of ``current`` without a key or time
    matches nothing; prior rows without either are not used. Row count and order
    columns of ``current`` stay as they are.
    """
    spark = current.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, at, prior_key, prior_at = map(col, (key, at, prior_key, prior_at))
    state = F.struct(*[col(c).alias(name) for name, c in values.items()])
    tie = F.col(ROW_ORDER).cast("string") if ROW_ORDER in prior.columns else F.to_json(state)
    if ROW_ORDER in prior.columns and prior.schema[ROW_ORDER].dataType.typeName() == "long":
        tie = F.format_string("%020d", F.col(ROW_ORDER))
    states = (prior.where(prior_key.isNotNull() & prior_at.isNotNull())
              .select(prior_key.cast("string").alias("_k"), prior_at.alias("_t"), F.lit(0).alias("_side"),
                      tie.alias("_tie"), state.alias("_state")))
    whole = F.struct(*map(col, current.columns))
    rows = current.select(key.cast("string").alias("_k"), at.alias("_t"), F.lit(1).alias("_side"),
                          F.xxhash64(whole).cast("string").alias("_tie"), whole.alias("_row"))
    order = ["_k", "_t", "_side", "_tie"]
    both = rows.unionByName(states, allowMissingColumns=True)
    ranged = (both.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
              .checkpoint())    # the partitions have to stay as they are
    # One row per partition: its first and last key, and the last state of any key.
    ends = ranged.groupBy("_pid").agg(
        F.min_by("_k", F.struct(*order)).alias("_first"),
        F.max(F.when(F.col("_side") == 0, F.struct("_k", "_t", "_tie", "_state"))).alias("_last"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_pid", "_first", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    within = Window.partitionBy("_pid", "_k").orderBy("_t", "_side", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # The carries hold one row per partition: a bounded broadcast.
    carried = (ranged.withColumn("_seen", F.last("_state", ignorenulls=True).over(within)).where("_side = 1")
               .join(F.broadcast(carry.where("_carry._k = _first").select("_pid", "_carry")), "_pid", "left"))
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_seen", F.when(F.col("_carry._k") == F.col("_k"),
                                                                      F.col("_carry._state"))))
    return carried.select("_row.*", found.alias("_found")).select(
        *map(col, current.columns), *[F.col("_found")[name].alias(name) for name in values])
