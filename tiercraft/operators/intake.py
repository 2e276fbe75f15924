"""Quarantine of arriving data against the ids that earlier arrivals have brought.

The accepted ids are kept as a Parquet table, one folder per arrival, sorted by
id and with Bloom filters per row group. An arrival is judged against the
folders of smaller arrival numbers only and writes its own folder as a whole,
so an arrival that runs again after a failure gives the same rows, whatever came
after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.functions.columns import col
from tiercraft.functions.text import normalise_id
from tiercraft.operators.quality import REASON, classify_identity
from tiercraft.session import ensure_checkpoint_dir

_INDEX = "id string, arrival long"


def accepted_ids(spark: SparkSession, index: str, before: int | None = None) -> DataFrame:
    """(id, arrival) of the accepted rows, of arrivals numbered below ``before``."""
    spark.createDataFrame([], _INDEX).write.mode("ignore").partitionBy("arrival").parquet(index)
    ids = spark.read.schema(_INDEX).parquet(index)
    return ids if before is None else ids.where(F.col("arrival") < before)


def quarantine_arrival(df: DataFrame, id_col: str, index: str, arrival: int) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects) of one arrival; ``index`` is the folder of accepted ids.

    Within the arrival the rules of :func:`tiercraft.operators.quality.quarantine`
    hold; an id that an earlier arrival brought is a duplicate as well. So all
    arrivals together keep the rows that one run over them all, in the order of
    their numbers, would keep. Numbers must rise with time; a number that is used
    again replaces what it brought (a replay), also if later ones have run.
    """
    if arrival < 0:
        raise ValueError("arrivals are numbered from 0")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    known = accepted_ids(spark, index, arrival).select(F.col("id").alias("_known_id"), F.lit(True).alias("_known"))
    judged = classify_identity(df, id_col)
    # Only rows that pass within the arrival are looked up, so an id comes once: the join has no hot key.
    # The planner builds a Bloom filter of the arrival's ids where that saves reading the index.
    key = F.when(F.col(REASON).isNull(), normalise_id(id_col, df.schema[id_col].dataType))
    spread = F.when(key.isNull(), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    looked_up = (judged.withColumn("_id", F.coalesce(spread, key))
                 .join(known, F.col("_id") == F.col("_known_id"), "left")
                 .withColumn(REASON, F.when(F.col("_known"), F.lit(f"Duplicate {id_col} (first occurrence kept)"))
                             .otherwise(F.col(REASON)))
                 .drop("_known", "_known_id").checkpoint())
    (looked_up.where(F.col(REASON).isNull()).select(F.col("_id").alias("id")).sortWithinPartitions("id")
     .write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{index}/arrival={arrival}"))
    rows = looked_up.drop("_id")
    return rows.where(F.col(REASON).isNull()).drop(REASON), rows.where(F.col(REASON).isNotNull())
