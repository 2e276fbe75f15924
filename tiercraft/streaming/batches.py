"""Segment record files as they land in a folder.

The original tool recomputes everything for each uploaded table. The
streaming form keeps that contract: each micro-batch of newly arrived files
is one complete record table, run through quarantine -> clean -> segment
(-> trend) by ``foreachBatch``, and the segmented rows, the rejects and the
value table are appended under ``<sink>/<output>/batch_id=<n>``.

Writes are keyed by batch id and overwrite that partition only, so a batch
replayed after a failure (executor or driver loss) rewrites the same files
instead of duplicating them. Progress lives in the checkpoint folder that the
caller names: it must be shared, kept over restarts, and each stream needs its
own, as batch ids start anew with a new folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tiercraft.config import COMPANIES, PLAYERS
from tiercraft.operators import intake
from tiercraft.plans import runner
from tiercraft.sources.readers import ROW_ORDER, _null_tokens


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _runner_for(mode: str, prev: DataFrame | None, as_of, custom: dict | None
                ) -> Callable[[DataFrame], runner.RunResult]:
    if mode == "players":
        return lambda df: runner.run_players(df, prev=prev, cfg=PLAYERS, as_of=as_of)
    if mode == "companies":
        return lambda df: runner.run_companies(df, cfg=COMPANIES)
    custom = custom or {}
    return lambda df: runner.run_custom(df, custom.get("id_col"), custom["value_col"],
                                        custom.get("recency_col"), custom.get("approach"),
                                        as_of=as_of)


def segment_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                   checkpoint: str, mode: str = "players", prev: DataFrame | None = None,
                   as_of=None, custom: dict | None = None, available_now: bool = False, max_files_per_trigger: int | None = None,
                   id_index: str | None = None) -> StreamingQuery:
    """Start a stream over CSV files in ``source_dir`` (all columns text, as
    in :func:`tiercraft.sources.read_records`). A file whose header is not the
    schema's, in order, fails its batch. Rerunning with the same ``checkpoint``
    goes on where the last run ended and keeps what it wrote. With ``id_index``
    (a shared folder that lives as long as the checkpoint) a record whose id an
    earlier micro-batch has brought is rejected as a duplicate; without it each
    micro-batch is judged alone."""
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder of its own")
    reader = (spark.readStream.schema(schema).option("header", "true")
              .option("quote", '"').option("escape", '"').option("multiLine", "true")
              .option("enforceSchema", "false"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.csv(source_dir)
    # File and split are known per row in the stream; the position inside
    # the split is added per micro-batch (row ids need a static frame).
    stream = stream.withColumn("_file", F.col("_metadata.file_path")) \
        .withColumn("_block", F.col("_metadata.file_block_start"))
    run = _runner_for(mode, prev, as_of, custom)
    id_col = {"players": PLAYERS.id_col, "companies": COMPANIES.id_col}.get(mode, (custom or {}).get("id_col"))
    if id_index and not id_col:
        raise ValueError("an index of ids needs an id column")

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.withColumn(ROW_ORDER, F.struct(
            F.col("_file").alias("file"), F.col("_block").alias("block"),
            F.monotonically_increasing_id().alias("pos"))).drop("_file", "_block")
        batch, late = _null_tokens(batch), None
        if id_index:
            batch, late = intake.quarantine_arrival(batch, id_col, id_index, batch_id)
        result = run(batch)
        try:
            _write(result.segmented.drop(ROW_ORDER), f"{sink_dir}/segmented", batch_id)
            rejects = result.rejects if late is None else result.rejects.unionByName(late)
            _write(rejects.drop(ROW_ORDER), f"{sink_dir}/rejects", batch_id)
            _write(result.value_table(), f"{sink_dir}/value_table", batch_id)
        finally:
            result.release()

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
